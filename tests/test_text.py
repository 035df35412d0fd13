import pytest
from pyspark.sql import functions as F

from whitebrook.functions import text as tx
from whitebrook.functions import tokens

SPACES = [chr(i) for i in range(0x110000) if chr(i).isspace()]


def column(spark, values, kind, make):
    df = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}")
    return [r.y for r in df.select("k", make("x").alias("y")).orderBy("k").collect()]


def test_strip_and_words_know_every_whitespace(spark):
    assert len(SPACES) == 29
    texts = [None, "", "a", "".join(SPACES), *(f"{c}a{c}b {c}" for c in SPACES), "​a﻿", "😀 x "]
    assert column(spark, texts, "string", tx.strip) == [t if t is None else t.strip() for t in texts]
    assert column(spark, texts, "string", tx.n_words) == [len((t or "").split()) for t in texts]
    assert column(spark, texts, "string", lambda c: tx.cap(c, 1)) == [t if t is None else t[:1] for t in texts]


@pytest.mark.parametrize("name", ["words", "byte_bpe_50k"])
def test_counts_and_caps_agree(spark, name):
    texts = ["", "Ala ma kota, a kot ma Alę. " * 3, "żółć漢字😀", None]
    encode = str.split if name == "words" else lambda t: tokens.load(name).encode(t, add_special_tokens=False).ids
    n = [len(encode(t or "")) for t in texts]
    assert column(spark, texts, "string", lambda c: tokens.count(c, name)) == n
    for most in (0, 3, 1000):
        got = column(spark, texts, "string", lambda c: tokens.truncate(c, most, name))
        assert [(r.n_tokens, r.capped) for r in got] == [(x, x > most) for x in n]
        assert all(r.text == t for r, t in zip(got, texts) if not r.capped)
        assert name != "words" or [r.text for r in got if r.capped] == [" ".join(t.split()[:most]) for t, x in zip(texts, n) if x > most]
    df = spark.createDataFrame([(x,) for x in n], "n_tokens int")
    assert tuple(tokens.stats(df, most=3).first()) == (sum(x > 3 for x in n), max(n), sum(n))
    assert tuple(tokens.stats(df.limit(0)).first()) == (0, 0, 0)


def test_an_unknown_model_has_no_tokenizer():
    assert tokens.tokenizer_of("qwen/qwen3-embedding-4b") == "byte_bpe_50k" and tokens.tokenizer_of("x/y", "words") == "words"
    with pytest.raises(KeyError, match="x/y"):
        tokens.tokenizer_of("x/y")


def test_names_options_and_formats(spark):
    assert column(spark, ["qwen/qwen3-embedding-8b", "a/b:c", None], "string", tx.model_slug) == ["qwen_qwen3-embedding-8b", "a_b_c", None]
    assert column(spark, ["qwen/qwen3-embedding-8b", "a/b-c"], "string", lambda c: tx.background_name(c, "pl_doc", 64)) == ["qwen3_8b_pl_doc_mrl64", "a_b_c_pl_doc_mrl64"]
    assert column(spark, [" a, ,b ", "", None, " , "], "string", tx.csv_options) == [["a", "b"], None, None, None]
    sizes = [None, 0, 1, 1023, 1024, 1536, 2560, 5 * 1024**2, 1024**3, 1024**4, 3 * 1024**4 // 2]
    assert column(spark, sizes, "bigint", tx.size_text) == ["—", "—", "1 B", "1023 B", "1 KB", "2 KB", "2 KB", "5 MB", "1 GB", "1.0 TB", "1.5 TB"]
    times = [None, "", "2025-03-01T00:06:59Z", "2025-03-01T10:06:00+02:00", "2025-03-01", "2025-03-01 10:06:07.123456", "2025-13-01T00:00:00Z", "soon, I think so"]
    assert column(spark, times, "string", tx.time_text) == ["—", "—", "2025-03-01 00:06", "2025-03-01 10:06", "2025-03-01 00:00", "2025-03-01 10:06", "2025-13-01T00:00", "soon, I think so"]
    assert column(spark, [None, 0, 900], "int", tx.cap_text) == ["no cap", "no cap", "900 chars"]
    assert column(spark, [None, 1234567], "bigint", lambda c: tx.number_text(c, ",d")) == ["—", "1,234,567"]
    assert column(spark, [None, 0.0000123], "double", lambda c: tx.number_text(c, "%.3e")) == ["—", "1.230e-05"]
    assert column(spark, [None, 0, 5], "int", lambda c: tx.falsy_coalesce(c, F.lit(7))) == [7, 7, 5]
