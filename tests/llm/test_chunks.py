"""The chunk paths of problems 3 and 6 against the whole-text paths."""

import random

import pytest

from whitebrook.llm import encoding, quality

PARTS = ["Ala ma kota. ", "it's ", "we'll", "\n", "\n\n", "   ", "| a | b | c |\n", "- punkt\n", "https://x.example/aa?b=c ", "漢字かな交じり文", "。", "12345 ", "!!!", " ", "　", "🙂", "�ÄĂ ", "2024-01-01 10:00 log\n", "x;y;z;w;q ", "żółć", "\t\t", "İΣ ", "Gdynia - Sopot  3:2 (1:0)\n", "Lublin - Nowy Targ  0:1 (0:0)\n"]


def texts(seed, count, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, size))) for _ in range(count)]


def rows(spark, found):
    # a long text twice under one key, null, empty, blank, one long word, only blanks, and the same row again
    extra = [None, "", " \n ", "x" * 900, " " * 900, "a b" * 300, ("słowo " * 10 + "y" * 300) * 3]
    every = [*found, *extra]
    return spark.createDataFrame([*enumerate(every), (0, found[0]), (0, found[1])], "id long, text string").repartition(3)


@pytest.mark.parametrize("chunk", [16, 150])
def test_p6_ids_by_chunks_equal_whole_texts(spark, chunk):
    df = rows(spark, texts(1, 30, 120))
    cut, whole = (sorted(map(tuple, encoding.token_ids(df, "id", chunk=c, overlap=12).collect()), key=repr) for c in (chunk, 1 << 20))
    assert cut == whole


@pytest.mark.parametrize("chunk", [16, 150])
def test_p3_statistics_by_chunks_equal_whole_texts(spark, chunk):
    df = rows(spark, texts(2, 30, 120))
    cut, whole = (sorted(map(tuple, quality.quality(df, frozenset({"ala", "ma"}), "id", chunk=c).collect()), key=repr) for c in (chunk, 1 << 20))
    assert cut == whole


def test_p3_statistics_of_runs_longer_than_the_overhang(spark):
    size = quality.CHUNK
    run = "ab,cd" * (quality.OVERHANG // 2)
    found = ["słowo " * (size // 6 - 100) + run + " koniec. " * 50, run * 10 + " " + "słowo " * size, "słowo " * size, "a" * (quality.OVERHANG) + " b" * size]
    df = spark.createDataFrame(list(enumerate(found)), "id long, text string")
    got = {r[0]: tuple(r)[1:] for r in quality.quality(df, frozenset({"ab"}), "id").collect()}
    assert got == {i: quality.measure(t, frozenset({"ab"})) for i, t in enumerate(found)}


def test_the_longest_rows_use_the_chunk_paths():
    # the longest corpus text has 45,128 characters, the longest document of sf0.1 has 7,242
    assert quality.CHUNK < 45_128 and encoding.CHUNK < 7_242


def test_p3_rows_of_a_table_without_delimiters():
    score = "\n".join(f"Miasto {'Nowe ' * (i % 2)}- Wieś  {i % 4}:{i % 3} ({i % 2}:0)" for i in range(20))
    prose = "\n".join(f"W roku {1900 + i} miasto, które ma {i} ulic, kupiło most." for i in range(20))
    wrapped = "\n".join(["słowo i drugie, a potem trzecie"] * 20)
    assert quality.measure(score)[6] == 1.0 and quality.measure(prose)[6] == quality.measure(wrapped)[6] == 0.0
    assert quality.measure(score.split("\n")[0])[6] == 0.0  # one such line is no table


def test_p3_indentation_hides_no_marks():
    for gap in (" " * 100, "\t " * 80):
        assert quality.measure(f"{gap}- punkt listy bez kropki{gap}\n" * 9)[6] == 1.0
        assert quality.measure(f"{gap}To jest zdanie.{gap}\n" * 9)[4] == 1.0


def test_p3_misread_bytes_of_any_page():
    for page in quality._MISREAD_BY:
        assert quality._garbled("zażółć".encode().decode(page, "replace"))
    assert not any(map(quality._garbled, "zażółć gęślą jaźń PÓŹNIEJ süße Äußerung straße żółw naïve Ångström".split()))
