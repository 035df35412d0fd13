import random

from whitebrook.llm import bpe, encoding, token_budget


def greedy(word, vocabulary):
    out = 0
    while word:
        n = max(n for n in range(1, len(word) + 1) if word[:n] in vocabulary)
        word, out = word[n:], out + 1
    return out


def test_longest_match_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(12)} | set("abc")
        match = bpe.LongestMatch({w: i for i, w in enumerate(words)} | {f"##{w}": i for i, w in enumerate(words)})
        for _ in range(30):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
            assert match.count(text) == greedy(text, words)
    assert bpe.LongestMatch({"a": 1, "##b": 2}).encode("ac") == [-1] and bpe.LongestMatch({"a": 1, "##b": 2}).encode("abb") == [1, 2, 2]


def test_greedy_is_no_less_than_exact(spark):
    exact, other = bpe.load(), bpe.load_greedy()
    for text in ("", "Ala ma kota, a kot ma Alę.", "zażółć gęślą jaźń 12345", "漢字かな", "🙂👍🏽 it's"):
        pieces = exact.pieces(text)
        assert other.count(text) == sum(greedy(p.encode(), exact.ranks) for p in pieces)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "kot ma Alę", None)], "k long, text string, s string")
    got = {r.k: (r.n_tokens, r.n_greedy) for r in token_budget.greedy_counts(df, "k", keep=("s",)).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (exact.count("kot ma Alę"), other.count("kot ma Alę"))}


def test_ids_decode_to_the_text_also_in_chunks(spark):
    rng = random.Random(6)
    parts = ["słowo ", "漢字", "🙂", "\n\n", "it's ", "   ", "12345", "…", "x" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 80))) for _ in range(40)] + ["", None]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, texts[1])], "doc_id long, text string").repartition(3)
    for chunk in (32, 1 << 16):
        ids = encoding.token_ids(df, chunk=chunk, overlap=8)
        got = sorted(((r.doc_id, r.text) for r in encoding.decode(ids).collect()), key=repr)
        assert got == sorted([(i, t or "") for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1])], key=repr)
