import hashlib

import __spark_entry__ as entry
from whitebrook.llm.splitting import cut


def test_p2_pieces_keep_every_row_without_sha(spark, tmp_path):
    first, second, third = (f"{w} ma kota. " * 120 for w in ("Ala", "Ola", "Ela"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:24]
    rows = [(None, first), (None, second), (None, second), (sha(third), third), (None, third), ("s", first), ("s", second), (None, None), ("n", None), (None, "")]
    spark.createDataFrame(rows, "sha string, text string").write.parquet(str(tmp_path / "corpus.parquet"))
    found = sorted(map(tuple, entry.queries()["p2_pieces"](spark, str(tmp_path)).collect()))
    want = [(k, i, p) for k, t in ((sha(first), first), (sha(second), second), (sha(third), third), ("s", first), ("s", second)) for i, p in enumerate(cut(t))]
    assert found == sorted(want)


def test_pieces_below_zero_over_blocks_and_repeated(spark, monkeypatch):
    from whitebrook.llm import splitting

    monkeypatch.setattr(splitting, "BLOCK", 3)
    text = " ".join(f"Zdanie numer {i} o kocie." for i in range(400))
    good = cut(text)
    assert len(good) > 9
    rows = [("s", i, p) for i, p in enumerate(good)] * 2 + [("s", -1, text[:50]), ("s", -1, "nie ma tego"), ("s", -5, good[3]), ("s", 4, "nie ma tego"), ("s", len(good) + 1, good[-1])]
    recorded = spark.createDataFrame(rows, "doc_sha string, chunk_idx int, text string").repartition(4)
    known = spark.createDataFrame([("s", text, "clash"), ("s", text, "x")], "sha string, text string, rule string")
    got = {tuple(r) for r in splitting.audit(recorded, known).collect()}
    assert got == {("s", -1, "b"), ("s", 4, "b"), ("s", len(good) + 1, "c")}
    assert splitting.audit(recorded.limit(0), known).count() == splitting.audit(recorded, known.limit(0)).count() == 0


def test_own_pieces_break_no_rule():
    import random

    from whitebrook.llm.splitting import wrong

    rng = random.Random(1)
    parts = ["słowo ", "zdanie. ", "długie" * 30 + " ", "\n\n", "x" * 950, ", ", "漢字。", "\n- punkt "]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20, 400)))
        own = cut(text)
        near = 0
        for i, p in enumerate(own):
            rule, near = wrong(p, i, own[i - 1 : i] if i else [], text, near=near)
            assert rule == "", (rule, i)
