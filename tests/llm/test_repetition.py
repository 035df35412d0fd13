import numpy as np
from pyspark.sql import Row

import __spark_entry__ as entry
from whitebrook.llm import repetition


def _text(letters):
    return "".join(map(chr, letters))


def _brute(text, window=30):
    letters = [c for c in text.lower() if c.isalpha()]
    seen, hit = set(), [False] * len(letters)
    for i in range(len(letters) - window + 1):
        run = "".join(letters[i : i + window])
        if run in seen:
            hit[i : i + window] = [True] * window
        seen.add(run)
    return sum(hit) / len(letters) if letters else 0.0


def _far(seed=0):
    """Four-letter random text of 38,000 letters whose first 12,000 come again."""
    first = np.random.default_rng(seed).integers(97, 101, 26_000)
    return _text(np.concatenate([first, first[:12_000]]))


def _short_copies(n=800_000, seed=1):
    """Random letters with copies of 34 letters from anywhere before."""
    rng = np.random.default_rng(seed)
    out = rng.integers(97, 123, n)
    for at in range(n // 8, n, 77):
        source = int(rng.integers(0, at - 34))
        out[at : at + 34] = out[source : source + 34]
    return _text(out[:n])


def test_p1_found_finds_repeats_that_the_compressor_misses(spark, tmp_path):
    texts = [_far(), _short_copies(), None, "", "12 34 !", "Ala ma kota", "Ala ma kota. " * 20, _text(np.random.default_rng(3).integers(97, 123, 5_000))]
    spark.createDataFrame([Row(row_id=i, text=t) for i, t in enumerate(texts)], "row_id long, text string").write.parquet(str(tmp_path / "corpus.parquet"))
    found = {r.row_id for r in entry.queries()["p1_found"](spark, str(tmp_path)).collect()}
    assert found == {i for i, t in enumerate(texts) if t and _brute(t) >= 0.30}
    assert {0, 1, 6} <= found


def _with_share(rng, kinds, n, share, stretch, weights):
    """n random letters of which about share lies in copies of stretch letters from anywhere before."""
    letters = rng.choice(np.arange(0x4E00, 0x4E00 + kinds, dtype=np.uint32), n, p=weights)
    copies, at = int(share * n / stretch) + 1, max(n // 4, stretch + 1)
    gap = max(0, (n - at - copies * stretch) // copies)
    for _ in range(copies):
        if at + stretch <= n:
            source = int(rng.integers(0, at - stretch))
            letters[at : at + stretch] = letters[source : source + stretch]
            at += stretch + gap
    return letters


def test_the_bands_reject_no_text_with_the_share():
    rng = np.random.default_rng(7)
    seen, left = 0, 0
    for kinds in (9, 16, 24, 60, 200, 900):
        for n in (300, 900, 2_000, 5_000, 20_000, 60_000):
            for stretch in (30, 33, 47, 90):
                for skew in (0.0, 1.0):
                    w = 1.0 / (1 + np.arange(kinds)) ** skew
                    letters = _with_share(rng, kinds, n, 0.34, stretch, w / w.sum())
                    if repetition.repeated_letters(letters) / n >= 0.30:
                        seen += 1
                        left += repetition.compression(letters)[2] not in repetition.MEASURED
    assert seen > 150 and left == 0


def test_plain_texts_are_rejected_unmeasured():
    rng = np.random.default_rng(8)
    w = 1.0 / (1 + np.arange(24))
    bands = {repetition.compression(rng.choice(np.arange(97, 121, dtype=np.uint32), n, p=w / w.sum()))[2] for n in (800, 3_000, 9_000)}
    assert bands <= {"incompressible", "plain"}
    assert repetition.judged("ab" * 9) == (18, 1.0, 1.0, "short", None) and repetition.judged("ab" * 90)[3] == "open"
    assert repetition.judged(None) == (0, None, None, "empty", 0.0)
