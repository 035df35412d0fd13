import itertools
import random
import re

import numpy as np
import pytest

from whitebrook.llm import neardup


def brute(rows, threshold, words):
    def sets(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(*(w[i:] for i in range(words))))

    num, den = threshold
    want = set()
    for (i, a), (j, b) in itertools.combinations(sorted(set(rows)), 2):
        x, y = sets(a), sets(b)
        if a == b or (x | y and den * len(x & y) >= num * len(x | y)):
            want.add((i, j))
    return want


def corpus(seed, n=60):
    """Texts that share a hot beginning, with edits, insertions and moved parts."""
    rng = random.Random(seed)
    hot = [f"wspolne{i}" for i in range(12)]
    texts = []
    for _ in range(n // 6):
        own = [f"s{rng.randrange(400)}" for _ in range(rng.randrange(15, 60))]
        base = hot + own if rng.random() < 0.6 else own
        for k in range(6):
            other = list(base)
            for _ in range(k):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = [f"z{rng.randrange(50)}"]
            if k == 5:
                half = len(other) // 2
                other = other[half:] + other[:half]
            texts.append(" ".join(other))
    return texts + texts[:3] + ["a b", "a b", ""]


@pytest.mark.parametrize("threshold, words", [((3, 5), 3), ((4, 5), 5), ((1, 2), 2)])
def test_pairs_equal_brute_force_over_many_lots_and_buckets(spark, monkeypatch, threshold, words):
    monkeypatch.setattr(neardup, "LOT", (7, 7))
    monkeypatch.setattr(neardup, "BUCKET", 100)
    rows = [(f"k{i:03}", t) for i, t in enumerate(corpus(words))]
    layout = neardup._Lots(len(rows), sum(len(t) for _, t in rows))
    assert layout.lots > 5 and layout.bucket_bits > 2
    df = spark.createDataFrame([*rows, *rows[:9], (None, rows[0][1]), ("null", None)], "key string, text string").repartition(5)
    got = [tuple(r) for r in neardup.row_pairs(df, "key", "text", threshold, words).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold, words)
    groups = {r.key: (r.class_id, r.group_id, r.n_links) for r in neardup.groups(df, "key", "text", threshold, words).collect()}
    links = brute(rows, threshold, words)
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert groups == {k: (min(j for j, u in rows if u == t), root(k), sum(k in pair for pair in links)) for k, t in rows}


def test_packing_and_counts():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 40, 5_000, dtype=np.uint64))
    counts = rng.integers(1, 65536, len(values))
    v, c = neardup._unpack(neardup._pack(values, counts))
    assert (v == values).all() and (c == counts).all()
    lots = neardup._Lots(10**6, 3 * 10**9)
    runs = rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)
    distinct, place, _ = lots.counted(np.concatenate([runs, runs[:10]]))
    buckets, starts = lots.cuts(distinct)
    assert len(distinct) <= 10_000 and (np.diff(buckets) > 0).all() and starts[-1] == len(distinct) and (distinct[place] == np.concatenate([runs, runs[:10]]) >> lots.shift).all()


def test_prefixes_of_similar_sets_share_what_both_ask_for():
    rng = random.Random(9)
    for _ in range(400):
        universe = list(range(60))
        a = set(rng.sample(universe, rng.randrange(5, 40)))
        b = set(a)
        for _ in range(rng.randrange(0, 12)):
            b ^= {rng.choice(universe)}
        if not b or 5 * len(a & b) < 3 * len(a | b):
            continue
        df = {x: rng.choice([2, 3, 50, 4000]) if x in a & b else rng.choice([1, 2, 300]) for x in a | b}
        made = []
        for s in (a, b):
            runs = np.array(sorted(s), np.uint64)
            made.append(neardup.prefix(runs, neardup.level_of(np.array([df[int(x)] for x in runs])), 3, 5))
        (p, k), (q, m) = made
        assert len(set(p.tolist()) & set(q.tolist())) >= min(k, m)
