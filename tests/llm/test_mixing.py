import math

import pytest

from whitebrook.llm import mixing


@pytest.mark.parametrize("mean, cap", [(0.0, 3), (0.2, 1), (0.9, 1), (2.5, 4), (3.999, 4), (30.0, 1000), (800.0, 1000), (999.5, 1000), (1200.0, 5000)])
def test_the_cut_off_mean_is_the_wanted_one(mean, cap):
    below = mixing.replication(mean, cap)
    assert len(below) == cap and all(a <= b for a, b in zip(below, below[1:])) and below[-1] <= 1
    got = sum(k * (b - a) for k, a, b in zip(range(cap), [0.0, *below], below)) + cap * (1 - below[-1])
    assert math.isclose(got, mean, rel_tol=1e-6, abs_tol=1e-6)


def test_no_table_means_the_cap():
    assert mixing.replication(5.0, 5) == mixing.replication(9.0, 5) == mixing.replication(1.0, 0) == []


def frames(spark, n=4000):
    docs = [(i, "treść" if i % 5 else None, (" A ", "a", "b", "c", None)[i % 5], 10 + i % 3, "clash") for i in range(n)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens long, copy string").repartition(7)
    targets = spark.createDataFrame([("a", 0.5, 3), ("B ", 0.3, 2), ("c", 0.1, 1), ("d", 0.1, 5), (None, 0.1, 1), ("e", None, None)], "source string, target_weight double, max_repeats int")
    return documents, targets


def test_plan_mix_and_shares(spark):
    documents, targets = frames(spark)
    counts = documents.select("doc_id", "source", "n_tokens")
    plan = {r.source: r for r in mixing.plan(counts, targets).collect()}
    total = sum(10 + i % 3 for i in range(4000))
    assert plan.keys() == {"a", "B ", "c", "d", "e"} and {r.total_tokens for r in plan.values()} == {total}
    assert math.isclose(plan["a"].mean_repeats, 0.5 * total / plan["a"].n_tokens) and plan["d"].n_tokens == 0 and not plan["d"].reachable and plan["e"].reachable
    used = mixing.mix(documents, counts, targets)
    rows = used.collect()
    assert used.columns == ["doc_id", "source", "copy", "text"] and {r.source for r in rows} == {"a", "b", "c"}
    again = mixing.mix(documents.repartition(2), counts, targets)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    assert max(r.copy for r in rows if r.source == "b") <= 2 and all(r.copy == 1 for r in rows if r.source == "c")
    assert all((r.text is None) == (r.doc_id % 5 == 0) for r in rows)
    shares = {r.source: r for r in mixing.shares(counts, targets).collect()}
    tokens = {s: sum(10 + r.doc_id % 3 for r in rows if r.source == s) for s in "abc"}
    for name, key in (("a", "a"), ("B ", "b"), ("c", "c")):
        r = shares[name]
        assert r.n_tokens_used == tokens[key] and math.isclose(r.actual_share, tokens[key] / sum(tokens.values())) and math.isclose(r.share_of_total, tokens[key] / total)
        assert abs(r.n_tokens_used - r.planned_tokens) <= 4 * r.standard_error + 1
    assert shares["d"].n_uses == 0 and shares["e"].planned_tokens == 0


def test_empty_tables(spark):
    documents, targets = frames(spark, 10)
    none = documents.limit(0)
    assert {r.source: r.reachable for r in mixing.plan(none, targets).collect()} == {"a": True, "B ": True, "c": True, "d": True, "e": True}
    assert mixing.mix(none, none, targets).count() == 0 and mixing.mix(documents, documents, targets.limit(0)).count() == 0
    assert mixing.shares(documents, targets.limit(0)).count() == 0
    assert all(r.actual_share == 0 for r in mixing.shares(none, targets).collect())
