import numpy as np
import pytest
from pyspark.sql import functions as F

from whitebrook.functions import vectors as vx
from whitebrook.operators import moments as mo
from whitebrook.operators import retrieval
from whitebrook.operators import whitening as wh


def frame(spark, x, partitions=3):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r], "clash") for i, r in enumerate(x)], "vec_id long, embedding array<float>, n string").repartition(partitions)


@pytest.fixture
def stretched():
    return (np.random.default_rng(2).normal(0, 1, (400, 6)) * [1, 2, 3, 1, 1, 2] + [1, 0, 0, 0, 0, 0]).astype(np.float32)


def unit(x):
    x = np.asarray(x, np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@pytest.mark.parametrize("tile, fan", [(512, 64), (2, 1), (4, 2)])
def test_moments_equal_numpy_however_they_are_tiled(spark, stretched, monkeypatch, tile, fan):
    monkeypatch.setattr(mo, "TILE", tile)
    monkeypatch.setattr(mo, "FAN", fan)
    x = np.vstack([stretched, np.zeros((3, 6), np.float32)])
    for dims, tasks in (((None, 3), None), ((5,), 2)):
        for dim, m in zip(dims, mo.moments(frame(spark, [*x, None], 7), dims, tasks=tasks)):
            u = unit(x[:, :dim])
            assert m[0] == len(x) and np.allclose(m[1], u.mean(axis=0), atol=1e-12) and np.allclose(mo.covariance(m), np.cov(u.T), atol=1e-12)
    n, mean, _ = mo.moments(frame(spark, x), exclude_zero=True)[0]
    assert n == 400 and np.allclose(mean, unit(stretched).mean(axis=0))


def test_relational_moments_and_whitening_equal_the_others(spark, stretched):
    df = frame(spark, [*stretched, None, np.zeros(6)])
    u = unit(np.vstack([stretched, np.zeros((1, 6))]))
    assert np.allclose([r.m for r in mo.mean_cells(df).orderBy("i").collect()], u.mean(axis=0))
    got = {(r.i, r.j): r.v for r in mo.covariance_cells(df, 6).collect()}
    assert np.allclose([got[i, j] for i in range(6) for j in range(i, 6)], np.cov(u.T)[np.triu_indices(6)])
    bg = wh.fit(df, 4)
    a, b = (np.array([r.z for r in f(df, bg).orderBy("vec_id").collect()]) for f in (wh.whiten, wh.whiten_columns))
    assert a.shape == (401, 4) and np.allclose(a, b, atol=1e-4)


def test_whitened_covariance_is_the_identity_and_search_is_exact(spark, stretched):
    df = frame(spark, stretched)
    bg = wh.fit(df)
    z = np.array([r.z for r in wh.whiten(df, bg).orderBy("vec_id").collect()], np.float64)
    # unit vectors of six dimensions lie on a sphere, so all six directions vary
    assert np.allclose(np.cov(z.T), np.eye(6), atol=1e-3) and np.allclose(z.mean(axis=0), 0, atol=1e-5)
    asked = df.where("vec_id < 5")
    for block in (2, 100):
        found = {(r.query_id, r["rank"], r.vec_id) for r in retrieval.top_k(df, asked, bg.whiten, block=block).collect()}
        assert found == {(q, k + 1, int(v)) for q in range(5) for k, v in enumerate(np.argsort(-(z[q] @ z.T), kind="stable")[:10])}
    c = unit(z)
    found = {(r.query_id, r.vec_id) for r in retrieval.search(df, asked, bg, 3, cosine=True).collect()}
    assert found == {(q, int(v)) for q in range(5) for v in np.argsort(-(c[q] @ c.T), kind="stable")[:3]}
    assert retrieval.top_k(df, asked.limit(0)).count() == 0 and retrieval.top_k(df.limit(0), asked).count() == 0


def test_ties_go_to_the_smaller_key_and_nulls_to_none(spark):
    df = frame(spark, [[1, 0], [1, 0], None, [1, 0], [0, 1]])
    got = [(r.query_id, r.vec_id, r["rank"]) for r in retrieval.top_k(df, df.where("vec_id in (0, 2)"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0, 1), (0, 1, 2)]


def test_ladder_fits_each_dimension_anew(spark, stretched):
    df = frame(spark, stretched)
    small, full = wh.fit_ladder(df, (3, None))
    assert small.dim == 3 and np.allclose(small.w, wh.fit(df, 3).w, atol=1e-6) and not np.allclose(small.w, full.w[:3, :3], atol=1e-2)
    assert (np.diff(full.eigvals) <= 0).all() and (full.w == full.w.T).all() and full.w.dtype == np.float32


def test_refusals(spark):
    for bad in ([[1.0, 0.0]], [], [None, None]):
        with pytest.raises(ValueError):
            mo.moments(frame(spark, bad))
    for bad, dims in (([[1.0, 0.0], [1.0]], (None,)), ([[1.0, float("nan")], [1.0, 0.0]], (None,)), ([[1.0, 0.0], [0.0, 1.0]], (3,))):
        with pytest.raises(Exception, match="vectors of different lengths|dimension 3"):
            mo.moments(frame(spark, bad, 1), dims)
    with pytest.raises(Exception, match="dimension 3"):
        frame(spark, [[1.0, 0.0]]).select(vx.prefix("embedding", 3)).collect()


def test_diagnostics_count_null_directions():
    cov = np.diag([4.0, 1e-7, 0.0])
    d = wh.diagnostics(wh.assemble((11, np.zeros(3), cov * 10)), native=8)
    assert d["rank_deficient_eigvals"] == 2 and d["rank_full_eigvals"] == 1 and d["mrl_truncated"] and d["eigvals_max"] == 4.0
    assert np.isclose(d["top_ev_ratio_pre"], 3.0) and d["eigvals_top5"][0] == 4.0 and len(d["eigvals_top5"]) == 3


def test_column_functions(spark):
    df = frame(spark, [[3, 4], [0, 0], None, [1, 2**-20]], 1)
    got = df.orderBy("vec_id").select(vx.renorm("embedding").alias("u"), vx.query_renorm("embedding").alias("q"), vx.norm("embedding").alias("n"), vx.dot("embedding", "embedding").alias("d"), vx.half("embedding").alias("h")).collect()
    assert [list(map(float, r.u)) if r.u else None for r in got][:3] == [[0.6, 0.8], [0.0, 0.0], None]
    assert np.allclose(got[0].q, [0.6, 0.8]) and list(got[1].q) == [0.0, 0.0] and [r.n for r in got][:3] == [5.0, 0.0, None]
    assert list(got[3].h) == list(np.array([1, 2**-20], np.float16).astype(np.float32)) and got[2].h is None
    x = df.select(F.explode(vx.inverse_root(F.array(F.lit(0.25)), 0.0)).alias("x")).first().x
    assert x == 2.0


def test_a_background_must_fit(spark, stretched):
    bg = wh.Background(np.eye(6), np.zeros(6), np.ones(6), 2, "b", {"embedding_model": "m", "granularity": "doc"})
    retrieval.check_fit(bg, "m", "doc", 6)
    for args in (("x", "doc", 6), ("m", "chunks", 6), ("m", "doc", 3)):
        with pytest.raises(ValueError, match="does not fit"):
            retrieval.check_fit(bg, *args)
