import json

import numpy as np
import pytest

from whitebrook.operators import embedding as em
from whitebrook.operators import moments as mo
from whitebrook.operators import whitening as wh
from whitebrook.plans import catalog, pipeline
from whitebrook.schemas import BACKGROUNDS, META, RAW
from whitebrook.streaming import refresh


def raw(spark, path):
    rows = [(i, ("wikipedia", "fineweb", "oasst")[i % 3], f"Dokument {i}. " + "Zdanie o czymś, co ma wiele słów. " * (20 + i % 5), "pl", None) for i in range(60)]
    spark.createDataFrame(rows, RAW).write.parquet(path)


@pytest.mark.parametrize("granularity", ["doc", "chunks"])
def test_run_and_run_again(spark, tmp_path, granularity):
    raw(spark, str(tmp_path / "raw"))
    argv = ["--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "out"), "--wiki", "15", "--fineweb", "10", "--oasst", "9", "--fineweb-more", "8", "--dims", "8, 16,", "--granularity", granularity, "--tokenizer", "words", "--chunk-size", "40", "--chunk-overlap", "5", "--max-tokens", "60", "--env", str(tmp_path / "none"), "--start-batch", "4"]
    cfg = pipeline.config(argv)
    assert cfg.dims == (8, 16) and cfg.controller.batch == 4
    first = {r.name: r for r in pipeline.run_pipeline(spark, cfg).collect()}
    assert first.keys() == {f"qwen3_4b_pl_mixed_{granularity}_mrl{d}" for d in (8, 16)}
    row = first[f"qwen3_4b_pl_mixed_{granularity}_mrl8"]
    n = row.n_fit
    assert (n == 42 if granularity == "doc" else n > 60) and row.W_shape == [8, 8] and row.size_bytes == 4 * (64 + 8 + 8) and row.rank_full + row.rank_deficient == 8 and row.embedding_tokens > 0
    assert json.loads(spark.read.text(str(tmp_path / "out/registry.json")).first()[0])["backgrounds"][0]["name"].endswith("mrl16")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/registry.md")).collect())
    assert "| `qwen/qwen3-embedding-4b` | 8 |" in text and text.index("_mrl8`") < text.index("_mrl16`")
    again = {r.name: r for r in pipeline.run_pipeline(spark, cfg).collect()}
    assert again == first  # nothing is embedded or fitted twice
    store = catalog.Store(spark, cfg.path("backgrounds"))
    meta = store.load(row.name).meta
    assert meta["granularity"] == granularity and (meta["fit_fingerprint_sha256"] == meta["corpus_fingerprint_sha256"]) == (granularity == "doc") and sum(meta["sample_size_actual"].values()) == n


def background(seed=0, dim=4):
    x = np.random.default_rng(seed).normal(size=(50, dim))
    return wh.assemble(mo.of(mo.renorm(x)))


def test_store(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "store"))
    bg = background()
    for name, dim in (("m_doc_mrl512", 4), ("m_doc_mrl1024", 4)):
        store.save(bg, catalog.meta_of(bg, name=name, granularity="doc", model="m", native_dim=8, notes=["n"]))
    store.save(background(1), catalog.meta_of(background(1), name="m_doc_mrl512", granularity="doc", model="m", native_dim=8))  # replaces its own only
    assert store.names() == ["m_doc_mrl1024", "m_doc_mrl512"]
    got = store.load("m_doc_mrl1024")
    assert (got.w == bg.w).all() and (got.mu == bg.mu).all() and (got.eigvals == bg.eigvals).all() and got.n == 50 and got.meta["notes"] == ["n"]
    with pytest.raises(KeyError, match="there are m_doc_mrl1024, m_doc_mrl512"):
        store.load("nope")
    with pytest.raises(ValueError, match="colour"):
        catalog.meta_of(bg, name="x", granularity="doc", model="m", native_dim=8, colour="red")
    store.export_numpy("m_doc_mrl512", str(tmp_path / "npy"))
    (tmp_path / "npy" / "broken").mkdir()
    np.save(tmp_path / "npy" / "broken" / "mu_A.npy", np.zeros(3))  # no W: no background
    other = catalog.Store(spark, str(tmp_path / "other"))
    other.import_numpy(str(tmp_path / "npy"), "doc")
    assert other.names() == ["m_doc_mrl512"] and (other.load("m_doc_mrl512").w == background(1).w).all()


def test_registry_of_sparse_records(spark):
    meta = {c: None for c in META.names} | {"name": "b", "diagnostics": {c: None for c in META["diagnostics"].dataType.names} | {"rank_deficient_eigvals": 0, "top_ev_ratio_pre": 2.0}}
    rows = [("a", "doc", None, 2, b"x" * 16, None, None, None), ("b", "doc", "m", 2, b"x" * 16, b"y" * 8, None, meta)]
    df = spark.createDataFrame(rows, BACKGROUNDS)
    plain, parity = ({r.name: r for r in catalog.registry(df, p).collect()} for p in (False, True))
    assert plain["b"].rank_deficient == 0 and parity["b"].rank_deficient is None and plain["b"].size_bytes == 24 and plain["a"].mu_shape is None and plain["a"].dim == 2
    text = catalog.registry_markdown(catalog.registry(df))
    assert "| `b` | `—` | 2 | no cap | ? | 0 | 2.0 | 24 B | — | — |" in text and "rank full/def.: — / —" in text
    assert "backgrounds: **0**" in catalog.registry_markdown(catalog.registry(df.limit(0)))
    assert json.loads(catalog.registry_json(catalog.registry(df)).first()[0])["backgrounds"][0]["provider"] is None


def test_stream_of_vectors_is_folded_once(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(30, 4)).astype(np.float32)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for i in range(0, 30, 10):
        spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(i, i + 10)], "vec_id long, embedding array<float>").coalesce(1).write.mode("append").parquet(source)
    fold = refresh.fold_into(state)
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    n, mean, m2 = refresh.state(spark, state)
    u = mo.renorm(x.astype(np.float64))
    assert n == 30 and np.allclose(mean, u.mean(axis=0)) and np.allclose(m2 / 29, np.cov(u.T))
    last = spark.read.parquet(f"{state}/batch=2").first().n
    fold(spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])] * last, "vec_id long, embedding array<float>"), 2)  # a replay replaces
    assert refresh.state(spark, state)[0] == 30
    refresh.compact(spark, state)
    fold(spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>"), 1)  # before the compacted state: counts already
    assert refresh.state(spark, state)[0] == 30
    fold(spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>"), 3)
    fold(spark.createDataFrame([], "vec_id long, embedding array<float>"), 4)
    assert refresh.state(spark, state)[0] == 31 and refresh.refit(spark, state).dim == 4
    with pytest.raises(ValueError):
        refresh.refit(spark, str(tmp_path / "none"))


def test_usage_windows_stream(spark, tmp_path):
    rows = [(1, "m", 10, 1, 0.5, 1, "2025-01-01 10:00:00"), (1, "m", 10, 1, 0.5, 1, "2025-01-01 10:00:00"), (2, "m", None, 1, 0.5, 2, "2025-01-01 23:00:00"), (3, "n", 4, 4, 0.0, 1, "2025-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "report_id int, model_slug string, prompt_tokens long, total_tokens long, cost_usd double, n_calls long, t string").selectExpr("* except (t)", "cast(t as timestamp) as flushed_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = refresh.usage_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {("m", 3, 10), ("n", 1, 4)}
    assert {(r.model_slug, r.n_calls, r.prompt_tokens) for r in spark.table("windows").collect()} == want
    assert {(r.model_slug, r.n_calls, r.prompt_tokens) for r in refresh.usage_windows(df).collect()} == want


def test_resume_sends_only_what_is_left(spark, tmp_path):
    raw(spark, str(tmp_path / "raw"))
    cfg = pipeline.Config(str(tmp_path / "raw"), str(tmp_path / "out"), wiki=5, fineweb=5, oasst=5, fineweb_more=5)
    corpus = pipeline.items(spark, cfg)
    base = cfg.path("doc/qwen_qwen3-embedding-4b")
    pipeline.sinks.rolling(em.vectors(em.embed_rows(corpus.where("row_id < 12"), cfg.embedder)), f"{base}/vectors", pipeline.EMBEDDED)
    assert pipeline.embed(spark, cfg).where("not skipped").count() == 20
    assert sum(1 for _ in (tmp_path / "out/doc/qwen_qwen3-embedding-4b/runs").iterdir()) == 1
    assert spark.read.json(f"{base}/ledger").selectExpr("sum(split(call_id, ':')[1])").first()[0] == 8


def test_the_package_can_be_sent_to_the_executors(spark):
    import whitebrook

    whitebrook.ship(spark)
    assert any(f.endswith("whitebrook.zip") for f in spark.sparkContext.listFiles)
