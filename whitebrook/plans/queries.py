"""The queries of the core, by name; each takes the session and the folder of the tables and reads these whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whitebrook.functions import text as tx
from whitebrook.functions import tokens
from whitebrook.functions import vectors as vx
from whitebrook.operators import chunking, embedding, retrieval
from whitebrook.operators import corpus as co
from whitebrook.operators import moments as mo
from whitebrook.operators import whitening as wh
from whitebrook.plans import catalog
from whitebrook.sources import adapters, tables
from whitebrook.sources.tables import spread, table
from whitebrook.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]

#: The query vectors of the top-k queries: vec_id below this.
ASKED = 5
SEED = 42
TIERS = {"wikipedia": 200, "fineweb": 150, "oasst": 20, "fineweb_more": 100}
CHAR_CAP, WORD_CAP, TAKE, SKIP = 1_000, 100, 60, 40
MODEL = "qwen_qwen3-embedding-8b"
DIM = 64

# --- corpus ---


def scan_projection(spark, d):
    return table(spark, d, "corpus", "row_id", "sha")


def scan_row_count(spark, d):
    return tables.n_rows(table(spark, d, "corpus"))


def null_safe_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.null_safe("text").alias("text"))


def unicode_strip(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.strip("text").alias("text"))


def corpus_filter_min_chars(spark, d):
    return co.long_enough(table(spark, d, "documents", "doc_id", "text")).select("doc_id", F.length("text").alias("n_chars"))


def corpus_char_cap(spark, d):
    kept = co.long_enough(table(spark, d, "documents", "doc_id", "text"), max_chars=CHAR_CAP)
    return kept.select("doc_id", F.length("text").alias("n_chars"), tx.doc_digest("text").alias("sha"))


def corpus_digest(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.doc_digest("text").alias("sha"), tx.chunk_digest("text").alias("sha_full"))


def corpus_fingerprint(spark, d):
    return co.fingerprint(table(spark, d, "corpus", "sha"))


def corpus_fingerprint_tree(spark, d):
    return co.fingerprint_tree(table(spark, d, "corpus", "sha"))


def corpus_lang_filter(spark, d):
    return table(spark, d, "documents", "doc_id", "lang").where(co.lang_gate()).select("doc_id")


def corpus_score_gate(spark, d):
    return table(spark, d, "corpus", "row_id", "language_score").where(co.score_gate()).select("row_id")


def corpus_seeded_order(spark, d):
    return co.seeded_order(table(spark, d, "corpus", "row_id"), SEED).select("row_id", co.seeded(SEED).alias("place"))


def corpus_take_n(spark, d):
    return co.take(table(spark, d, "corpus", "row_id", "source"), TAKE)


def corpus_skip_take(spark, d):
    return co.take(table(spark, d, "corpus", "row_id", "source"), TAKE, SKIP)


def _mixed(spark, d) -> DataFrame:
    return co.mix(adapters.tiers(*TIERS.values()), adapters.sources_of(table(spark, d, "corpus")), SEED)


def corpus_mix_union(spark, d):
    return _mixed(spark, d).select("row_id", "tier", "source", "source_row", "sha", "n_chars")


def corpus_tiers_disjoint(spark, d):
    rows = _mixed(spark, d)
    both = rows.where("tier = 'fineweb'").select("source_row").intersect(rows.where("tier = 'fineweb_more'").select("source_row"))
    return both.agg(F.count(F.lit(1)).alias("n_shared"))


def corpus_mix_counts(spark, d):
    return co.counts(_mixed(spark, d))


def corpus_totals(spark, d):
    return co.totals(_mixed(spark, d))


def corpus_manifest(spark, d):
    return co.manifest(_mixed(spark, d), TIERS, SEED).select(F.to_json("mix_target").alias("mix_target"), F.to_json("mix_actual").alias("mix_actual"), F.to_json("mix_sources").alias("mix_sources"), "seed", "n_total", "n_chars_total", "corpus_fingerprint_sha256")


# --- tokens ---


def doc_word_count(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.n_words("text").alias("n_words"))


def doc_word_truncate(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.first_words("text", WORD_CAP).alias("text"), (tx.n_words("text") > WORD_CAP).alias("capped"))


def token_stats(spark, d):
    return tokens.stats(table(spark, d, "documents", "text").select(tx.n_words("text").alias("n_tokens")), most=WORD_CAP)


def token_truncate_words(spark, d):
    cut = tokens.truncate("text", WORD_CAP, "words")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", cut.alias("c")).select("doc_id", "c.text", "c.n_tokens", "c.capped")


def bpe_token_stats(spark, d):
    return tokens.stats(spread(table(spark, d, "documents", "text")).select(tokens.count("text").alias("n_tokens")), most=512)


def bpe_truncate(spark, d):
    cut = tokens.truncate("text", WORD_CAP)
    return spread(table(spark, d, "documents", "doc_id", "text")).select("doc_id", cut.alias("c")).select("doc_id", "c.n_tokens", "c.capped", F.length("c.text").alias("n_chars"))


# --- pieces ---


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "corpus", "row_id", "text", "sha", "source").withColumn("chunks", F.split("text", "\n"))


def chunk_merge_tiny(spark, d):
    return _lines(spark, d).select("row_id", F.posexplode(chunking.fold_tiny("chunks")).alias("chunk_idx", "text"))


def chunk_strip_fragments(spark, d):
    pieces = F.split(F.regexp_replace("text", r"([.?!] )", "\u0001$1"), "\u0001")
    return table(spark, d, "corpus", "row_id", "text").select("row_id", F.posexplode(chunking.strip_fragments(pieces)).alias("chunk_idx", "text"))


def chunk_explode_idx(spark, d):
    return chunking.enumerate_chunks(_lines(spark, d)).select("row_id", "doc_sha", "chunk_idx", "sha", F.length("text").alias("n_chars"))


def _chunked(spark, d) -> DataFrame:
    return chunking.chunk_documents(spread(table(spark, d, "corpus", "row_id", "source", "text", "sha")), tokenizer="words", size=128, overlap=16)


def chunk_documents(spark, d):
    return _chunked(spark, d)


def chunk_documents_bpe(spark, d):
    return chunking.chunk_documents(spread(table(spark, d, "corpus", "row_id", "source", "text", "sha")))


def chunk_invariants(spark, d):
    """For each document with text whether its pieces are numbered without gaps from 0."""
    per = _chunked(spark, d).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_idx").alias("low"), F.max("chunk_idx").alias("high"), F.countDistinct("chunk_idx").alias("kinds"))
    return per.select("row_id", ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("kinds") == F.col("n"))).alias("dense"))


def chunk_stats(spark, d):
    return chunking.stats(table(spark, d, "chunks", "text", "doc_sha"), table(spark, d, "corpus", "row_id"))


def chunk_parents(spark, d):
    """Pieces with the first row of their text, -1 for pieces of rows that are gone."""
    rows = table(spark, d, "corpus", "row_id", "sha").groupBy("sha").agg(F.min("row_id").alias("row_id")).withColumnRenamed("sha", "doc_sha")
    return table(spark, d, "chunks", "doc_sha", "chunk_idx", "sha").distinct().join(rows, "doc_sha", "left").withColumn("row_id", F.coalesce("row_id", F.lit(-1)))


def distinct_parents(spark, d):
    return chunking.distinct_parents(table(spark, d, "chunks", "doc_sha"))


# --- vectors ---


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding")


def _long(df: DataFrame, vector) -> DataFrame:
    return df.select("vec_id", F.posexplode(vector).alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


def vec_slice(spark, d):
    return _long(_vectors(spark, d), vx.doubles(vx.prefix("embedding", 16)))


def vec_l2_renorm(spark, d):
    return _long(_vectors(spark, d), vx.renorm(vx.prefix("embedding", 32)))


def vec_query_renorm(spark, d):
    return _long(_vectors(spark, d), vx.query_renorm(vx.prefix("embedding", 32)))


def vec_center(spark, d):
    own = mo.cells(_vectors(spark, d))
    return own.join(F.broadcast(mo.mean_cells(_vectors(spark, d))), "i").select("vec_id", "i", (F.round(F.col("v") - F.col("m"), 6) + 0.0).alias("v"))  # the mean is a row a dimension


def vec_zero_guard(spark, d):
    """Vectors whose first component is under 0 set to zero: how many are left by the mask for placeholders, and how long the others are."""
    masked = F.when(F.get("embedding", F.lit(0)) < 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    n = _vectors(spark, d).select(vx.norm(vx.renorm(masked)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_total"), F.sum((F.col("n") > 0).cast("long")).alias("n_kept"), F.round(F.coalesce(F.sum("n"), F.lit(0.0)), 6).alias("length"))


def vec_count(spark, d):
    return _vectors(spark, d).agg(F.count("embedding").alias("n_total"))


def vec_mean(spark, d):
    mean = mo.moments(_vectors(spark, d))[0][1]
    return spark.createDataFrame([(i, round(float(x), 6) + 0.0) for i, x in enumerate(mean)], "i int, m double")


def vec_mean_relational(spark, d):
    return mo.mean_cells(_vectors(spark, d)).select("i", (F.round("m", 6) + 0.0).alias("m"))


def _cells(spark: SparkSession, a: np.ndarray, digits: int = 6, triangle: bool = True) -> DataFrame:
    rows = [(i, j, round(float(a[i, j]), digits) + 0.0) for i in range(len(a)) for j in range(i if triangle else 0, len(a))]
    return spark.createDataFrame(rows, "i int, j int, v double")


def _covariance(spark, d, dim: int | None) -> DataFrame:
    return _cells(spark, mo.covariance(mo.moments(_vectors(spark, d), (dim,))[0]))


def vec_covariance_relational(spark, d):
    return mo.covariance_cells(_vectors(spark, d), 16).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def inv_sqrt_scale(spark, d):
    return table(spark, d, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal > 0").select("s_suppkey", F.round(F.get(vx.inverse_root(F.array("s_acctbal")), F.lit(0)), 9).alias("v"))


# --- whitening ---


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([values])


def _anisotropic(spark, d) -> DataFrame:
    """The vectors stretched by their place and shifted, so that whitening has something to undo."""
    return _vectors(spark, d).withColumn("embedding", F.transform("embedding", lambda x, i: (x * (1 + i / 8.0) + F.when(i < 4, 0.5).otherwise(0.0)).cast("float")))


def zca_trace(spark, d):
    values = np.linalg.eigvalsh(mo.covariance(mo.moments(_vectors(spark, d))[0]))
    return _one(spark, trace=round(float(values.sum()), 6))


def zca_frobenius(spark, d):
    values = np.linalg.eigvalsh(mo.covariance(mo.moments(_vectors(spark, d))[0]))
    return _one(spark, frobenius=round(float((values**2).sum()), 9))


def zca_rank(spark, d):
    e = wh.diagnostics(wh.fit(_vectors(spark, d)))
    return _one(spark, rank_deficient=e["rank_deficient_eigvals"], rank_full=e["rank_full_eigvals"])


def zca_symmetry(spark, d):
    w = wh.fit(_vectors(spark, d)).w
    return _one(spark, n_asymmetric=int((w != w.T).sum()))


def zca_inverse_identity(spark, d):
    m = mo.moments(_vectors(spark, d))[0]
    w = wh.assemble(m).w.astype(np.float64)
    return _cells(spark, w @ (mo.covariance(m) + wh.EPS * np.eye(len(w))) @ w, 5, False)


def zca_spectrum_order(spark, d):
    e = wh.fit(_vectors(spark, d)).eigvals
    return _one(spark, n_ascending=int((np.diff(e) > 0).sum()))


def zca_diagnostics(spark, d):
    row = wh.diagnostics(wh.fit(_anisotropic(spark, d), 32), native=DIM)
    return spark.createDataFrame([{k: v for k, v in row.items() if k not in ("eigvals_top5", "fit_s")} | {f"top_{i + 1}": v for i, v in enumerate(row["eigvals_top5"])}])


def whiten_mean_zero(spark, d):
    df = _anisotropic(spark, d)
    z = wh.whiten(df, wh.fit(df)).select(F.posexplode("z").alias("i", "v"))
    return z.groupBy("i").agg((F.round(F.avg(F.col("v").cast("double")), 4) + 0.0).alias("m"))


def whiten_cov_identity(spark, d):
    df = _anisotropic(spark, d)
    z = wh.whiten(df, wh.fit(df, 16)).select(F.transform("z", lambda x: x.cast("double")).alias("z"))
    places = [(i, j) for i in range(16) for j in range(i, 16)]
    row = z.agg(F.array(*[F.covar_samp(F.get("z", F.lit(i)), F.get("z", F.lit(j))) for i, j in places]).alias("v"))
    return row.select(F.posexplode("v").alias("at", "v")).join(mo._places(spark, places), "at").select("i", "j", (F.round("v", 2) + 0.0).alias("v"))


def whiten_apply(spark, d):
    df = _anisotropic(spark, d)
    return wh.whiten(df, wh.fit(df))


def whiten_ladder(spark, d):
    """Each dimension has a fit of its own, all from one scan: rank and trace of each."""
    found = mo.moments(_vectors(spark, d), (16, 32, None))
    return spark.createDataFrame([(len(m[1]), m[0], round(float(np.trace(mo.covariance(m))), 6)) for m in found], "dim int, n_total long, trace double")


def _top(spark: SparkSession, d: str, prepare) -> DataFrame:
    df = _vectors(spark, d)
    return retrieval.top_k(df, df.where(F.col("vec_id") < ASKED), prepare).withColumn("score", F.round("score", 6))


def topk_raw_dot(spark, d):
    return _top(spark, d, lambda x: x)


def topk_raw_cosine(spark, d):
    return _top(spark, d, mo.renorm)


def topk_whitened(spark, d):
    return _top(spark, d, wh.fit(_vectors(spark, d)).whiten)


# --- embedding, usage ---


def _done(spark, d) -> DataFrame:
    return table(spark, d, "embed_index", "row_id", "skipped", "model_slug").where(F.col("model_slug") == MODEL).where(~F.coalesce("skipped", F.lit(False)))


def embed_resume_antijoin(spark, d):
    return embedding.remaining(table(spark, d, "corpus", "row_id", "sha"), _done(spark, d))


def embed_rows_covered(spark, d):
    return table(spark, d, "embed_index", "row_id", "model_slug").groupBy("model_slug").agg(F.countDistinct("row_id").alias("rows_covered"))


def embed_placeholder_fill(spark, d):
    done = _vectors(spark, d).withColumnRenamed("vec_id", "row_id")
    filled = embedding.fill(table(spark, d, "corpus", "row_id"), done)
    return filled.select("row_id", "skipped", F.size("embedding").alias("dim"), F.round(vx.norm("embedding"), 4).alias("length"))


def embed_attach_meta(spark, d):
    return embedding.attach(_vectors(spark, d).select(F.col("vec_id").alias("row_id"), F.size("embedding").alias("dim")), table(spark, d, "corpus"))


def embed_hashing(spark, d):
    got = _embedded(spark, d)
    return got.groupBy("dim", "unit").agg(F.count(F.lit(1)).alias("n"))


def _embedded(spark, d) -> DataFrame:
    rows = spread(table(spark, d, "corpus", "row_id", "sha", "source", "text"))
    return embedding.vectors(embedding.embed_rows(rows, embedding.HashingEmbedder(DIM))).select("row_id", F.size("embedding").alias("dim"), (F.abs(vx.norm("embedding") - 1) < 1e-5).alias("unit"))


def usage_rollup(spark, d):
    return embedding.usage(table(spark, d, "cost_report")).withColumn("cost_usd", F.round("cost_usd", 6))


def usage_running_total(spark, d):
    return embedding.running_usage(table(spark, d, "cost_report"), "prompt_tokens", "flushed_at", "report_id")


def usage_windows(spark, d):
    return refresh.usage_windows(table(spark, d, "cost_report")).withColumn("cost_usd", F.round("cost_usd", 6))


def http_status_classify(spark, d):
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"data": []}').when(k == 1, F.format_string('{"error": {"code": %d}}', F.col("event_id") % 600)).when(k == 2, F.format_string('{"code": "%d"}', F.col("event_id") % 600)).otherwise('{"error": {"code": "busy"}}')
    status = F.when(F.col("event_id") % 5 == 0, 400 + F.col("event_id") % 130).otherwise(200)
    return table(spark, d, "events", "event_id").select("event_id", tx.http_status(status.cast("int"), body).alias("status"))


# --- names, registry ---


def _models(spark, d) -> DataFrame:
    return table(spark, d, "nation", "n_nationkey", "n_name").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.format_string("qwen/qwen3-embedding-%db", F.col("n_nationkey"))).otherwise(F.format_string("open/%s:free", F.col("n_name"))).alias("model"))


def model_slug(spark, d):
    return _models(spark, d).select("n_nationkey", tx.model_slug("model").alias("slug"), tx.short_model("model").alias("short"))


def background_name(spark, d):
    return _models(spark, d).select("n_nationkey", tx.background_name("model", "pl_mixed_doc", 512).alias("name"))


def csv_options(spark, d):
    text = F.when(F.col("n_nationkey") % 3 == 0, F.lit(" , ")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit(" a ,,"), F.col("n_name"), F.lit(" ")))
    return table(spark, d, "nation", "n_nationkey", "n_name").select("n_nationkey", F.array_join(tx.csv_options(text), "|").alias("found"))


def registry_sorted(spark, d):
    rows = table(spark, d, "part", "p_name", "p_size", "p_brand").select(F.col("p_brand").alias("embedding_model"), F.col("p_size").alias("dim"), F.col("p_name").alias("name")).distinct()
    return catalog.ordered(rows)


def registry_formats(spark, d):
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey") * 997), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n = F.when(F.col("p_partkey") % 7 != 0, F.pow(F.col("p_partkey").cast("double"), 3.0).cast("long"))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", tx.size_text(n).alias("size"), tx.time_text(F.when(F.col("p_partkey") % 5 == 0, "some time ago, unknown").otherwise(stamp)).alias("built"), tx.cap_text(F.col("p_size") - 1).alias("cap"))


def registry_coalesce(spark, d):
    zero = F.nullif("p_size", F.lit(3)) % 4
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", tx.falsy_coalesce(zero, F.col("p_size") * 10).alias("parity"), F.coalesce(zero, F.col("p_size") * 10).alias("plain"))


def cost_attach_left(spark, d):
    slugs = table(spark, d, "nation", "n_nationkey").select("n_nationkey", F.when(F.col("n_nationkey") == 1, MODEL).when(F.col("n_nationkey") == 2, "qwen_qwen3-embedding-4b").otherwise("none").alias("model_slug"))
    found = catalog.attach_cost(slugs, embedding.usage(table(spark, d, "cost_report")))
    about = catalog.attach_corpus(found, co.totals(table(spark, d, "corpus", "n_chars")))
    known = [F.coalesce(F.col(f"embedding_cost.{c}"), F.lit(-1)).alias(c) for c in ("prompt_tokens", "n_calls")]
    return about.select("n_nationkey", *known, "n_total")


def queries() -> dict[str, Query]:
    mine = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"}
    return mine | {"vec_covariance": partial(_covariance, dim=None), "vec_covariance_mrl16": partial(_covariance, dim=16), "vec_covariance_mrl32": partial(_covariance, dim=32)}
