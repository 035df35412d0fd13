"""The schemas of every table that is read or written; none is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

_KINDS = {
    "string": StringType(),
    "bigint": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "binary": BinaryType(),
    "vector": ArrayType(FloatType()),
    "doubles": ArrayType(DoubleType()),
    "ints": ArrayType(IntegerType()),
    "strings": ArrayType(StringType()),
    "counts": MapType(StringType(), LongType()),
}


def of(text: str, **more) -> StructType:
    """A schema from "name kind, ..." and further fields; unlike DDL it needs no session."""
    return StructType([*(StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(", "))), *(StructField(n, t) for n, t in more.items())])


RAW = of("row_id bigint, source string, text string, lang string, language_score double")
CORPUS = of("row_id bigint, source string, text string, sha string, n_chars bigint")
CHUNKS = of("row_id bigint, text string, doc_sha string, chunk_idx int, source string, sha string")
EMBEDDED = of("row_id bigint, sha string, source string, skipped boolean, embedding vector")
SKIPS = of("row_id bigint, sha string, source string, n_chars bigint, reason string")
LEDGER = of("model_slug string, call_id string, prompt_tokens bigint, total_tokens bigint, cost_usd double, n_retried bigint, n_429 bigint")
MANIFEST = of("mix_target counts, mix_actual counts, mix_sources counts, seed int, max_chars_per_doc int, n_total bigint, n_chars_total bigint, corpus_fingerprint_sha256 string")
COST = of("prompt_tokens bigint, total_tokens bigint, cost_usd double, n_calls bigint, n_retried bigint, n_429 bigint")
DIAGNOSTICS = of(
    "n_total bigint, eps double, dim int, native_dim int, mrl_truncated boolean, rank_deficient_eigvals int, rank_full_eigvals int, top_ev_ratio_pre double, "
    "eigvals_min double, eigvals_median double, eigvals_max double, eigvals_top5 doubles, fit_s double"
)
META = of(
    "name string, granularity string, created_at string, purpose string, language string, embedding_model string, embedding_dim int, max_chars_per_doc int, embedding_endpoint string, provider string, "
    "build_script string, notes strings, fit_fingerprint_sha256 string, corpus_fingerprint_sha256 string, sample_size_actual counts",
    diagnostics=DIAGNOSTICS,
    embedding_cost=COST,
)
#: One row for each fitted background: the arrays as little-endian float32, the meta record beside them.
BACKGROUNDS = of("name string, granularity string, model string, dim int, w binary, mu binary, eigvals binary", meta=META)
REGISTRY = of(
    "name string, dim int, embedding_model string, provider string, max_chars_per_doc int, language string, created_at string, n_fit bigint, rank_full int, rank_deficient int, top_ev_ratio_pre double, "
    "eigvals_max double, eigvals_min double, fit_s double, embedding_cost_usd double, embedding_tokens bigint, corpus_fingerprint string, build_script string, path string, "
    "W_shape ints, mu_shape ints, eigvals_shape ints, size_bytes bigint"
)
#: What the connector gives: kind "row" or "call".
RESULT = of(
    "kind string, row_id bigint, sha string, source string, embedding vector, skipped boolean, n_chars bigint, reason string, "
    "call_id string, prompt_tokens bigint, total_tokens bigint, cost_usd double, n_retried bigint, n_429 bigint"
)
#: Partial moments: a tile of the upper triangle.
PARTIAL = of("i int, a int, b int, lot int, n bigint, mean_a binary, mean_b binary, m2 binary")
