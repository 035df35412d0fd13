"""The k best vectors of a table for each query vector, by dot product."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import matrix
from .whitening import Background

K = 10
#: Query vectors that are broadcast at once.
BLOCK = 8_192


def top_k(df: DataFrame, queries: DataFrame, prepare: Callable[[np.ndarray], np.ndarray] = lambda x: x, k: int = K, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, key, rank, score): the k highest dot products, ties by key, for each query.

    prepare is applied to both sides. Queries go out in blocks of a fixed number, each with a scan
    of its own, so neither the driver nor a broadcast grows with them. A batch keeps its own k best,
    so k rows a query and batch are shuffled. A query that stands in the table is found too. Null
    vectors are in no result.
    """
    kind = dict(df.dtypes)[key]
    asked = queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator()
    near = None
    while rows := list(islice(asked, block)):
        part = _near(df, rows, prepare, k, key, vector, kind)
        near = part if near is None else near.unionByName(part)
    if near is None:
        return df.select(F.col(key).alias("query_id"), key, F.lit(1).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "rank", "score")


def _near(df: DataFrame, rows: list, prepare, k: int, key: str, vector: str, kind: str) -> DataFrame:
    known = df.sparkSession.sparkContext.broadcast(([r[0] for r in rows], prepare(np.array([r[1] for r in rows], np.float64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            scores = q @ prepare(matrix(batch.column(1))).astype(np.float64).T
            best = [np.lexsort((keys, -s))[:k] for s in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, [len(b) for b in best])), pa.array(np.concatenate([keys[b] for b in best])), pa.array(np.concatenate([s[b] for s, b in zip(scores, best)]))],
                names=["query_id", key, "score"],
            )

    return df.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query_id {kind}, {key} {kind}, score double")


def check_fit(bg: Background, model: str, granularity: str, dim: int) -> None:
    """Raise unless a background may be used for vectors of that model, granularity and dimension."""
    wanted = {"embedding_model": model, "granularity": granularity, "embedding_dim": dim}
    found = {c: bg.meta.get(c) for c in ("embedding_model", "granularity")} | {"embedding_dim": bg.dim}
    wrong = [f"{c} is {found[c]!r}, not {v!r}" for c, v in wanted.items() if found[c] != v]
    if wrong:
        raise ValueError(f"background {bg.name!r} does not fit: {'; '.join(wrong)}")


def search(df: DataFrame, queries: DataFrame, bg: Background, k: int = K, cosine: bool = False, **names) -> DataFrame:
    """top_k of whitened vectors; by dot product, or by cosine with whitened vectors scaled once more."""

    def prepare(x: np.ndarray) -> np.ndarray:
        z = bg.whiten(x)
        if not cosine:
            return z
        n = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(n > 0, n, 1.0)

    return top_k(df, queries, prepare, k, **names)
