"""Mean and covariance of vectors at any prefix dimension, in a single distributed pass.

Each task streams over its vectors and gives (n, mean, M2) for each dimension, cut into tiles of the
upper triangle; tiles are merged by Chan's formula on the executors in two levels, so the driver gets
one merged tile for each place, 8 * d * d / 2 bytes in all, whatever the number of rows or tasks.
A vector is cut to the dimension and scaled to unit length first (zero vectors stay zero and count,
unless exclude_zero). Steps are in float64. Null vectors are left out; vectors of different lengths
or with null or NaN elements raise, as do fewer than two vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from whitebrook.functions import vectors as vx
from whitebrook.schemas import PARTIAL

Moments = tuple[int, np.ndarray, np.ndarray]

TILE = 512
#: Partials are merged in lots of about this many before the last merge.
FAN = 64
_ARROW = to_arrow_schema(PARTIAL)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, which must be of one length and without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = len(flat) // len(column)
    if not (np.asarray(column.value_lengths()) == dim).all() or np.isnan(flat).any():
        raise ValueError("vectors of different lengths, or with null or NaN elements")
    return flat.reshape(len(column), dim)


def renorm(x: np.ndarray, dim: int | None = None) -> np.ndarray:
    """Rows cut to dim and scaled to unit length; zero rows stay zero."""
    if dim is not None and dim > x.shape[1]:
        raise ValueError(f"dimension {dim} is more than the native {x.shape[1]}")
    x = x[:, :dim]
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def merge(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * (a[0] * b[0] / n)


def _merge_tiles(table: pa.Table) -> pa.Table:
    """The tiles of one place as one; the mean over the rows and that over the columns go along."""
    n, left, right, m2 = 0, None, None, None
    for count, p, q, m in zip(*(table[c].to_pylist() for c in ("n", "mean_a", "mean_b", "m2"))):
        p, q = np.frombuffer(p), np.frombuffer(q)
        m = np.frombuffer(m).reshape(len(p), len(q))
        if m2 is None:
            n, left, right, m2 = count, p, q, m
            continue
        total, da, db = n + count, p - left, q - right
        m2 = m2 + m + np.outer(da, db) * (n * count / total)
        left, right, n = left + da * (count / total), right + db * (count / total), total
    first = table.slice(0, 1)
    columns = [first["i"].cast(pa.int32()), first["a"].cast(pa.int32()), first["b"].cast(pa.int32()), pa.array([-1], pa.int32()), pa.array([n], pa.int64())]
    return pa.table([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in (left, right, m2))], schema=_ARROW)


def moments(df: DataFrame, dims: tuple[int | None, ...] = (None,), vector: str = "embedding", exclude_zero: bool = False, tasks: int | None = None) -> list[Moments]:
    """(n, mean, M2) for each of dims; None is the native dimension. One scan serves all of dims.

    tasks bounds how many tasks scan, and so how many partials there are; a task streams whatever it gets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known: list[Moments | None] = [None] * len(dims)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            if exclude_zero:
                x = x[np.any(x != 0, axis=1)]
            for i, dim in enumerate(dims if len(x) else ()):
                own = of(renorm(x, dim))
                known[i] = own if known[i] is None else merge(known[i], own)
        lot = TaskContext.get().partitionId() // FAN
        for i, m in enumerate(known):
            for a in range(0, len(m[1]) if m else 0, TILE):
                for b in range(a, len(m[1]), TILE):
                    p, q = slice(a, a + TILE), slice(b, b + TILE)
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((i, a, b, lot, m[0], m[1][p].tobytes(), m[1][q].tobytes(), np.ascontiguousarray(m[2][p, q]).tobytes()), _ARROW)], schema=_ARROW)

    rows = df.where(F.col(vector).isNotNull()).select(vector)
    if tasks:
        rows = rows.coalesce(tasks)
    tiles = rows.mapInArrow(run, PARTIAL)
    merged = tiles.groupBy("i", "a", "b", "lot").applyInArrow(_merge_tiles, PARTIAL).groupBy("i", "a", "b").applyInArrow(_merge_tiles, PARTIAL)
    parts: list[list] = [[] for _ in dims]
    for r in merged.toLocalIterator():  # d * d / TILE² / 2 tiles for each of dims
        parts[r.i].append(r)
    out = []
    for found in parts:
        if not found or found[0].n < 2:
            raise ValueError("a covariance needs two vectors at least")
        d = max(r.b + len(r.mean_b) // 8 for r in found)
        mean, m2 = np.zeros(d), np.zeros((d, d))
        for r in found:
            p, q = np.frombuffer(bytes(r.mean_a)), np.frombuffer(bytes(r.mean_b))
            block = np.frombuffer(bytes(r.m2)).reshape(len(p), len(q))
            mean[r.a : r.a + len(p)] = p
            m2[r.a : r.a + len(p), r.b : r.b + len(q)] = block
            m2[r.b : r.b + len(q), r.a : r.a + len(p)] = block.T
        out.append((found[0].n, mean, m2))
    return out


def covariance(m: Moments) -> np.ndarray:
    return m[2] / (m[0] - 1)


# --- the same in plain DataFrame operations, for small dimensions ---


def cells(df: DataFrame, dim: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, i, v): the elements of each vector, cut and scaled."""
    x = F.col(vector) if dim is None else vx.prefix(vector, dim)
    return df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vx.renorm(x)).alias("i", "v"))


def mean_cells(df: DataFrame, dim: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return cells(df, dim, key, vector).groupBy("i").agg(F.avg("v").alias("m"))


def covariance_cells(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """(i, j, v) of the upper triangle by one aggregation without a join: dim * (dim + 1) / 2 covariances."""
    x = df.where(F.col(vector).isNotNull()).select(vx.renorm(vx.prefix(vector, dim)).alias("x"))
    places = [(i, j) for i in range(dim) for j in range(i, dim)]
    sums: list[Column] = [F.covar_samp(F.get("x", F.lit(i)), F.get("x", F.lit(j))) for i, j in places]
    row = x.agg(F.array(*sums).alias("v"))
    return row.select(F.posexplode("v").alias("at", "v")).join(_places(df.sparkSession, places), "at").select("i", "j", "v")


def _places(spark: SparkSession, places: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(places)], "at int, i int, j int")
