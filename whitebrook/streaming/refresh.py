"""Moments and usage that grow with streams.

Moments merge associatively, so each micro-batch writes its own under its batch number and the state
is the merge of all: a batch that is replayed replaces its own file and counts once. compact folds
the finished ones into one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whitebrook.operators import moments as mo
from whitebrook.operators.whitening import Background, assemble
from whitebrook.sources import sinks

_STATE = "last_batch long, n long, mean binary, m2 binary"


def _save(spark: SparkSession, path: str, last: int, m: mo.Moments) -> None:
    spark.createDataFrame([(last, m[0], m[1].tobytes(), m[2].tobytes())], _STATE).coalesce(1).write.mode("overwrite").parquet(path)


def _one(df: DataFrame, vector: str) -> mo.Moments | None:
    """The moments of a batch of any number of vectors, none included."""
    rows = df.where(F.col(vector).isNotNull()).select(vector)
    few = rows.limit(2).collect()
    if len(few) < 2:
        return mo.of(mo.renorm(np.array([few[0][0]], np.float64))) if few else None
    return mo.moments(rows, vector=vector)[0]


def fold_into(path: str, vector: str = "embedding") -> Callable[[DataFrame, int], None]:
    """What foreachBatch takes: the moments of a batch go to the folder of states."""

    def each(batch: DataFrame, number: int) -> None:
        m = _one(batch, vector)
        if m is not None and number > _compacted(batch.sparkSession, path):
            _save(batch.sparkSession, f"{path}/batch={number}", number, m)

    return each


def _parts(spark: SparkSession, path: str) -> dict[str, str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    return {n: f"{path}/{n}" for n in found if re.fullmatch(r"(batch|upto)=\d+", n) and sinks.exists(spark, f"{path}/{n}")}


def _compacted(spark: SparkSession, path: str) -> int:
    return max((int(n[5:]) for n in _parts(spark, path) if n.startswith("upto=")), default=-1)


def state(spark: SparkSession, path: str) -> mo.Moments | None:
    """The merge of the last compacted state and of the batches after it, one at a time."""
    parts, upto = _parts(spark, path), _compacted(spark, path)
    out = None
    for name, at in sorted(parts.items()):
        if name == f"upto={upto}" or (name.startswith("batch=") and int(name[6:]) > upto):
            r = spark.read.parquet(at).first()
            mean = np.frombuffer(bytes(r.mean))
            m = (r.n, mean, np.frombuffer(bytes(r.m2)).reshape(len(mean), len(mean)))
            out = m if out is None else mo.merge(out, m)
    return out


def compact(spark: SparkSession, path: str) -> None:
    numbers = [int(n.split("=")[1]) for n in _parts(spark, path)]
    m = state(spark, path)
    if m is not None:
        _save(spark, f"{path}/upto={max(numbers)}", max(numbers), m)


def refit(spark: SparkSession, path: str) -> Background:
    m = state(spark, path)
    if m is None or m[0] < 2:
        raise ValueError("a covariance needs two vectors at least")
    return assemble(m)


def usage_windows(ledger: DataFrame, time_: str = "flushed_at", late: str = "30 days", size: str = "1 day", by: str = "model_slug", key: str = "report_id") -> DataFrame:
    """Calls, tokens and cost for each window of time and value of by; rows later than late are left out, repeated ones count once."""
    once = ledger.withWatermark(time_, late).dropDuplicates([key, time_])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_calls", "prompt_tokens", "total_tokens", "cost_usd")]
    return once.groupBy(F.window(time_, size), by).agg(*sums).select(F.col("window.start").alias("start"), by, "n_calls", "prompt_tokens", "total_tokens", "cost_usd")
