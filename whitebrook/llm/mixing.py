"""Mixing sources to target weights by Poisson replication.

Each source needs weight * total tokens; over its own tokens that is the mean number of times its
documents are used. A document's count is drawn by inverting a Poisson distribution, cut off at
max_repeats, at a number between 0 and 1 that a seeded hash of the document gives; the rate of the
distribution is solved so that the cut-off mean is the wanted one, for any mean and any cap.
Documents are exploded by their counts and dealt out by another hash, a global shuffle that any
rerun repeats. Draws are independent, so a source of few documents misses its share by chance:
shares tells the planned tokens and the standard error beside what was drawn. Sources that cannot
reach their target leave the mix smaller, so the shares of the others in it are above their
targets; share_of_total is the share of the planned whole.

Spellings of a source that differ in case or in edge spaces are one source; targets that spell one
source twice share it, and the first in order keeps the draws. Documents without source, or of a
source without target, are not mixed but count in the total. A source without documents has 0
tokens. A null weight or null max_repeats counts as 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of targets that are broadcast; more are joined by a shuffle.
FEW = 10_000


def source_name(column: str = "source"):
    return F.lower(F.trim(F.col(column)))


def poisson(rate: float, cap: int) -> np.ndarray:
    """The chances of 0, 1, ... cap - 1, by logarithms, so that no rate underflows as a whole."""
    k = np.arange(cap, dtype=np.float64)
    logs = np.cumsum(np.log(np.maximum(k, 1.0)))
    return np.exp(k * math.log(rate) - rate - logs) if rate > 0 else (k == 0).astype(np.float64)


def truncated_mean(rate: float, cap: int) -> float:
    """The mean of min(X, cap) for a Poisson X of that rate."""
    p = poisson(rate, cap)
    return float(p @ np.arange(cap)) + cap * max(0.0, 1.0 - float(p.sum()))


def replication(mean: float, cap: int) -> list[float]:
    """Cumulative shares of 0, 1, ... cap - 1 uses with that mean; no entry: always cap uses."""
    if cap <= 0 or mean >= cap:
        return []
    low, high = 0.0, float(cap)
    while truncated_mean(high, cap) < mean and high < 4.0 * cap + 1000:
        high *= 2
    for _ in range(80):
        rate = (low + high) / 2
        low, high = (rate, high) if truncated_mean(rate, cap) < mean else (low, rate)
    return np.minimum(np.cumsum(poisson(high, cap)), 1.0).tolist()


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, _s, target_weight, max_repeats, n_tokens, total_tokens, mean_repeats, reachable), a row for each target.

    counts has (source, n_tokens) of all documents and is read once: tokens are summed by source
    before anything is joined, and the total is summed over the sources.
    """
    own = counts.groupBy(source_name().alias("_s")).agg(F.sum("n_tokens").alias("n_tokens"))
    wanted = targets.where("source is not null").groupBy(source_name().alias("_w")).agg(F.collect_list(F.struct("source", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))).alias("_t"))
    both = own.join(wanted, F.col("_s") == F.col("_w"), "full")
    n = F.coalesce("n_tokens", F.lit(0))
    # a window over one row a source
    rows = both.select(F.coalesce("_s", "_w").alias("_s"), "_t", n.alias("n_tokens"), F.sum(n).over(Window.partitionBy(F.lit(0))).alias("total_tokens"))
    rows = rows.select("_s", "n_tokens", "total_tokens", F.explode("_t").alias("t")).select("t.source", "_s", "t.target_weight", "t.max_repeats", "n_tokens", "total_tokens")
    need = F.col("target_weight") * F.col("total_tokens")
    rate = F.when(F.col("n_tokens") > 0, need / F.col("n_tokens")).otherwise(F.lit(0.0))
    return rows.withColumn("mean_repeats", F.least(rate, F.col("max_repeats").cast("double"))).withColumn("reachable", F.col("max_repeats") * F.col("n_tokens") >= need)


def unreachable(counts: DataFrame, targets: DataFrame) -> DataFrame:
    return plan(counts, targets).where("not reachable").select("source")


def uniform(seed: int, *columns: str):
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), 11) / float(1 << 53)


def _ways(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(_s, _cap, _below) of each source that is mixed: a row for each target at most."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def table(mean: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series([replication(m, c) for m, c in zip(mean, cap)])

    own = plan(counts, targets).where("n_tokens > 0 and max_repeats > 0")
    ways = own.groupBy("_s").agg(F.min_by(F.struct("mean_repeats", "max_repeats"), "source").alias("w")).select("_s", F.col("w.max_repeats").alias("_cap"), table("w.mean_repeats", "w.max_repeats").alias("_below"))
    return F.broadcast(ways) if len(targets.select("source").limit(FEW + 1).collect()) <= FEW else ways


def drawn(documents: DataFrame, counts: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """documents with _s, their source, and _times, how often each is used; those that are not used are left out."""
    given = documents.withColumn("_s", source_name()).join(_ways(counts, targets), "_s").withColumn("_u", uniform(seed, key))
    times = F.when(F.size("_below") == 0, F.col("_cap")).otherwise(F.size(F.filter("_below", lambda x: x <= F.col("_u"))))
    return given.withColumn("_times", times).where("_times > 0").drop("_cap", "_below", "_u")


def mix(documents: DataFrame, counts: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """(key, source, copy, text): the records, each as often as it was drawn, dealt out to partitions and ordered within them by a hash.

    counts has (key, source, n_tokens) of documents. The draws need no tokens of single documents,
    so counts is read once, for the plan.
    """
    used = drawn(documents.select(key, "source", text), counts, targets, key, seed)
    every = used.select(key, F.col("_s").alias("source"), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"), text)
    place = every.withColumn("_place", F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy")))
    return place.repartition("_place").sortWithinPartitions("_place", key, "copy").drop("_place")


def shares(counts: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """A row for each target: what was planned and what the draws gave.

    (source, target_weight, actual_share, share_of_total, n_docs, n_uses, n_tokens_used,
    planned_tokens, standard_error, reachable); actual_share is that of the mix, share_of_total that
    of all tokens, which target_weight is a share of too; standard_error is that of n_tokens_used by
    a Poisson bound. counts is read twice; give a table or a checkpoint.
    """
    used = drawn(counts.select(key, "source", "n_tokens"), counts, targets, key, seed)
    n = F.col("n_tokens")
    sums = used.groupBy("_s").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_times").alias("n_uses"), F.sum(n * F.col("_times")).alias("n_tokens_used"))
    squares = counts.groupBy(source_name().alias("_s")).agg(F.sum(n.cast("double") * n).alias("_squares"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = plan(counts, targets).join(sums, "_s", "left").join(squares, "_s", "left")
    mine = F.coalesce("n_tokens_used", F.lit(0))
    first = F.row_number().over(Window.partitionBy("_s").orderBy("source")) == 1  # a source that is spelled twice counts once
    rows = rows.withColumn("_once", F.when(first, mine).otherwise(0)).withColumn("_all", F.sum("_once").over(Window.partitionBy(F.lit(0))))
    share = lambda of: F.when(F.col(of) > 0, mine / F.col(of)).otherwise(F.lit(0.0))
    return rows.select(
        "source",
        "target_weight",
        share("_all").alias("actual_share"),
        share("total_tokens").alias("share_of_total"),
        zero("n_docs"),
        zero("n_uses"),
        zero("n_tokens_used"),
        (F.col("mean_repeats") * n).alias("planned_tokens"),
        F.coalesce(F.sqrt(F.col("mean_repeats") * F.col("_squares")), F.lit(0.0)).alias("standard_error"),
        "reachable",
    )
