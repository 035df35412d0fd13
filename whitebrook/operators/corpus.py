"""Assembling a corpus: gates, seeded order, tiers, digests, fingerprint and manifest.

A source gives raw rows (row_id, source, text, lang, language_score); nulls may stand in any column
but the key. Texts are taken null-safe and stripped, shorter ones than min_chars dropped, then
capped. Within a source the order is that of md5(seed ':' key), so any subset is reproducible
whatever the partitioning. A tier takes a range of ranks of its source's order; tiers follow one
another and rows are numbered densely over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whitebrook.functions import text as tx

MIN_CHARS = 500
MIN_SCORE = 0.5
LANG = "pl"

_PARTS = 4


def long_enough(df: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, max_chars: int | None = None) -> DataFrame:
    """Rows whose stripped text has min_chars characters at least, with text stripped and capped after that."""
    bare = df.withColumn(text, tx.strip(tx.null_safe(text))).where(F.length(text) >= min_chars)
    return bare.withColumn(text, tx.cap(text, max_chars))


def score_gate(score: str = "language_score", least: float = MIN_SCORE) -> Column:
    """Passes unless a score is given, is not 0, and is under least: null and exactly 0.0 pass."""
    s = F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))
    return (s == 0) | (s >= least)


def lang_gate(lang: str = "lang", wanted: str = LANG) -> Column:
    """Exactly that language; null does not pass."""
    return F.coalesce(F.col(lang) == wanted, F.lit(False))


def seeded(seed: int, key: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_order(df: DataFrame, seed: int, key: str = "row_id") -> DataFrame:
    """df in the seeded order, ties by key; a range-partitioned global sort."""
    return df.orderBy(seeded(seed, key), key)


def ranked(df: DataFrame, seed: int, most: int, key: str = "row_id", by: str = "source") -> DataFrame:
    """The first most rows of each value of by in the seeded order, with their rank from 1.

    The bound stands in the filter, so each task keeps no more than most rows of a value before the shuffle.
    """
    order = Window.partitionBy(by).orderBy(seeded(seed, key), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def take(df: DataFrame, n: int, skip: int = 0, seed: int = 42, key: str = "row_id", by: str = "source") -> DataFrame:
    """Ranks skip + 1 to skip + n of each value of by; ranks are counted after all filters of df."""
    return ranked(df, seed, skip + n, key, by).where(F.col("rank") > skip)


@dataclass(frozen=True)
class Tier:
    """n rows of a source, from rank skip + 1 on. tag is what the rows say their source is."""

    name: str
    source: str
    n: int
    skip: int = 0
    tag: str | None = None


def mix(tiers: list[Tier], sources: dict[str, Callable[[], DataFrame]], seed: int = 42, max_chars: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row_id, tier, source, source_row, text, sha, n_chars): the tiers one after another, rows numbered from 0.

    A tier that its source cannot fill is shorter and the next follows at once; see shortfalls.
    Tiers of one source never share a row, as they are ranges of the same ranks.
    """
    kept, by = [], {t.source: [(i, t2) for i, t2 in enumerate(tiers) if t2.source == t.source] for t in tiers}
    for source, own in by.items():  # a source is ranked once for all of its tiers
        rows = long_enough(sources[source](), min_chars=min_chars, max_chars=max_chars).withColumn("source", F.lit(source))
        every = ranked(rows, seed, max(t.skip + t.n for _, t in own))
        for i, t in own:
            inside = (F.col("rank") > t.skip) & (F.col("rank") <= t.skip + t.n)
            place = F.struct(F.lit(i).alias("tier_ord"), F.lit(t.name).alias("tier"), F.lit(t.tag or t.source).alias("source"), (F.col("rank") - t.skip - 1).cast("long").alias("at"))
            every = every.withColumn(f"_t{i}", F.when(inside, place))
        places = F.filter(F.array(*[f"_t{i}" for i, _ in own]), lambda x: x.isNotNull())
        kept.append(every.select(F.col("row_id").alias("source_row"), "text", F.explode(places).alias("t")))
    every = _union(kept).select("t.*", "source_row", "text")
    # a row a tier: a window over the few tiers gives where each begins
    counts = every.groupBy("tier_ord").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.select("tier_ord", (F.sum("n").over(Window.orderBy("tier_ord")) - F.col("n")).alias("begin"))
    placed = every.join(F.broadcast(begins), "tier_ord")  # as many rows as tiers
    return placed.select((F.col("begin") + F.col("at")).alias("row_id"), "tier", "source", "source_row", "text", tx.doc_digest("text").alias("sha"), F.length("text").cast("long").alias("n_chars"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def shortfalls(corpus: DataFrame, tiers: list[Tier]) -> list[tuple[str, int, int]]:
    """(tier, wanted, found) of the tiers that could not be filled."""
    found = {r.tier: r.n for r in corpus.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a tier
    return [(t.name, t.n, found.get(t.name, 0)) for t in tiers if found.get(t.name, 0) < t.n]


def totals(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("n_total"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars_total"))


def counts(corpus: DataFrame, by: str = "source") -> DataFrame:
    return corpus.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def counts_map(corpus: DataFrame, by: str = "source") -> DataFrame:
    """One row with the counts as a map; by must have few values. Null is counted as "unknown"."""
    few = counts(corpus.withColumn(by, F.coalesce(by, F.lit("unknown"))), by)
    return few.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias("mix"))


def fingerprint(corpus: DataFrame, sha: str = "sha") -> DataFrame:
    """sha256 of the sorted digests, repeated ones kept, joined by line breaks; one row.

    The digest is serial by its definition: the rows are sorted by Spark, which spills, and one task
    streams over them, 25 bytes a row, holding one batch at a time. fingerprint_tree has no serial part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = hashlib.sha256(), True
        for batch in batches:
            if batch.num_rows:
                state.update((b"" if first else b"\n") + "\n".join(batch.column(0).to_pylist()).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["fingerprint"])

    one = corpus.where(F.col(sha).isNotNull()).select(sha).repartition(1).sortWithinPartitions(sha)
    return one.mapInArrow(run, "fingerprint string").agg(F.coalesce(F.max("fingerprint"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def fingerprint_tree(corpus: DataFrame, sha: str = "sha", digits: int = 2) -> DataFrame:
    """A fingerprint without a serial part: digests with their counts, hashed by prefix in _PARTS levels of digits hex digits; one row.

    Equal digests are counted before the shuffle, so a hot one is one entry; digests are uniform, so
    the groups of a level are even.
    """
    level = corpus.where(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k", F.concat_ws(":", "k", "n").alias("v"))
    for left in reversed(range(_PARTS)):
        short = F.substring("k", 1, left * digits)
        level = level.groupBy(short.alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("k", "v")))["v"], "\n"), 256).alias("v")).select(F.col("p").alias("k"), "v")
    return level.agg(F.coalesce(F.max("v"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def manifest(corpus: DataFrame, targets: dict[str, int], seed: int, max_chars: int | None = None) -> DataFrame:
    """One row: wanted and actual counts by tier and by source, seed, cap, totals and fingerprint."""
    wanted = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    parts = [totals(corpus), counts_map(corpus, "tier").withColumnRenamed("mix", "mix_actual"), counts_map(corpus).withColumnRenamed("mix", "mix_sources"), fingerprint(corpus).withColumnRenamed("fingerprint", "corpus_fingerprint_sha256")]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # each is one row
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.select(wanted.alias("mix_target"), "mix_actual", "mix_sources", F.lit(seed).alias("seed"), F.lit(max_chars).cast("int").alias("max_chars_per_doc"), "n_total", "n_chars_total", "corpus_fingerprint_sha256")
