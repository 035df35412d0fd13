"""Tokens of every document and what each source, language and domain adds up to.

The vocabulary's trie with failure links counts exactly in linear time (bpe.ByteBpe for byte-level
BPE, bpe.LongestMatch for longest-match vocabularies). Counting happens in the scan; only keys and
counts are shuffled, partly aggregated first. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .scan import scan


def token_counts(df: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = "byte_bpe_50k", folder: str | None = None, trie: bool = True) -> DataFrame:
    """(key, *keep, n_tokens); one row for each row of df."""
    kinds = dict(df.dtypes)

    def batch(*columns):
        count = bpe.load(tokenizer, folder).count
        return [*columns[:-1], [count(t, trie) if t else 0 for t in columns[-1].to_pylist()]]

    names = [key, *keep]
    return scan(df, [*names, text], ", ".join([*(f"{c} {kinds[c]}" for c in names), "n_tokens long"]), batch)


def greedy_counts(df: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, *keep, n_tokens, n_greedy): the exact count and that of longest match; null and empty texts have 0."""
    kinds = dict(df.dtypes)

    def batch(*columns):
        exact, greedy = bpe.load(tokenizer, folder).count, bpe.load_greedy(tokenizer, folder).count
        texts = [t or "" for t in columns[-1].to_pylist()]
        return [*columns[:-1], [exact(t) for t in texts], [greedy(t) for t in texts]]

    names = [key, *keep]
    return scan(df, [*names, text], ", ".join([*(f"{c} {kinds[c]}" for c in names), "n_tokens long", "n_greedy long"]), batch)


def budget(counts: DataFrame, by: tuple[str, ...] = ("source", "lang", "domain")) -> DataFrame:
    """Documents and tokens for each value of each column of by, and overall.

    (slice, value, n_docs, n_tokens); a null value is a slice value of its own, and the row of
    slice "all" holds the total. An empty table gives the total row alone, with zeros.
    """
    cells = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sets = cells.groupingSets([[F.col(c)] for c in by], *[F.col(c) for c in by]).agg(F.grouping_id().alias("g"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    last = len(by) - 1
    every = (1 << len(by)) - 1
    slice_ = F.coalesce(*[F.when(F.col("g") == F.lit(every & ~(1 << (last - i))), F.lit(c)) for i, c in enumerate(by)])
    value = F.coalesce(*[F.when(slice_ == c, F.col(c).cast("string")) for c in by])
    total = cells.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return sets.select(slice_.alias("slice"), value.alias("value"), "n_docs", "n_tokens").unionByName(total.select(F.lit("all").alias("slice"), F.lit(None).cast("string").alias("value"), "n_docs", "n_tokens"))


def misfit_reports(counts: DataFrame, embed_index: DataFrame, reports: DataFrame, low: int = 7, high: int = 13) -> DataFrame:
    """report_id of the reports whose prompt_tokens are under low or over high tenths of their rows' tokens.

    counts has (row_id, n_tokens). Each row of a report counts once, skipped rows never; a report
    written several times counts once; rows without text add nothing; null prompt_tokens are no
    case. Sums are compared as integers.
    """
    covered = embed_index.where(~F.coalesce("skipped", F.lit(False))).select("report_id", "row_id").distinct()
    sums = covered.join(counts.select("row_id", "n_tokens"), "row_id").groupBy("report_id").agg(F.sum("n_tokens").alias("n_tokens"))
    told = reports.where(F.col("prompt_tokens").isNotNull() & F.col("report_id").isNotNull()).select("report_id", "prompt_tokens").distinct()
    n = F.coalesce("n_tokens", F.lit(0))
    both = told.join(sums, "report_id", "left")
    return both.where((F.col("prompt_tokens") * 10 < n * low) | (F.col("prompt_tokens") * 10 > n * high)).select("report_id").distinct()
