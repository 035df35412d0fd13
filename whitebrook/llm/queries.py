"""The queries of this subpackage, by name; each takes the session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, mixing, neardup, quality, repetition, sentences, splitting, token_budget
from .scan import ensure_checkpoint_dir, table, texts

Query = Callable[[SparkSession, str], DataFrame]

#: The similarity of problem 4 in this project's data: runs of three words, 0.60.
LIKE = {"threshold": (3, 5), "words": 3}


def _words(spark: SparkSession, d: str) -> frozenset[str]:
    return quality.common_set(table(spark, d, "common_words"))


def _document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.token_counts(texts(spark, d, "documents"), "doc_id", keep=("source",), trie=False)


def p1_found(spark, d):
    return repetition.repetitive_rows(texts(spark, d, "corpus"))


def p1_repetition(spark, d):
    return repetition.repetition(texts(spark, d, "corpus"))


def p1_shares(spark, d):
    return repetition.repetition(texts(spark, d, "corpus")).select("row_id", "n_letters", F.round("repeated_share", 9).alias("repeated_share"))


def p2_found(spark, d):
    return splitting.audit(table(spark, d, "chunks"), table(spark, d, "corpus")).select("doc_sha", "chunk_idx")


def p2_pieces(spark, d):
    return splitting.pieces(table(spark, d, "corpus"))


def p3_found(spark, d):
    return quality.not_prose(texts(spark, d, "corpus"))


def p3_statistics(spark, d):
    return quality.quality(texts(spark, d, "corpus"), _words(spark, d))


def p3_words(spark, d):
    counts = quality.quality(texts(spark, d, "corpus"), _words(spark, d))
    return counts.select("row_id", "n_chars_true", "word_count", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "common_word_share")])


def p4_found(spark, d):
    return neardup.row_pairs(table(spark, d, "corpus"), **LIKE)


def p4_groups(spark, d):
    return neardup.groups(table(spark, d, "corpus"), **LIKE)


def p5_found(spark, d):
    counts = token_budget.token_counts(texts(spark, d, "corpus"), "row_id")
    return token_budget.misfit_reports(counts, table(spark, d, "embed_index"), table(spark, d, "cost_report"))


def p5_budget(spark, d):
    return token_budget.budget(token_budget.token_counts(texts(spark, d, "corpus"), "row_id", keep=("source", "lang", "domain")))


def p5_greedy(spark, d):
    """By source, the exact tokens and those of longest match, the linear count for vocabularies without merges."""
    counts = token_budget.greedy_counts(texts(spark, d, "corpus"), "row_id", keep=("source",))
    return counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_greedy").alias("n_greedy"))


def p6_ids(spark, d):
    return encoding.token_ids(texts(spark, d, "documents"))


def p6_roundtrip(spark, d):
    """Documents whose ids do not decode to their text."""
    whole = encoding.decode(encoding.token_ids(texts(spark, d, "documents"))).withColumnRenamed("text", "decoded")
    return texts(spark, d, "documents").select("doc_id", "text").join(whole, "doc_id").where("decoded <> coalesce(text, '')").select("doc_id")


def p7_found(spark, d):
    return mixing.unreachable(_document_tokens(spark, d), table(spark, d, "mix_targets"))


def p7_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), _document_tokens(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark, d):
    ensure_checkpoint_dir(spark)
    return mixing.shares(_document_tokens(spark, d).checkpoint(), table(spark, d, "mix_targets"))


def p8_found(spark, d):
    return sentences.sentences(texts(spark, d, "documents")).select("doc_id", "sent_start")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


