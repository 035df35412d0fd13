"""Splitting documents into overlapping pieces of a number of tokens.

A text is cut before each occurrence of the first separator that it holds; pieces that are too long
are cut again by the separators after that one, and neighbours are packed into windows of size
tokens whose overlap is made of whole pieces. Then tiny pieces are folded into the next one, and
punctuation that the cut left at the beginning of a piece is removed, in this order. After folding
a piece may hold more than size tokens, and after the removal fewer than min_chars characters.
Null, empty and blank texts give no pieces; a text of tiny pieces only gives one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whitebrook.functions import text as tx
from whitebrook.functions import tokens

SIZE, OVERLAP, MIN_CHARS = 512, 64, 100
#: From the strongest boundary to single characters.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")
GLUE = "\n\n"
_FRAGMENT = rf'^[.,;:!?)\]}}"»]+[{tx.SPACE}]+'

Lengths = Callable[[list[str]], Iterable[int]]


def _cut(text: str, separator: str, keep: str) -> list[str]:
    """Parts of a text with the separator at the start or at the end of a part; none is empty."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    if keep == "start":
        parts = [first, *(separator + x for x in rest)]
    else:
        parts = [x + separator for x in [first, *rest][:-1]] + [rest[-1] if rest else first]
    return [x for x in parts if x]


def _pack(parts: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: deque[tuple[str, int]] = deque()
    total = 0

    def emit() -> None:
        if whole := "".join(x for x, _ in window).strip():
            out.append(whole)

    for part, n in parts:
        if window and total + n > size:
            emit()
            while total > overlap or (total and total + n > size):
                total -= window.popleft()[1]
        window.append((part, n))
        total += n
    if window:
        emit()
    return out


def split(text: str, lengths: Lengths, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, keep: str = "start") -> list[str]:
    """The pieces of a text before any folding; keep says at which side of a cut a separator stays."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    parts = _cut(text, separators[at], keep)
    rest = separators[at + 1 :]
    out: list[str] = []
    run: list[tuple[str, int]] = []
    for part, n in zip(parts, lengths(parts)):
        if n < size:
            run.append((part, n))
            continue
        out += _pack(run, size, overlap)
        run = []
        out += split(part, lengths, size, overlap, rest, keep) if rest else [part]
    return out + _pack(run, size, overlap)


def merge_tiny(chunks: list[str], min_chars: int = MIN_CHARS) -> list[str]:
    """Each piece under min_chars goes to the front of the next one; a tiny rest goes to the end of the last."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk) + (len(GLUE) if len(held) > 1 else 0)
        if size >= min_chars:
            out.append(GLUE.join(held))
            held, size = [], 0
        elif not size:  # an empty piece is nothing to carry
            held = []
    if held:
        out.append(GLUE.join(([out.pop()] if out else []) + held))
    return out


def fold_tiny(chunks, min_chars: int = MIN_CHARS) -> Column:
    """merge_tiny over a column of arrays, linear in the pieces."""

    @F.pandas_udf("array<string>")
    def folded(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else merge_tiny(list(x), min_chars))

    return folded.asNondeterministic()(tx.col(chunks))


def strip_fragments(chunks) -> Column:
    """From the second piece on without the punctuation and whitespace that the cut left at its beginning."""
    return F.transform(tx.col(chunks), lambda c, i: F.when(i > 0, F.regexp_replace(c, _FRAGMENT, "")).otherwise(c))


def lengths_of(tokenizer: str) -> Lengths:
    return lambda parts: [len(x) for x in tokens._encode(parts, tokenizer)]


def split_column(text, tokenizer: str = "byte_bpe_50k", size: int = SIZE, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, separators: tuple[str, ...] = SEPARATORS, keep: str = "start", length: Lengths | None = None) -> Column:
    """The pieces of a text, folded, as an array; length replaces the tokenizer's count."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        n = length or lengths_of(tokenizer)
        return texts.map(lambda t: merge_tiny(split(t or "", n, size, overlap, separators, keep), min_chars) if t else [])

    # else a generator over the pieces infers a filter from them, which splits every text twice
    return pieces.asNondeterministic()(tx.col(text))


def enumerate_chunks(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """A row for each piece of arrays of pieces: (row_id, text, doc_sha, chunk_idx, source, sha), chunk_idx from 0."""
    return df.select("row_id", F.col("sha").alias("doc_sha"), "source", F.posexplode(chunks).alias("chunk_idx", "text")).select("row_id", "text", "doc_sha", "chunk_idx", "source", tx.chunk_digest("text").alias("sha"))


def chunk_documents(corpus: DataFrame, **options) -> DataFrame:
    """corpus has (row_id, source, text, sha); row_id goes along, as equal texts share a sha."""
    return enumerate_chunks(corpus.select("row_id", "source", "sha", strip_fragments(split_column("text", **options)).alias("chunks")))


def stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: n_docs (rows of docs), n_parents (distinct shas), n_chunks, mean_per_doc, min_chars, max_chars; zeros for empty tables."""
    n = F.length("text")
    own = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_sha").alias("n_parents"), F.coalesce(F.min(n), F.lit(0)).alias("min_chars"), F.coalesce(F.max(n), F.lit(0)).alias("max_chars"))
    both = own.withColumn("_one", F.lit(1)).join(docs.agg(F.count(F.lit(1)).alias("n_docs")).withColumn("_one", F.lit(1)), "_one")
    return both.select("n_docs", "n_parents", "n_chunks", F.round(F.col("n_chunks") / F.greatest(F.lit(1), "n_docs"), 2).alias("mean_per_doc"), "min_chars", "max_chars")


def distinct_parents(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct("doc_sha") if approximate else F.countDistinct("doc_sha")
    return chunks.agg(n.alias("n_parents"))
