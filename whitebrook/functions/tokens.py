"""Token counts and caps under a pluggable tokenizer, in Arrow batches.

A tokenizer is named by a word: "words" counts runs without whitespace (and is plain SQL, see
functions.text), any other name is a file of the public vocabularies for the tokenizers library,
loaded once for each worker. Null texts have 0 tokens and stay null.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

#: Which vocabulary stands in for each embedding model's own.
TOKENIZERS = {"qwen/qwen3-embedding-4b": "byte_bpe_50k", "qwen/qwen3-embedding-8b": "byte_bpe_50k"}
BLOCK = 1_000


def tokenizer_of(model: str, name: str | None = None) -> str:
    """The tokenizer of a model unless one is named; an unknown model raises."""
    if name is None and model not in TOKENIZERS:
        raise KeyError(f"no tokenizer is known for {model!r}; name one (known: {', '.join(sorted(TOKENIZERS))})")
    return name or TOKENIZERS[model]


@lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer of a name, or of the path of a file."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if not os.path.isfile(name):
        import public_tokenizers

        name = public_tokenizers.path(f"{name}.json")
    found = Tokenizer.from_file(name)
    found.encode_special_tokens = True
    return found


def _encode(texts: list[str | None], name: str) -> Iterator[list[int]]:
    """The ids of each text, a block at a time; with "words", the words."""
    for i in range(0, len(texts), BLOCK):
        part = [t or "" for t in texts[i : i + BLOCK]]
        if name == "words":
            yield from (t.split() for t in part)
        else:
            yield from (e.ids for e in load(name).encode_batch(part, add_special_tokens=False))


def count(text, name: str = "byte_bpe_50k") -> Column:
    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in _encode(texts.tolist(), name)], dtype="int32")

    return counted(col(text))


def truncate(text, most: int, name: str = "byte_bpe_50k") -> Column:
    """(text, n_tokens, capped): a text of more than most tokens becomes what its first ones decode to, any other stays as it is.

    n_tokens are those before the cut. Where the cut falls inside a character, the decoded text is not a prefix.
    """

    @F.pandas_udf("text string, n_tokens int, capped boolean")
    def cut(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        out = []
        for t, ids in zip(values, _encode(values, name)):
            over = len(ids) > most
            short = t if not over else " ".join(ids[:most]) if name == "words" else load(name).decode(ids[:most], skip_special_tokens=True)
            out.append((short, len(ids), over))
        return pd.DataFrame(out, columns=["text", "n_tokens", "capped"]).astype({"n_tokens": "int32", "capped": "bool"})

    return cut(col(text))


def stats(df: DataFrame, n_tokens: str = "n_tokens", most: int = 0) -> DataFrame:
    """(n_capped, max_seen, total_tokens) in one row; all before any cut, 0 for an empty table."""
    n = F.col(n_tokens)
    return df.agg(F.coalesce(F.sum((n > most).cast("long")), F.lit(0)).alias("n_capped"), F.coalesce(F.max(n), F.lit(0)).alias("max_seen"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"))
