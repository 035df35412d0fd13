"""Token ids of every document, long documents in overlapping chunks.

Texts of more than chunk characters are cut into chunks that overlap. Each chunk is cut into
pre-tokens on its own. Cutting goes from left to right and looks no further than a few characters
ahead, so where two neighbouring chunks share a pre-token boundary after a character that is not
whitespace, all that follows is the same: there they are stitched. Neighbours without such a place
are joined. The pieces between stitches are then encoded in parallel and put in order.

Null and empty texts give an empty list. Every row of the input gives one row.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .scan import scan

CHUNK = 4_096
OVERLAP = 512
_AHEAD = 4


def _ids(texts: list[str | None], tokenizer: str, folder: str | None) -> pa.Array:
    encode = bpe.load(tokenizer, folder).encode_into
    flat, ends = array("i"), [0]
    for text in texts:
        if text:
            encode(text, flat)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()))


def stitches(part: str, low: int, high: int, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> list[int]:
    """Ends of pre-tokens in [low, high) of a part that do not follow whitespace."""
    out, at = [], 0
    for piece in bpe.load(tokenizer, folder).pieces(part):
        at += len(piece)
        if at >= high:
            break
        if at >= low and not part[at - 1].isspace():
            out.append(at)
    return out


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids array<int>) without special tokens; their strings in a text are ordinary text."""
    kind = dict(df.dtypes)[key]
    size = F.coalesce(F.length(text), F.lit(0))
    schema = f"{key} {kind}, ids array<int>"
    small = scan(df.where(size <= chunk), [key, text], schema, lambda keys, texts: [keys, _ids(texts.to_pylist(), tokenizer, folder)])

    large = df.where(size > chunk).groupBy(F.col(key).alias("_key"), F.col(text).alias("_text")).agg(F.count(F.lit(1)).alias("_n"))
    mark = F.concat_ws(":", F.coalesce(F.col("_key").cast("string"), F.lit("")), F.col("_key").isNull().cast("string"), "_text")
    last = F.floor((F.length("_text") - 1) / chunk).cast("int")
    parts = large.select(F.sha2(mark, 256).alias("_id"), "_key", "_n", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_k"), "_text").select(
        "_id", "_key", "_n", "_last", "_k", F.substring(F.col("_text"), F.col("_k") * chunk + 1, F.lit(chunk + overlap)).alias("_part")
    ).repartition("_id", "_k")

    def edges(ids, lasts, ks, texts):
        left, right = [], []
        for end, k, part in zip(lasts.to_pylist(), ks.to_pylist(), texts.to_pylist()):
            sure = len(part) if k == end else len(part) - _AHEAD
            left.append([p + k * chunk for p in stitches(part, 1, min(overlap, sure), tokenizer, folder)] if k else [])
            right.append([p + k * chunk for p in stitches(part, chunk, min(len(part), sure), tokenizer, folder)] if k < end else [])
        return [ids, ks, left, right]

    # the places alone are put in order; the parts' texts stay where they are
    cut = scan(parts, ["_id", "_last", "_k", "_part"], "_id string, _k int, _left array<int>, _right array<int>", edges)
    order = Window.partitionBy("_id").orderBy("_k")
    met = cut.select("_id", "_k", F.array_min(F.array_intersect("_right", F.lead("_left").over(order))).alias("_to"))
    begun = met.withColumn("_from", F.lag("_to").over(order))
    start, stop = F.coalesce("_from", F.col("_k") * chunk), F.coalesce("_to", (F.col("_k") + 1) * chunk)
    spans = begun.select("_id", "_k", F.sum(F.col("_from").isNotNull().cast("int")).over(order).alias("_g"), start.alias("_start"), stop.alias("_stop"))
    pieces = parts.join(spans, ["_id", "_k"]).select("_id", "_key", "_n", "_k", "_g", F.substring(F.col("_part"), F.col("_start") - F.col("_k") * chunk + 1, F.col("_stop") - F.col("_start")).alias("_piece"))
    whole = pieces.groupBy("_id", "_key", "_n", "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_piece"))), lambda x: x["_piece"]), "").alias("_piece"))
    encoded = scan(whole, ["_id", "_key", "_n", "_g", "_piece"], f"_id string, _key {kind}, _n long, _g long, _ids array<int>", lambda a, b, c, d, texts: [a, b, c, d, _ids(texts.to_pylist(), tokenizer, folder)])
    joined = encoded.groupBy("_id", "_key", "_n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_g", "_ids"))), lambda x: x["_ids"])).alias("ids"))
    again = joined.select(F.col("_key").alias(key), "ids", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(key, "ids")
    return small.unionByName(again)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text): the raw bytes of the tokens, concatenated; a null list gives null."""
    kind = dict(df.dtypes)[key]
    return scan(df, [key, ids], f"{key} {kind}, text string", lambda keys, lists: [keys, [None if x is None else bpe.load(tokenizer, folder).decode(x) for x in lists.to_pylist()]])
