"""Near-duplicate documents by adaptive multi-match prefixes.

A document is the set of its runs of consecutive words. Two sets of n and m runs whose similarity
is at least t share at least ceil(t * n) runs, so with one order over all runs the first
n - ceil(t * n) + k runs of either must have k runs in common. Each document chooses its own k: a
longer prefix costs postings, but asks for more shared runs and so leaves fewer pairs to verify.
A pair must share min(k, k') runs of the two prefixes; what does is verified exactly.

The order is rarest first by the number of documents that hold a run. Documents stand in lots (by
a hash of their key, of about LOT documents and LOT_CHARS characters at most). A lot sends its
distinct runs and their counts as sorted, packed blocks to buckets; a bucket of about BUCKET runs
adds them up and sends each block's counts back to its lot. A run takes about two bytes of the
shuffle while blocks hold many runs, which ends at about 1 TB of text; the results stay the same. So the counts are exact whatever the size (runs are cut
to so many bits that a false match is rare; it can only make a run look more frequent), nothing is
broadcast, and a run that every document holds adds one entry for each lot. A run that one document
holds needs no posting, and a document with more of them than its prefix has none at all.

Equal texts are one class with one representative; links hold between representatives, and
membership gives the rest. Postings are joined on their run by sort-merge, which spills and which
adaptive execution splits where one run is hot.

Texts of fewer words than a run have no runs and are like equal texts only; rows of null text or
null key are in no class. Similarity of equal texts is 1. Keys may be of any type that has an order.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scan import ensure_checkpoint_dir, scan

#: Documents of a lot, in small and in large tables, its characters, and the runs of a bucket: a few hundred MB each.
LOT = (1_024, 8_192)
LOT_CHARS = 24_000_000
BUCKET = 2_000_000
VERIFY_COST = 20.0
STEPS = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128)

_WORD = re.compile(r"[^\W_]+")
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Words()


def runs_of(text: str, words: int = 3) -> np.ndarray:
    """The sorted 64-bit hashes of the set of runs of that many words."""
    found = _WORD.findall(text.lower())
    n = len(found) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = (out ^ one[i : i + n]) * _P1
        out ^= out >> np.uint64(31)
        out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    out ^= out >> np.uint64(32)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many runs are in both sets and in either."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values as differences, and their counts, in planes of bytes."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = [steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), counts.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(10, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view("<u2").ravel()


def level_of(totals: np.ndarray) -> np.ndarray:
    """0 for a run of one document, else its count on a scale of eight steps to a power of two."""
    return np.where(totals < 2, 0, np.minimum(np.log2(np.maximum(totals, 2)) * 8, 255)).astype(np.uint8)


def others_of(levels: np.ndarray) -> np.ndarray:
    """About how many other documents hold runs of these levels."""
    return np.where(levels == 0, 0.0, np.exp2(levels / 8.0) - 1)


def prefix(runs: np.ndarray, levels: np.ndarray, t_num: int, t_den: int) -> tuple[np.ndarray, int]:
    """The runs to post of a set's prefix in the common order, and how many shared runs it asks for."""
    n = len(runs)
    needed = -(-t_num * n // t_den)
    base = n - needed
    alone = int(np.count_nonzero(levels == 0))
    if alone > base:  # what is left could not be enough for any partner
        return runs[:0], 1
    order = np.lexsort((runs, levels))
    paid, best, k_best = np.cumsum(others_of(levels[order])), math.inf, 1
    for k in STEPS:
        if k > max(1, needed // 3):
            break
        spent = paid[base + k - 1]
        cost = base + k + spent + VERIFY_COST * spent / k
        if cost < best:
            best, k_best = cost, k
    return runs[order[alone : base + k_best]], k_best


class _Lots:
    """How documents are laid out: lots, buckets and the bits of a run that are counted."""

    def __init__(self, n_rows: int, n_chars: int):
        size = min(LOT[1], max(LOT[0], n_rows // 256))
        self.lots = max(1, -(-n_rows // size), -(-n_chars // LOT_CHARS))
        runs = max(2, n_chars // 6)  # about one for each word
        self.bucket_bits = max(0, math.ceil(math.log2(runs / BUCKET)))
        self.bits = min(64, max(24, math.ceil(math.log2(runs)) + 8))
        self.shift = np.uint64(64 - self.bits)

    def of(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.lots)).alias("lot")

    def counted(self, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct runs of a lot as they are counted, the place of each run among them, and their counts."""
        return np.unique(every >> self.shift, return_inverse=True, return_counts=True)

    def cuts(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of sorted values and where each begins; the last entry is the end."""
        at = (values >> np.uint64(self.bits - self.bucket_bits)).astype(np.int64) if self.bucket_bits else np.zeros(len(values), np.int64)
        buckets, starts = np.unique(at, return_index=True)
        return buckets, np.append(starts, len(values))


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def _chosen(table: pa.Table, keys: pa.ChunkedArray) -> tuple[pa.Array, list[str]]:
    """Keys and texts of the rows with one of keys, in the order of the keys; repeated rows count once."""
    hit = table.filter(pc.is_in(table["_key"], value_set=keys.combine_chunks())).sort_by([("_key", "ascending"), ("_text", "ascending")])
    found = hit["_key"].combine_chunks()
    new = np.ones(len(found), bool)
    if len(found) > 1:
        new[1:] = pc.not_equal(found[1:], found[:-1]).to_numpy(zero_copy_only=False)
    return found.filter(pa.array(new)), hit["_text"].combine_chunks().filter(pa.array(new)).to_pylist()


def classes(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, class_id): class_id is the least key among the rows of equal text. Null texts are left out; repeated rows count once."""
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.sha2(text, 256).alias("_digest")).distinct()
    least = rows.groupBy("_digest").agg(F.min("_key").alias("class_id"))
    return rows.join(least, "_digest").select(F.col("_key").cast(kind).alias(key), "class_id")


def class_pairs(df: DataFrame, key: str = "row_id", text: str = "text", threshold: tuple[int, int] = (4, 5), words: int = 5) -> DataFrame:
    """(class_a, class_b, similarity) of classes of different text whose similarity is at least threshold.

    threshold is a fraction (numerator, denominator) so that comparisons are exact; class_a < class_b.
    """
    t_num, t_den = threshold
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    n_rows, n_chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    lots = _Lots(n_rows, n_chars)
    by_lot = rows.select("_key", "_text", lots.of("_key")).groupBy("lot")  # one exchange of the texts serves three uses
    firsts = rows.groupBy(F.sha2("_text", 256)).agg(F.min("_key").alias("_key")).select("_key", lots.of("_key"))

    blocks_of, postings_of, sets_as = "bucket long, lot long, packed binary", f"run long, doc {kind}, meta long", f"doc {kind}, runs binary"
    block, posting, full = _arrow(blocks_of), _arrow(postings_of), _arrow(sets_as)

    def send(lot: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _, texts = _chosen(left, right["_key"])
        values, _, counts = lots.counted(np.concatenate([np.empty(0, np.uint64), *(runs_of(t, words) for t in texts)]))
        buckets, starts = lots.cuts(values)
        counts = np.minimum(counts, 65535)
        packed = [_pack(values[i:j], counts[i:j]) for i, j in zip(starts, starts[1:])]
        return _table(block, [buckets, np.full(len(buckets), lot[0].as_py()), packed])

    def count(table: pa.Table) -> pa.Table:
        blocks = [_unpack(x) for x in table["packed"].to_pylist()]
        _, place = np.unique(np.concatenate([v for v, _ in blocks]), return_inverse=True)
        totals = np.bincount(place, np.concatenate([c for _, c in blocks]))
        levels = np.split(level_of(totals)[place], np.cumsum([len(v) for v, _ in blocks])[:-1])
        small = zstandard.ZstdCompressor(level=1)
        return _table(block, [table["bucket"].combine_chunks(), table["lot"].combine_chunks(), [small.compress(x.tobytes()) for x in levels]])

    def post(_, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts = _chosen(left, right["_key"].drop_null())
        sets = [runs_of(t, words) for t in texts]
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        values, place, _ = lots.counted(every)
        replies = right.filter(pc.is_valid(right["packed"])).sort_by("bucket")["packed"].to_pylist()
        open_ = zstandard.ZstdDecompressor()
        levels = np.frombuffer(b"".join(map(open_.decompress, replies)), np.uint8)
        if len(levels) != len(values):
            raise RuntimeError("the counts of a lot do not fit its runs")
        levels = levels[place]
        out, at, sizes, metas = [np.empty(0, np.uint64)], 0, [], []
        for runs in sets:
            chosen, k = prefix(runs, levels[at : at + len(runs)], t_num, t_den) if len(runs) else (runs, 1)
            at += len(runs)
            out.append(chosen)
            sizes.append(len(chosen))
            metas.append(len(runs) * 256 + k)
        return _table(posting, [np.concatenate(out).view(np.int64), keys.take(pa.array(np.repeat(np.arange(len(sets)), sizes))), np.repeat(np.array(metas, np.int64), sizes)])

    blocks = by_lot.cogroup(firsts.groupBy("lot")).applyInArrow(send, blocks_of)
    answers = blocks.groupBy("bucket").applyInArrow(count, blocks_of)
    known = firsts.select("lot", "_key", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("packed"))
    known = known.unionByName(answers.select("lot", F.lit(None).cast(kind).alias("_key"), "bucket", "packed"))
    posted = by_lot.cogroup(known.groupBy("lot")).applyInArrow(post, postings_of)

    a, b = posted.select("run", F.col("doc").alias("a"), F.col("meta").alias("ma")), posted.select("run", F.col("doc").alias("b"), F.col("meta").alias("mb"))
    na, nb = F.shiftright("ma", 8), F.shiftright("mb", 8)
    fits = (F.col("a") < F.col("b")) & (F.least(na, nb) * t_den >= F.greatest(na, nb) * t_num)
    need = F.least(F.col("ma").bitwiseAND(255), F.col("mb").bitwiseAND(255))
    met = a.join(b, "run").where(fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(need).alias("need"))
    candidates = met.where("shared >= need").select("a", "b")

    # only the sets of documents that may be in a pair are made and sent
    sides = candidates.select(F.explode(F.array("a", "b")).alias("_key")).distinct().select("_key", lots.of("_key"))

    def sets_of(_, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts = _chosen(left, right["_key"])
        return _table(full, [keys, [runs_of(t, words).tobytes() for t in texts]])

    sets = by_lot.cogroup(sides.groupBy("lot")).applyInArrow(sets_of, sets_as)
    pairs = candidates.join(sets.select(F.col("doc").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("doc").alias("b"), F.col("runs").alias("rb")), "b")

    def verify(left, right, ra, rb):
        hits, found = [], []
        for i, (p, q) in enumerate(zip(ra.to_pylist(), rb.to_pylist())):
            both, either = similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
            if both * t_den >= either * t_num:
                hits.append(i)
                found.append(both / either)
        at = pa.array(hits, pa.int64())
        return [left.take(at), right.take(at), found]

    return scan(pairs, ["a", "b", "ra", "rb"], f"class_a {kind}, class_b {kind}, similarity double", verify)


def row_pairs(df: DataFrame, key: str = "row_id", text: str = "text", threshold: tuple[int, int] = (4, 5), words: int = 5) -> DataFrame:
    """(key_a, key_b): all pairs of rows, equal texts included, with key_a < key_b."""
    a, b = f"{key}_a", f"{key}_b"
    members = classes(df, key, text)
    left, right = members.select(F.col(key).alias("_a"), F.col("class_id").alias("_ca")), members.select(F.col(key).alias("_b"), F.col("class_id").alias("_cb"))
    equal = left.join(right, (F.col("_ca") == F.col("_cb")) & (F.col("_a") < F.col("_b"))).select(F.col("_a").alias(a), F.col("_b").alias(b))
    linked = class_pairs(df, key, text, threshold, words).join(left, F.col("class_a") == F.col("_ca")).join(right, F.col("class_b") == F.col("_cb"))
    return equal.unionByName(linked.select(F.least("_a", "_b").alias(a), F.greatest("_a", "_b").alias(b)))


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def groups(df: DataFrame, key: str = "row_id", text: str = "text", threshold: tuple[int, int] = (4, 5), words: int = 5) -> DataFrame:
    """(key, class_id, group_id, n_links): one row for each row with text.

    group_id is the least key of all rows that links connect; n_links counts the rows of other or
    equal text that are linked to the row itself.
    """
    ensure_checkpoint_dir(df.sparkSession)
    members = classes(df, key, text).checkpoint()
    pairs = class_pairs(df, key, text, threshold, words).checkpoint()
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(pairs.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    linked = both.join(sizes.select(F.col("class_id").alias("other"), "size"), "other").groupBy("class_id").agg(F.sum("size").alias("linked"))
    root = components(pairs, "class_a", "class_b").select(F.col("node").alias("class_id"), "root")
    about = sizes.join(linked, "class_id", "left").join(root, "class_id", "left")
    about = about.select("class_id", F.coalesce("root", "class_id").alias("group_id"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(about, "class_id").select(key, "class_id", "group_id", "n_links")
