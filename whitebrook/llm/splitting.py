"""Cutting long texts into overlapping pieces by agglomerative merging, and auditing pieces.

A text is first cut into atoms at its natural boundaries: sentences, lines and paragraphs, long
sentences also at clauses and then at words; a run without any is cut hard. Adjacent atoms are held in a heap by the strength of the boundary
between them, and the weakest boundaries are merged first while the combined size plus the overlap
fits the limit. Each piece but the first then begins 60 to 160 characters before the end of the
piece before it, at the strongest boundary there.

A text that fits the limit is one piece; null, empty and blank texts give none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scan import scan

LIMIT = 900
OVERLAP = (60, 160)
BLOCK = 4_096

#: Strength of a boundary; the number is the rank in the heap.
HARD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

_COARSE = r"(?P<p>\s*\n\s*\n\s*)|(?P<l>[^\S\n]*\n\s*)|(?P<s>[.!?…]+[\"'”»’)\]]*\s+|[。！？।؟]+[”」』）]*\s*)"
_SENTENCES = re.compile(_COARSE)
_ALL = re.compile(_COARSE + r"|(?P<c>[,;:–—]\s+|[，；：、،])|(?P<w>\s+)")
_GRADE = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "c": CLAUSE, "w": WORD}


def boundaries(text: str, start: int = 0, stop: int | None = None, fine: bool = True) -> list[tuple[int, int]]:
    """(place, strength) of each natural boundary inside the span; the place is where the next atom begins."""
    stop = len(text) if stop is None else stop
    found = (_ALL if fine else _SENTENCES).finditer(text, start, stop)
    return [(at, _GRADE[m.lastgroup]) for m in found if (at := m.end()) < stop]


def inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def _atoms(text: str, most: int) -> list[list[int]]:
    """[start, end, strength of the boundary at its end] of each atom, none longer than most.

    Atoms are sentences; one that is longer than half of most is cut at clauses, a part of it that
    still is at words, and a run without boundary that is longer than most hard.
    """
    out: list[list[int]] = []

    def add(start: int, stop: int, grade: int) -> None:
        while stop - start > most:
            out.append([start, start + most, HARD if inside_word(text, start + most) else WORD])
            start += most
        if stop > start:
            out.append([start, stop, grade])

    def divide(start: int, stop: int, grade: int, places: list[tuple[int, int]], level: int) -> None:
        at, inner = start, []
        for place, g in [*places, (stop, grade)]:
            if place < stop and g < level:
                inner.append((place, g))
                continue
            if level == CLAUSE and place - at > most // 2:
                divide(at, place, g, inner, WORD)
            else:
                add(at, place, g)
            at, inner = place, []

    at = 0
    for place, grade in [*boundaries(text, fine=False), (len(text), PARAGRAPH)]:
        if place - at > most // 2:
            divide(at, place, grade, boundaries(text, at, place), CLAUSE)
        else:
            add(at, place, grade)
        at = place
    return out


def cut(text: str | None, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> list[str]:
    """The pieces of a text, in order."""
    text = (text or "").strip()
    if len(text) <= limit:
        return [text] if text else []
    least, most = overlap
    room = limit - most
    atoms = _atoms(text, room)
    n = len(atoms)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    start, end, grade = (list(x) for x in zip(*atoms))
    # a run that is cut hard stays apart from the words before it, or a piece would end inside a word
    whole = [g != HARD for g in grade]
    heap = [(grade[i], end[i + 1] - start[i], i, end[i], end[i + 1]) for i in range(n - 1) if whole[i + 1] or not whole[i]]
    heapq.heapify(heap)
    while heap:
        g, _, i, seam, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[i] != seam or end[j] != stop:
            continue
        if stop - start[i] > room:
            continue
        end[i], grade[i], whole[i] = stop, grade[j], whole[j]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            k = after[i]
            if whole[k] or not whole[i]:
                heapq.heappush(heap, (grade[i], end[k] - start[i], i, end[i], end[k]))
        if before[i] >= 0:
            h = before[i]
            if whole[i] or not whole[h]:
                heapq.heappush(heap, (grade[h], end[i] - start[h], h, end[h], end[i]))
    cores = [(start[i], end[i]) for i in range(n) if alive[i]]
    cores = _wide_first(text, cores, least, room)
    pieces, stop, first = [], 0, 0
    for k, (a, b) in enumerate(cores):
        b = a + len(text[a:b].rstrip())
        begin = a if k == 0 else _begin(text, stop, first, least, most)
        if b > begin and (k == 0 or b > stop):
            pieces.append(text[begin:b])
            stop, first = b, begin
    return pieces


def _wide_first(text: str, cores: list[tuple[int, int]], least: int, room: int) -> list[tuple[int, int]]:
    """Move the first seam so that the first piece can lend an overlap."""
    if len(cores) > 1 and len(text[cores[0][0] : cores[0][1]].rstrip()) < 2 * least:
        (a, _), (_, c) = cores[0], cores[1]
        half = (a + c) // 2
        low, high = max(a + 2 * least, c - room), min(a + room, c - 1)
        near = sorted((abs(p - half), p) for p, _ in boundaries(text, a, c) if low <= p <= high)
        if near:
            return [(a, near[0][1]), (near[0][1], c), *cores[2:]]
        if low <= high and not any(x.isspace() for x in text[a:c]):
            return [(a, high), (high, c), *cores[2:]]
        if c - a <= room + least * 2:
            words = [p for p in range(low, high + 1) if not inside_word(text, p)]
            at = words[len(words) // 2] if words else min(max(half, low), high)
            return [(a, at), (at, c), *cores[2:]]
    return cores


def _begin(text: str, stop: int, first: int, least: int, most: int) -> int:
    """Where a piece begins whose predecessor covers [first, stop)."""
    low, high = max(first, stop - most), stop - least
    if high < low:
        return first
    near = [(g, p) for p, g in boundaries(text, max(0, low - 8), high + 2) if low <= p <= high]
    if near:
        return max(near)[1]
    free = [p for p in range(low, high + 1) if not inside_word(text, p) and not text[p].isspace()]
    return free[-1] if free else (low + high) // 2


def pieces(df: DataFrame, key: str = "sha", text: str = "text", limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, short: bool = False) -> DataFrame:
    """(doc_sha, chunk_idx, text): the pieces of each distinct (key, text), of long rows only unless short.

    A null key is replaced by that of the text, the first 24 hex digits of its sha256, so that no
    row's pieces are lost or mixed with another's. Null texts give no pieces.
    """
    own = F.coalesce(F.col(key), F.substring(F.sha2(F.col(text), 256), 1, 24))
    rows = df.where(F.length(text) > (0 if short else limit)).select(own.alias("_key"), F.col(text).alias("_text"))

    def batch(keys, texts):
        out = [(k, i, p) for k, t in zip(keys.to_pylist(), texts.to_pylist()) for i, p in enumerate(cut(t, limit, overlap))]
        return list(map(list, zip(*out))) or [[], [], []]

    return scan(rows.dropDuplicates(["_key", "_text"]), ["_key", "_text"], "doc_sha string, chunk_idx int, text string", batch)


# --- audit -------------------------------------------------------------------------------------


def places_of(piece: str, text: str) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def wrong(piece: str, index: int, earlier: list[str], text: str, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP, near: int = 0) -> tuple[str, int]:
    """The first of the rules a to f that a piece breaks, else "", and where the piece stands in its row, or near.

    earlier are the pieces with the index before. The row is searched from near on first, so pieces
    in order cost no more than their row is long; all places are looked at only where one breaks a rule.
    """
    least, most = overlap
    if len(piece) > limit:
        return "a", near
    at = text.find(piece, near) if piece else -1
    if at < 0:
        at = text.find(piece) if piece else -1
    if at < 0:
        return "b", near
    if index > 0:
        if not earlier:
            return "c", at
        if not any(p.endswith(piece[:n]) for p in earlier for n in range(least, most + 1) if n <= len(piece) and n <= len(p)):
            return "d", at
    if piece[-1].isalnum() and any(c.isspace() for c in piece[most:]) and inside_word(text, at + len(piece)) and all(inside_word(text, x + len(piece)) for x in places_of(piece, text)):
        return "e", at
    if index > 0 and piece[0].isalnum() and any(c.isspace() for p in earlier for c in p[-most:-least]) and inside_word(text, at) and all(inside_word(text, x) for x in places_of(piece, text)):
        return "f", at
    return "", at


def audit(recorded: DataFrame, rows: DataFrame, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> DataFrame:
    """(doc_sha, chunk_idx, rule): recorded pieces that no correct cut of their row can give.

    recorded has (doc_sha, chunk_idx, text), rows has (sha, text). Equal pieces count once; pieces
    of unknown rows and pieces without sha, index or text never count. Each row is cut by the
    operator; a piece that is the operator's own, after one that is too, is right, and the others
    are held against the rules. Pieces travel in blocks of BLOCK indices with a copy of their row,
    sorted, and are checked as they stream by, so no group is ever gathered.
    """
    pieces_ = recorded.where("doc_sha is not null and chunk_idx is not null and text is not null").select("doc_sha", F.col("chunk_idx").cast("int").alias("chunk_idx"), "text").distinct()
    block = F.floor(F.col("chunk_idx") / BLOCK).cast("int")
    part = pieces_.withColumn("_block", block)
    # the last index of a block is the predecessor of the first of the next
    lent = part.where(F.pmod("chunk_idx", F.lit(BLOCK)) == BLOCK - 1).withColumn("_block", F.col("_block") + 1)
    known = rows.where("sha is not null and text is not null").select(F.col("sha").alias("doc_sha"), F.col("text").alias("_row")).dropDuplicates(["doc_sha"])
    blocks = part.where("_block <> 0").select("doc_sha", "_block").distinct()
    first = known.select("doc_sha", F.lit(0).alias("_block"), F.lit(0).alias("_piece"), F.lit(0).alias("chunk_idx"), F.col("_row").alias("text"))
    later = known.join(blocks, "doc_sha").select("doc_sha", "_block", F.lit(0).alias("_piece"), F.lit(0).alias("chunk_idx"), F.col("_row").alias("text"))
    own = part.unionByName(lent).select("doc_sha", "_block", F.lit(1).alias("_piece"), "chunk_idx", "text")
    placed = first.unionByName(later).unionByName(own).repartition("doc_sha", "_block").sortWithinPartitions("doc_sha", "_block", "_piece", "chunk_idx")
    spec = T._parse_datatype_string("doc_sha string, chunk_idx int, rule string")
    schema = to_arrow_schema(spec)

    def run(batches):
        group, text, own, index, current, earlier, near = None, None, [], None, [], [], 0
        for batch in batches:
            out = []
            for sha, at, is_piece, i, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (sha, at) != group:
                    group, text, own, index, current, earlier, near = (sha, at), None, None, None, [], [], 0
                if not is_piece:
                    text = piece
                    continue
                if text is None:
                    continue
                if i != index:
                    earlier = current if index is not None and i == index + 1 else []
                    index, current = i, []
                current.append(piece)
                if i // BLOCK != at:
                    continue  # lent by the block before
                if own is None:
                    own = cut(text, limit, overlap)
                mine = 0 <= i < len(own) and own[i] == piece and (i == 0 or own[i - 1] in earlier)
                if not mine:
                    rule, near = wrong(piece, i, earlier, text, limit, overlap, near)
                    if rule:
                        out.append((sha, i, rule))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return placed.select("doc_sha", "_block", "_piece", "chunk_idx", "text").mapInArrow(run, spec)
