"""Per-document text statistics and the rows that are not prose.

Texts longer than chunk characters are cut into chunks that are counted in parallel. A chunk gives
a state of partial counts that merge associatively: sums over the lines that it closes, and the
open line at either edge with its counts, its first and its last characters, so that a line cut by
a chunk's edge is judged as a whole after the merge. A word belongs to the chunk where it begins.
States merge in a tree of FAN children a node; ratios and the rule come last.

Neighbouring short lines of one shape (the same kinds of characters in the same order, figures and
signs among them) without a stop are rows of a table, whatever stands in their columns.

Null, empty and blank texts: counts 0, ratios 0.0, not prose and not a case (share of junk 0.0).
A text that holds a run of more than OVERHANG characters without whitespace is counted whole, as
a chunk's edge inside such a run could count its words twice or cut them.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import code_points, scan

CHUNK = 16_384
OVERHANG = 4_096
FAN = 32
EDGE = 64
MIN_JUNK = 0.60
#: Characters of a line that may be a row of a table without delimiters, and signs and numbers that it must hold.
ROW_CHARS, ROW_MARKS = 200, 3

#: EDGE characters of a line's begin and end are kept, with whitespace folded; marks and ends are shorter.
#: What a line may begin or end with, and what marks damage (fixed values).
_LOG = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
_MARK = re.compile(r"\s*(?:[-*•–—☐☑☒✓✔▪◦·‣]|\d{1,4}[.)]|[a-zA-Z][.)])\s+")
_END = re.compile(r"[.!?…。！？।؟][\"'”»’)\]」』]*\s*$")
_URL = re.compile(r"(?:https?://|www\.)\S+")
_DELIMITERS = ",;|/•·"
_CONSONANTS = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"
_VOWELS = "aeiouyąęóáéíúůýěäöüàâèêëîïôûåæøœAEIOUYĄĘÓÁÉÍÚÝÄÖÜÀÂÈÊËÎÏÔÛÅÆØŒ"
#: The code pages that UTF-8 is most often misread by.
_MISREAD_BY = ("cp1252", "cp1250", "latin-1", "iso8859-2")
LONG = 28
_DAMAGED = re.compile(r"[\ufffd\x80-\x9f]")
_BEYOND = re.compile(r"[^\x00-\x7f]{2,}")
_SIGNS = re.compile(r"[^\w\s]{3,}")
_WORD = re.compile(r"[^\W_]+")


#: Kinds of characters; a code above _OTHER is a letter or a digit.
_SIGN, _BREAK, _SPACE, _TAB, _BAR, _DELIMITER, _OTHER, _CONSONANT, _VOWEL, _DIGIT = range(10)


@lru_cache(maxsize=None)
def _classes() -> np.ndarray:
    """The kind of each code point; letters that are neither consonant nor vowel here have _OTHER."""
    kinds = np.fromiter((_OTHER if (c := chr(i)).isalpha() else _DIGIT if c.isalnum() else _SPACE if c.isspace() else _SIGN for i in range(0x110000)), np.uint8, 0x110000)
    for chars, kind in ((_DELIMITERS, _DELIMITER), (_CONSONANTS, _CONSONANT), (_VOWELS, _VOWEL), ("\n", _BREAK), ("\t", _TAB), ("|", _BAR)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


@lru_cache(maxsize=None)
def _misread() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points that are damage, and that misread the first byte of two, the first of more, and a later byte of a UTF-8 sequence."""
    damage, two, more, later = (np.zeros(0x110000, bool) for _ in range(4))
    damage[[0xFFFD, *range(0x80, 0xA0)]] = True
    for page in _MISREAD_BY:
        for byte in range(0x80, 0xF5):
            at = ord(bytes([byte]).decode(page, "replace"))
            (later if byte < 0xC0 else two if byte < 0xE0 else more)[at] |= byte not in (0xC0, 0xC1)
    return damage, two, more, later


def _usual(c: str) -> bool:
    """Whether misread text usually was this: Latin with accents, basic Cyrillic, quotation marks, dashes and the like."""
    return "\xa0" <= c <= "\u017f" or "\u0400" <= c <= "\u045f" or "\u2010" <= c <= "\u2044" or c in "€™"


def _garbled(word: str) -> bool:
    """Whether a word holds damage, or characters that are the bytes of others."""
    if _DAMAGED.search(word):
        return True
    runs = _BEYOND.findall(word)
    for page in _MISREAD_BY if runs else ():
        for run in runs:
            data = run.encode(page, "replace")
            for i in range(len(data) - 1):
                size = 2 if 0xC2 <= data[i] < 0xE0 else 3 if 0xE0 <= data[i] < 0xF0 else 4 if 0xF0 <= data[i] < 0xF5 else 0
                part = data[i : i + size]
                if size and len(part) == size and all(0x80 <= x < 0xC0 for x in part[1:]) and _usual(part.decode("utf-8", "replace")):
                    return True
    return False


def _damage(line: str) -> int:
    """Characters of the words that hold mis-decoded or meaningless characters."""
    total = 0
    for word in line.split():
        if not word.isascii() and _garbled(word):
            total += len(word)
        elif not word.isalnum() and not _URL.match(word):
            total += sum(len(x) for x in _SIGNS.findall(word) if len(set(x)) > 2 and not set(x) <= set("?!.…,\"”’»)(]-–"))
    return total


_GAP = re.compile(r"(\s)\s+")


def _head(line: str) -> str:
    """The first EDGE characters, each run of whitespace as its first one, so that no indentation hides what follows."""
    head = line[:EDGE]
    return _GAP.sub(r"\1", line)[:EDGE] if _GAP.search(head) else head


def _tail(line: str) -> str:
    tail = line[-EDGE:]
    return _GAP.sub(r"\1", line)[-EDGE:] if _GAP.search(tail) else tail


def shape_of(line: str) -> str:
    """A line as its kinds of characters, each run once: a letters, 9 digits, a space whitespace, signs as they are; "*" if it is long."""
    if len(line) > ROW_CHARS:
        return "*"
    return _RUNS.sub(r"\1", line.translate(_KINDS))


class _Kinds(dict):
    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = self[point] = "a" if c.isalpha() else "9" if c.isalnum() else " " if c.isspace() else c
        return kind


_KINDS = _Kinds()
_RUNS = re.compile(r"([a9 ])\1+")


def _join_shapes(a: str, b: str) -> str:
    return "*" if "*" in (a, b) or len(a) + len(b) > ROW_CHARS else _RUNS.sub(r"\1", a + b)


def _row_shape(shape: str) -> str:
    """The shape by which a line equals its neighbours if both are rows of one table, or "" if it can be none."""
    if "9" not in shape or "*" in shape:
        return ""
    short = re.sub(r"a(?: a)+", "a", shape.strip())
    return short if sum(c not in "a " for c in short) >= ROW_MARKS else ""


# A line's counts: length, letters, digits, whitespace, damaged, long runs, consonants, vowels, words, delimiters, links, tabs, bars, head, tail, shape.
def _lines(text: str) -> tuple[list[list], int, int, int, int]:
    """The counts of each line, and of the whole: words, characters in words, signs, whitespace."""
    points = code_points(text)
    kinds = _classes()[points]
    n = len(kinds)
    starts = np.concatenate(([0], np.flatnonzero(kinds == _BREAK) + 1))
    padded = np.append(kinds, np.uint8(_BREAK))  # a last break, so that no line is empty for reduceat
    per = lambda mask: np.add.reduceat(mask, starts, dtype=np.int32)
    solid = padded >= _OTHER
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inside, digits, consonants, vowels, words = per(solid), per(padded == _DIGIT), per(padded == _CONSONANT), per(padded == _VOWEL), per(begin)
    blank = (padded == _SPACE) | (padded == _TAB) | (padded == _BREAK)
    spaces = per(blank) - 1
    bars, tabs = per(padded == _BAR), per(padded == _TAB)
    delimiters = per(padded == _DELIMITER) + bars
    lengths = np.diff(np.append(starts, n + 1)) - 1
    long, damaged, links = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    gaps = np.flatnonzero(blank)
    sizes = np.diff(np.concatenate(([-1], gaps))) - 1
    big = sizes >= LONG
    if big.any():
        np.add.at(long, np.searchsorted(starts, gaps[big] - 1, side="right") - 1, sizes[big])
    rows = text.split("\n")
    sign = (padded == _SIGN) | (padded == _DELIMITER) | (padded == _BAR)
    damage, two, more, later = _misread()
    odd, after = damage[points], later[points]
    if after.any():
        odd[: n - 1] |= two[points[: n - 1]] & after[1:]
        odd[: n - 2] |= more[points[: n - 2]] & after[1 : n - 1] & after[2:]
    odd[: n - 2] |= sign[: n - 2] & sign[1 : n - 1] & sign[2:n]
    if odd.any():
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1):
            damaged[i] = _damage(rows[i])
    if "://" in text or "www." in text:
        for i, row in enumerate(rows):
            if "://" in row or "www." in row:
                links[i] = sum(map(len, _URL.findall(row)))
    columns = (lengths, inside - digits, digits, spaces, damaged, long, consonants, vowels, words, delimiters, links, tabs, bars)
    lines = [[*counts, _head(row), _tail(row), shape_of(row)] for counts, row in zip(zip(*(c.tolist() for c in columns)), rows)]
    white = int(spaces.sum()) + len(rows) - 1
    return lines, int(words.sum()), int(inside.sum()), n - white - int(inside.sum()), white


def _join(a: list, b: list) -> list:
    return [x + y for x, y in zip(a[:13], b[:13])] + [_head(a[13] + b[13]), _tail(a[14] + b[14]), _join_shapes(a[15], b[15])]


def junk_of(line: list) -> int:
    """How many characters of a line, its break included, are not running sentences."""
    n, letters, digits, spaces, damaged, long, consonants, vowels, words, delimiters, links, tabs, bars, head, tail, _ = line
    solid = n - spaces
    if solid <= 0:
        return 0
    if _LOG.match(head) or 2 * links >= n or tabs >= 2 or (bars >= 2 and head.lstrip()[:1] == "|"):
        return n + 1
    if 10 * damaged >= 3 * n:
        return n + 1
    if 2 * letters < solid or 2 * long >= n or (5 * consonants >= 3 * letters and 10 * vowels < consonants):
        return n + 1
    if _MARK.match(head) and not _END.search(tail):
        return n + 1
    if delimiters >= 4 and 5 * words <= 16 * (delimiters + 1):
        return n + 1
    return damaged


# A state: characters, words, letters and digits in words, signs, solid characters, common words, junk, lines, lines ending in punctuation, first open line, last open line, edges.
# The edges are the first and the last closed line that is not blank, each as its row shape and the characters that become junk if a neighbour has the same shape.
def _edge(line: list) -> list:
    shape, junk = _row_shape(line[15]) if line[0] <= ROW_CHARS else "", junk_of(line)
    return [shape, line[0] + 1 - junk if shape and not _END.search(line[14]) else 0]


def _link(state: list, a: list, b: list) -> list:
    """The edges of the closed lines of a and then of b; rows of one table that meet here become junk."""
    if not a or not b:
        return a or b
    p, q = list(a[-1]), list(b[0])
    if p[0] and p[0] == q[0]:
        state[6] += p[1] + q[1]
        p[1] = q[1] = 0
    return [p if len(a) == 1 else a[0], q if len(b) == 1 else b[-1]]


def _close(state: list, line: list, before: bool = False) -> None:
    """Close a line after those that are closed, or before them."""
    if line[0] > line[3]:
        state[6] += junk_of(line)
        state[7] += 1
        state[8] += bool(_END.search(line[14]))
        own = [_edge(line)]
        state[11] = _link(state, own, state[11]) if before else _link(state, state[11], own)


def _state(text: str, common: frozenset[str]) -> list:
    lines, words, inside, signs, white = _lines(text)
    known = sum(map(common.__contains__, _WORD.findall(text.lower()))) if common else 0
    state = [len(text), words, inside, signs, len(text) - white, known, 0, 0, 0, lines[0], None, []]
    if len(lines) > 1:
        for line in lines[1:-1]:
            _close(state, line)
        state[10] = lines[-1]
    return state


def merge(a: list, b: list) -> list:
    """The state of two neighbouring chunks; associative, in reading order."""
    out = [x + y for x, y in zip(a[:9], b[:9])] + [a[9], a[10], a[11]]
    middle = _join(a[9] if a[10] is None else a[10], b[9])
    if a[10] is None:
        out[9], out[10] = middle, b[10]
    elif b[10] is None:
        out[10] = middle
    else:
        _close(out, middle)
        out[10] = b[10]
    out[11] = _link(out, out[11], b[11])
    return out


FIELDS = "n_chars_true long, word_count long, mean_word_length double, symbol_ratio double, punct_line_share double, common_word_share double, junk_share double, is_prose boolean"


def finish(state: list | None) -> tuple:
    if state is None:
        return (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, False)
    state = list(state)
    if state[10] is not None:
        _close(state, state[10])
    _close(state, state[9], before=True)
    n, words, inside, signs, solid, common, junk, lines, stopped = state[:9]
    share = min(1.0, junk / n) if n else 0.0
    return (n, words, inside / words if words else 0.0, signs / solid if solid else 0.0, stopped / lines if lines else 0.0, common / words if words else 0.0, share, solid > 0 and share < MIN_JUNK)


def measure(text: str | None, common: frozenset[str] = frozenset()) -> tuple:
    return finish(_state(text, common) if text else None)


def common_set(words: DataFrame, limit: int = 100_000) -> frozenset[str]:
    """The reference list as a set; a list of more than limit words is refused."""
    rows = words.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} common words")
    return frozenset(r.word for r in rows)


def quality(df: DataFrame, common: frozenset[str] = frozenset(), key: str = "row_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, n_chars_true, word_count, mean_word_length, symbol_ratio, punct_line_share, common_word_share, junk_share, is_prose).

    One row for each row of df; keys that occur several times with long texts are kept apart by the
    text's digest and come out as often as they went in.
    """
    kind = dict(df.dtypes)[key]
    size = F.coalesce(F.length(text), F.lit(0))

    def short(keys, texts):
        rows = [measure(t, common) for t in texts.to_pylist()]
        return [keys, *map(list, zip(*rows))]

    whole = (size <= chunk) | F.coalesce(F.col(text).rlike(rf"(?:^|\s)\S{{{OVERHANG + 1},}}"), F.lit(False))
    small = scan(df.where(whole), [key, text], f"{key} {kind}, {FIELDS}", short)

    large = df.where(~whole).groupBy(key, text).agg(F.count(F.lit(1)).alias("_n")).withColumn("_sha", F.sha2(text, 256))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / chunk).cast("int")))
    parts = large.select(F.col(key).alias("_key"), "_sha", "_n", F.length(text).alias("_len"), at.alias("_k"), text).select(
        "_key", "_sha", "_n", "_len", "_k", F.substring(F.col(text), F.col("_k") * chunk, F.lit(chunk + OVERHANG + 1)).alias("_part")
    )
    # position k * chunk is one character before the chunk (for the first, substring counts from 1)

    def one(keys, shas, ns, lens, ks, texts):
        states = []
        for k, length, part in zip(ks.to_pylist(), lens.to_pylist(), texts.to_pylist()):
            before, part = (part[0], part[1:]) if k else (" ", part)
            start, end = 0, min(chunk, length - k * chunk)
            if not before.isspace():  # the word that begins in the chunk before ends there
                gone = re.match(rf"\S{{0,{OVERHANG}}}", part).end()
                start = min(gone, end)
            if start < end < len(part) and not part[end - 1].isspace():
                end = re.compile(rf"\S{{0,{OVERHANG}}}").match(part, end).end()
            states.append(json.dumps(_state(part[start:end], common)))
        return [keys, shas, ns, ks, states]

    states = scan(parts.repartition("_key", "_sha", "_k"), ["_key", "_sha", "_n", "_len", "_k", "_part"], f"_key {kind}, _sha string, _n long, _k int, _state string", one)

    @F.pandas_udf(T.StringType())
    def merged(lists: pd.Series) -> pd.Series:
        def fold(rows):
            rows = sorted(((r["_k"], r["_state"]) for r in rows), key=lambda r: r[0])
            state = json.loads(rows[0][1])
            for _, x in rows[1:]:
                state = merge(state, json.loads(x))
            return json.dumps(state)

        return lists.map(fold)

    for _ in range(4):  # FAN ** 4 chunks of CHUNK characters are more than a row can hold
        states = states.groupBy("_key", "_sha", "_n", F.floor(F.col("_k") / FAN).cast("int").alias("_up")).agg(F.collect_list(F.struct("_k", "_state")).alias("_list")).select("_key", "_sha", "_n", F.col("_up").alias("_k"), merged("_list").alias("_state"))

    def last(keys, ns, texts):
        rows = [(k, *finish(json.loads(x))) for k, n, x in zip(keys.to_pylist(), ns.to_pylist(), texts.to_pylist()) for _ in range(n)]
        return list(map(list, zip(*rows)))

    return small.unionByName(scan(states, ["_key", "_n", "_state"], f"{key} {kind}, {FIELDS}", last))


def not_prose(df: DataFrame, common: frozenset[str] = frozenset(), key: str = "row_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Keys of the rows of which at least MIN_JUNK of the characters are not running sentences."""
    return quality(df, common, key, text, chunk).where(F.col("junk_share") >= MIN_JUNK).select(key)
