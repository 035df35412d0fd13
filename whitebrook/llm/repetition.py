"""Repetition inside a single document, by compression bands.

Only the letters of a text count, lower-cased and in order. Each text is compressed with zstandard
as a whole and in fixed chunks, and falls in a band by its ratios and by limits for its length and
its letters. Rows whose band rejects them are done; what is left is measured exactly.

The limit is the ratio that a text with a share s of repeated letters cannot exceed. The compressor
searches all places (the window spans the text, and no search ends early) and takes matches of
MATCH bytes or more, so a repeated stretch of w letters is left to matches: SEQUENCE bytes and the
bits of an offset each. The other letters cost no more than by the text's own order-0 code, which
is H bits a letter less what the s cheapest letters must cost at least; SLACK more for a code of
whole bits, and a table of the kinds of letters. Texts of so few kinds of letters that chance
matches do not pay (under MIN_ENTROPY), of more than BAND_LETTERS letters, or of fewer than two
windows have no limit: the first two are measured exactly, the last have no repeats.

Null, empty and letterless texts: 0 letters, share 0.0, band "empty".
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import code_points, is_letter, scan

WINDOW = 30
MIN_SHARE = 0.30
CHUNK_LETTERS = 4096
BAND_LETTERS = 1 << 17
MATCH = 7
SEQUENCE = 2.5
SLACK = 1.04
MIN_ENTROPY = 3.0

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def letters_of(text: str) -> np.ndarray:
    points = code_points(text.lower())
    return points[is_letter()[points]]


def window_hashes(letters: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 64-bit polynomial hash of each run of window letters, by doubling."""
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    block = letters.astype(np.uint64) * _MIX
    block ^= block >> np.uint64(29)
    size, done, out = 1, 0, None
    left = window
    while left:
        if left & 1:
            if out is None:
                out, done = block, size
            else:
                n = len(block) - done
                out, done = out[:n] * power(size) + block[done : done + n], done + size
        left >>= 1
        if left:
            block = block[:-size] * power(size) + block[size:]
            size *= 2
    return out


def repeated_letters(letters: np.ndarray, window: int = WINDOW) -> int:
    """How many letters lie in a run of window letters that also begins earlier in the text."""
    n = len(letters)
    if n <= window:
        return 0
    hashes = window_hashes(letters, window)
    order = np.argsort(hashes, kind="stable")
    found = hashes[order]
    again = order[1:][found[1:] == found[:-1]]
    if not len(again):
        return 0
    edge = np.zeros(n + 1, np.int32)
    edge[again] += 1
    edge[again + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def repeated_share(text: str | None, window: int = WINDOW) -> float:
    letters = letters_of(text or "")
    return repeated_letters(letters, window) / len(letters) if len(letters) else 0.0


@lru_cache(maxsize=None)
def _compressor(log: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionParameters(
        window_log=log, chain_log=log, hash_log=log, search_log=log, min_match=MATCH, target_length=4096, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False
    )
    return zstandard.ZstdCompressor(compression_params=known)


def _packed(letters: np.ndarray) -> tuple[np.ndarray, int]:
    """The letters in one or more bytes each, and that width."""
    kinds, place = np.unique(letters, return_inverse=True)
    width = 1 if len(kinds) <= 256 else 2 if len(kinds) <= 65536 else 4
    return place.astype(f"<u{width}").view(np.uint8), width


def _log(n: int) -> int:
    return max(10, math.ceil(math.log2(n + 1)))


def ratio_limit(data: np.ndarray, width: int, share: float = MIN_SHARE, window: int = WINDOW) -> float:
    """The compressed bytes a byte that data with that share of repeats cannot exceed; infinite where no limit holds."""
    n = len(data)
    counts = np.bincount(data, minlength=1)
    counts = np.sort(counts[counts > 0])[::-1]  # cheapest first
    p = counts / n
    bits = -np.log2(p)
    entropy = float(p @ bits)
    if entropy < MIN_ENTROPY or n > BAND_LETTERS * width:
        return math.inf
    before = np.cumsum(p)
    full = int(np.searchsorted(before, share))
    cheapest = float(p[:full] @ bits[:full]) + (share - (float(before[full - 1]) if full else 0.0)) * float(bits[min(full, len(bits) - 1)])
    literal = min(8.0, SLACK * (entropy - cheapest))
    return literal / 8 + share * (SEQUENCE + _log(n) / 8) / (window * width) + (len(counts) * 0.7 + 24) / n


def compression(letters: np.ndarray, share: float = MIN_SHARE, window: int = WINDOW, chunk: int = CHUNK_LETTERS) -> tuple[float, float, str]:
    """Ratio of the whole, smallest ratio of a chunk, and the band.

    "short" (no room for a repeat), "open" (no limit holds), "repetitive" (a ratio under its limit),
    "incompressible" (the whole costs as much as by a code of single letters) or "plain".
    """
    n = len(letters)
    if n <= window:
        return 1.0, 1.0, "short"
    data, width = _packed(letters)
    limit = ratio_limit(data, width, share, window)
    if limit == math.inf:
        return math.nan, math.nan, "open"
    whole = len(_compressor(_log(len(data))).compress(data.tobytes())) / len(data)
    least, inside = whole, whole <= limit
    if n > chunk:
        size = chunk * width
        for i in range(0, len(data) - size // 4, size):
            part = data[i : i + size]
            ratio = len(_compressor(_log(size)).compress(part.tobytes())) / len(part)
            least = min(least, ratio)
            inside = inside or ratio <= ratio_limit(part, width, share, window)
    p = np.bincount(data) / len(data)
    p = p[p > 0]
    return whole, least, "repetitive" if inside else "incompressible" if whole >= float(-(p @ np.log2(p))) / 8 else "plain"


#: Bands whose texts may hold the wanted share.
MEASURED = ("repetitive", "open")


def judged(text: str | None, window: int = WINDOW, min_share: float = MIN_SHARE, every: bool = False) -> tuple[int, float | None, float | None, str, float | None]:
    """(letters, ratio of the whole, least ratio of a chunk, band, share); the share is measured in the bands that may hold min_share, or in every one."""
    letters = letters_of(text or "")
    n = len(letters)
    if not n:
        return 0, None, None, "empty", 0.0
    whole, least, band = compression(letters, min_share, window)
    share = repeated_letters(letters, window) / n if every or band in MEASURED else None
    return n, None if math.isnan(whole) else whole, None if math.isnan(least) else least, band, share


def repetition(df: DataFrame, key: str = "row_id", text: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE, every: bool = True) -> DataFrame:
    """(key, n_letters, ratio_doc, ratio_chunk, band, repeated_share), a row for each row of df.

    With every the share of each row is measured; without, only in the bands that may hold
    min_share, and it is null in the others.
    """
    kind = dict(df.dtypes)[key]

    def batch(keys, texts):
        return [keys, *map(list, zip(*(judged(t, window, min_share, every) for t in texts.to_pylist())))]

    return scan(df, [key, text], f"{key} {kind}, n_letters long, ratio_doc double, ratio_chunk double, band string, repeated_share double", batch)


def repetitive_rows(df: DataFrame, key: str = "row_id", text: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """Keys of the rows whose share of repeated letters is at least min_share: the bands reject, the rest is measured."""
    return repetition(df, key, text, window, min_share, every=False).where(F.col("repeated_share") >= min_share).select(key)
