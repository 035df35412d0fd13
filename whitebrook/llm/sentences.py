"""Sentence units across languages and scripts by a linear-chain model and Viterbi decoding.

A text is a chain of characters that are each tagged as boundary or inside. Nearly all characters
can only be inside, so the chain is kept at the places that can end a unit: stops with the closing
marks and emoji after them, emoji alone, blank lines, opening and closing quotation marks, and in
Thai whitespace. The states are boundary and inside, outside and within a quotation; within one no
boundary is possible, a transition that leaves a mark without partner costs what its rarity in all
documents tells, and a blank line always ends a unit.

The scores of the places come from a log-linear model that is trained here, without labels: in
texts with capitals, what follows a stop mostly tells whether it ended a sentence, and words that
begin paragraphs tell from names. The same places, stripped of their capitals, train the scores
for texts that are written without; line ends of Thai texts, stripped to spaces, train those of a
script without stops. What is known of words (which begin sentences, which stand before stops that
do not end one, which report a quotation) is counted over all documents whole, by distributed aggregation. Only the weights
are fitted on a sample: at most TRAIN documents, taken in the order of a hash of their key, and at
most TRAIN_CHARS characters of each. The model, its words and weights, has a fixed greatest size; it
is applied to every document whole.

Null, empty and blank texts have no units.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import scan

TRAIN = 2_000
TRAIN_CHARS = 8_000
EPOCHS = 10
MAX_WEIGHTS = 60_000
#: Words of the model, the most frequent ones of all documents; rarer ones are unknown to it (sf0.1 has about 3,000).
MAX_WORDS = 200_000

_EMOJI = r"(?:[\U0001F1E6-\U0001F1FF\U0001F300-\U0001FAFF☀-➿⭐⭕‼⁉](?:[️‍\U0001F3FB-\U0001F3FF\U0001F1E6-\U0001F1FF]|(?<=‍)[\U0001F300-\U0001FAFF☀-➿♀♂])*)"
_CLOSE = r"[”\"»’)\]」』）】›]"
#: Scripts without stops and without spaces between words: Thai and Lao.
_THAI = r"ก-๛ກ-ໟ"
#: What Unicode says ends sentences, in the plane of living scripts.
_STOPS = "".join(c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and regex.match(r"\p{STerm}", c)) + "…"
#: Places that matter, tried in this order at each character that may begin one.
_EVENT = re.compile(
    rf"(?=[\s{_STOPS}\U0001F1E6-\U0001F1FF\U0001F300-\U0001FAFF☀-➿⭐⭕‼⁉„«「『“‹”»’」』›])(?:"
    r"(?P<para>\s*\n[^\S\n]*\n\s*)"
    rf"|(?P<stop>[{_STOPS}]+)(?P<close>{_CLOSE}*)(?P<after>(?:\s*{_EMOJI})*)(?P<gap>\s*)"
    rf"|(?P<emoji>{_EMOJI}(?:\s*{_EMOJI})*)(?P<egap>\s*)"
    r"|(?P<open>[„«「『“‹])"
    r"|(?P<shut>[”»」』›])"
    rf"|(?P<thai>(?<=[{_THAI}])\s+(?=[{_THAI}0-9])|(?<=[0-9])\s+(?=[{_THAI}])))"
)
_BRACKET = re.compile(r"[()（）]|\n\s*\n")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+(?:[.'’][\p{L}\p{M}\p{N}]+)*")
_OPENERS = "„«「『“‹\"'(（[¿¡‚‘"
_FULL = set(_STOPS) - set(".!?…")


class Place:
    """A place that may end a unit: where it ends, the begin of the next, and what stands around it."""

    __slots__ = ("end", "next", "kind", "mark", "word", "cls", "opener", "quoted", "tight", "follow", "report")

    def __init__(self, end: int, next_: int, kind: str, mark: str, word: str, cls: str, opener: bool, quoted: bool, tight: bool, follow: str, report: str):
        self.end, self.next, self.kind, self.mark, self.word, self.cls, self.opener = end, next_, kind, mark, word, cls, opener
        self.quoted, self.tight, self.follow, self.report = quoted, tight, follow, report


def _class(c: str) -> str:
    return "l" if c.islower() else "U" if c.isupper() else "d" if c.isdigit() else "o" if c.isalpha() else "s"


def _word_before(text: str, at: int) -> str:
    """The word that ends at a place, digits as 9; its case is kept only if it is one letter."""
    begin = at
    low = max(0, at - 24)
    while begin > low and not text[begin - 1].isspace() and text[begin - 1] not in "(„«“\"'":
        begin -= 1
    word = text[begin:at]
    if len(word) > 1:
        word = word.lower()
    if any(c.isdigit() for c in word):
        word = "9" if word.isdigit() else "".join("9" if c.isdigit() else c for c in word)
    return word


def _follow(text: str, at: int) -> tuple[str, bool, str]:
    """The class of the first letter or digit from a place on, whether opening marks stand before it, and its word."""
    opener, n = False, len(text)
    while at < n and text[at] in _OPENERS:
        opener, at = True, at + 1
    if at >= n:
        return "e", opener, ""
    c = text[at]
    cls = _class(c)
    m = _WORD.match(text, at, min(n, at + 24)) if cls in "Ul" else None
    word = m[0] if m else ""
    if len(word) == 1 and cls == "U" and text[m.end() : m.end() + 1] == ".":
        word = "A."  # an initial
    return cls, opener, word


def brackets(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each outermost pair of brackets, in order; a blank line closes none and ends the search for their ends."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    depth = {")": 0, "）": 0}
    for m in _BRACKET.finditer(text):
        c = m[0]
        if c in "(（":
            shut = ")" if c == "(" else "）"
            stack.append((shut, m.start()))
            depth[shut] += 1
        elif c in depth:
            while depth[c]:
                shut, begin = stack.pop()
                depth[shut] -= 1
                if shut == c:
                    while out and out[-1][0] > begin:
                        out.pop()
                    out.append((begin, m.end()))
                    break
        else:
            stack.clear()
            depth = dict.fromkeys(depth, 0)
    return out


def places(text: str) -> list[tuple]:
    """Events of a text in order: ("para", end, next), ("open" | "shut", end) and ("may", Place)."""
    out: list[tuple] = []
    spans = iter(brackets(text) if "(" in text or "（" in text else ())
    span = next(spans, None)
    n = len(text)
    for m in _EVENT.finditer(text):
        kind, at = m.lastgroup, m.start()
        while span is not None and span[1] <= at:
            span = next(spans, None)
        if kind == "para":
            out.append(("para", at, m.end()))
            continue
        inside = span is not None and span[0] < at
        if kind == "open":
            # “ closes what „ opens; else it opens
            out.append(("shut" if m[0] == "“" and at and not text[at - 1].isspace() and text[at - 1].isalnum() else "open", m.end()))
        elif kind == "shut":
            out.append(("shut", m.end()))
        elif kind == "thai":
            if not inside:
                before, after = text[at - 1].isdigit(), text[m.end()].isdigit()
                line = "\n" in m[0]
                out.append(("may", Place(at, m.end(), "thai", "line" if line else "space", "9" if before else "", "d" if after else "o", False, False, False, "", "")))
        elif m["stop"]:
            close = m["close"]
            if inside:
                if span[1] > m.end("stop") + len(close):
                    continue  # a stop within brackets
                if ")" not in close and "）" not in close:
                    continue
            quotes = [c for c in close if c not in ")]）】"]
            for _ in quotes:
                out.append(("shut", m.end("close")))
            end, nxt = m.end() - len(m["gap"]), m.end()
            if nxt >= n or (nxt < n and _ends_paragraph(m["gap"])):
                out.append(("para", end, nxt))
                continue
            if end == nxt and text[nxt] in ".,;:!?…)，、；：)":
                continue  # the sentence goes on with its own mark
            cls, opener, follow = _follow(text, nxt)
            stop = m["stop"]
            mark = "。" if stop[0] in _FULL else "…" if len(stop) > 1 and set(stop) == {"."} or "…" in stop else stop[0]
            if mark == "。" and stop[0] in "।॥":
                mark = "।"
            if mark == "…" and (at and "぀" <= text[at - 1] <= "鿿"):
                mark = "。"
            word = _word_before(text, at) if mark in ".…" else ""
            report = text[nxt : nxt + 2] if quotes and not m["gap"] and cls == "o" else ""
            tight = not m["gap"] and not m["after"]
            out.append(("may", Place(end, nxt, "stop", mark, word, cls, opener, bool(close), tight, follow, report)))
        else:
            if inside:
                continue
            gap = m["egap"] or ""
            end, nxt = m.end() - len(gap), m.end()
            if nxt >= n or _ends_paragraph(gap):
                out.append(("para", end, nxt))
                continue
            cls, opener, follow = _follow(text, nxt)
            out.append(("may", Place(end, nxt, "emoji", m["emoji"].strip()[:16], "", cls, opener, False, not gap, follow, "")))
    return out


def _ends_paragraph(gap: str) -> bool:
    return gap.count("\n") > 1


_START = regex.compile(r"\s*[„«“\"(]?(\p{L})")
_START_AT = regex.compile(r"\n\s*\n|[!?]\s")


def _begins(text: str, at: regex.Pattern, what: regex.Pattern, before: int = 0) -> list[str]:
    """what at the begin of the text and after each match of at, as one pattern of both would find it, but faster.

    Of a match of at that begins with a stop, the character before belongs to the match if before is 1.
    """
    m = what.match(text)
    out, free = ([m[1]], m.end()) if m else ([], 0)
    m = at.search(text, free)
    while m:
        begin = m.start()
        found = None if before and text[begin] != "\n" and begin - 1 < free else what.match(text, m.end())
        if found:
            out.append(found[1])
            free = found.end()
        m = at.search(text, free if found else begin + 1)
    return out


def style(text: str) -> str:
    """std: sentences begin with capitals; chat: they don't; unc: the script has none."""
    upper = lower = other = 0
    for c in _begins(text, _START_AT, _START):
        if c.isupper():
            upper += 1
        elif c.islower():
            lower += 1
        else:
            other += 1
    return "unc" if other > upper + lower else "chat" if lower > upper else "std"


def reports_of(behind: dict[str, int], begins: dict[str, int]) -> frozenset[str]:
    """What reports a quotation in a script without spaces: the one or two characters that follow its closing mark at once, and seldom begin a sentence."""
    return frozenset(w for w, n in behind.items() if n > 2 and n > 4 * begins.get(w, 0))


def reporting(p: Place, reports: frozenset[str]) -> bool:
    return bool(p.report) and (p.report in reports or p.report[0] in reports)


def features(p: Place, manner: str, starters: dict[str, int], ties: frozenset[str] = frozenset(), marked: frozenset[str] = frozenset(), reports: frozenset[str] = frozenset()) -> list[str]:
    if p.kind == "thai":
        return ["thai", f"thai|{p.word}", f"thai>{p.cls}"]
    cls = p.cls if not p.opener else "(" + p.cls
    out = [f"{p.kind}|{p.mark if p.kind == 'stop' else ''}|{cls}|{manner}", f"m|{p.mark}", f"c|{cls}|{manner}"]
    if p.kind == "emoji":
        out.append(f"e|{p.mark}|{'l' if cls == 'l' else ''}")
    if p.word or p.mark in ".…":
        size = len(p.word)
        known = p.word if p.word in marked else ""
        out += [f"w|{known}|{p.mark}", f"w|{known}|{p.mark}|{cls}|{manner}", f"n|{min(size, 4)}|{cls}|{manner}"]
        if p.word and p.word[-1].isdigit():
            out.append(f"9|{cls}")
        if "." in p.word:
            out.append(f"dot|{cls}|{manner}")
        if p.word in ties:
            out.append(f"tie|{p.mark}|{cls}")
    if cls == "U":
        out.append(f"x|{starters.get(p.follow, 0)}|{p.mark if p.kind == 'stop' else 'e'}")
    if p.quoted:
        out.append(f"q|{cls}|{manner}")
    if p.tight:
        out.append(f"t|{p.mark if p.kind == 'stop' else 'e'}|{cls}|{manner}")
    if reporting(p, reports):
        out.append("report")
    return out


_CAPITAL = regex.compile(r"(?<=[\p{Ll},]\s)\p{Lu}[\p{L}\p{M}]+")
_FIRST = regex.compile(r"\s*[„«“\"(]?(\p{Lu}[\p{L}\p{M}]*)")
_FIRST_AT = regex.compile(r"\n\s*\n|(?<=\p{Ll})[!?]\s")


def starters_of(texts: list[str]) -> dict[str, int]:
    """1: a word that begins paragraphs, and no capitalised word elsewhere; -1: the other way round; 2: both."""
    first, mid = Counter(), Counter()
    for t in texts:
        first.update(_begins(t, _FIRST_AT, _FIRST, 1))
        mid.update(_CAPITAL.findall(t))
    return {w: 1 if mid[w] * 4 <= first[w] else -1 if first[w] * 8 <= mid[w] else 2 for w in first.keys() | mid.keys() if first[w] + mid[w] > 1} | {"A.": -1}


def _quotes(events: list[tuple]) -> tuple[int, int]:
    """How many quotation marks have no partner in their paragraph, and how many pairs there are."""
    lone = matched = 0
    within = False
    for event in events:
        if event[0] == "open":
            lone += within
            within = True
        elif event[0] == "shut":
            lone += not within
            matched += within
            within = False
        elif event[0] == "para":
            lone += within
            within = False
    return lone + within, matched


#: What follows a stop and a closing mark at once, and a stop alone, in scripts without spaces.
_SCRIPT = r"(?:[^\W\d_A-Za-zÀ-ɏЀ-ӿ]\w?)"
_BEHIND = re.compile(rf"[{_STOPS}][”」』»]({_SCRIPT})")
_BEGINS = re.compile(rf"[{''.join(sorted(_FULL))}]({_SCRIPT})")


def _seen(text: str) -> Counter:
    """What a text tells of its words: (group, word, the word that follows) and how often."""
    out = Counter(("first", w, "") for w in _begins(text, _FIRST_AT, _FIRST, 1))
    out.update(("mid", w, "") for w in _CAPITAL.findall(text))
    for part, pattern in (("behind", _BEHIND), ("begins", _BEGINS)):
        for w in pattern.findall(text):
            out[part, w[0], ""] += 1
            if len(w) > 1:
                out[part, w, ""] += 1
    if style(text) == "std":
        events = places(text)
        out["quote", "lone", ""], out["quote", "matched", ""] = _quotes(events)
        for event in events:
            if event[0] == "may" and event[1].kind == "stop" and event[1].mark in ".…":
                p = event[1]
                if p.cls == "U":
                    out["U", p.word, p.follow] += 1
                elif p.cls == "d" or (p.cls == "l" and not p.opener):
                    out[p.cls, p.word, ""] += 1
    return out


class Kinds:
    """How often a word before a stop is followed by a word that begins sentences, by a name, by another word, by a digit, and by a small letter."""

    def __init__(self, texts: list[str], starters: dict[str, int]):
        self.free, self.name, self.other, self.digit, self.low = Counter(), Counter(), Counter(), Counter(), Counter()
        self.behind, self.begins, self.quote = Counter(), Counter(), Counter()
        groups = {1: self.free, -1: self.name}
        for t in texts:
            for (group, word, follow), n in _seen(t).items():
                if group == "U":
                    groups.get(starters.get(follow, 0), self.other)[word] += n
                elif group in ("d", "l"):
                    (self.digit if group == "d" else self.low)[word] += n
                elif group in ("behind", "begins", "quote"):
                    getattr(self, group)[word] += n

    def unmatched(self) -> float:
        """The score of a transition that leaves a quotation mark without partner: how rare that is among the marks of all documents."""
        lone, matched = self.quote["lone"], self.quote["matched"]
        return math.log((lone + 1) / (lone + 2 * matched + 20))

    def marked(self) -> frozenset[str]:
        """Words that mostly stand before what does not begin a sentence; only these have weights of their own."""
        against = self.name + self.other + self.digit + self.low
        tied = self.name + self.digit + self.low
        ties = self.ties()
        return frozenset(w for w, n in against.items() if n > 2 and w and (2 * tied[w] >= self.free[w] + tied[w] or w in ties))

    def ties(self) -> frozenset[str]:
        """Words whose stop is followed by capitals, but never by a word that begins sentences."""
        return frozenset(w for w in self.name.keys() | self.other.keys() if not self.free[w] and self.name[w] + self.other[w] > 2)


def _label(p: Place, manner: str, starters: dict[str, int], kinds: Kinds, ties: frozenset[str], reports: frozenset[str]) -> int | None:
    """What the surroundings tell of a place in a text with capitals: 1 boundary, 0 inside, None unknown."""
    if p.kind == "thai":
        return 0 if p.word == "9" or p.cls == "d" else 1 if p.mark == "line" else None
    if manner == "chat":
        return None
    if reporting(p, reports):
        return 0
    if p.mark in "。।" and p.kind == "stop":
        return 1
    if manner == "unc":
        if p.kind == "emoji":
            return 0
        if p.mark == ".":
            return 0 if p.cls == "d" or len(p.word) <= 2 else None if p.tight else 1
        return 1
    x = starters.get(p.follow, 0)
    if p.kind == "emoji":
        return 0 if p.cls in "ld" and not p.opener else 1
    if p.cls == "l" and not p.opener:
        return 0
    free, name = kinds.free[p.word], kinds.name[p.word]
    if p.cls == "d" and p.mark in ".…" and not p.opener:
        return 0 if p.tight or kinds.digit[p.word] > max(2, free) else 1 if free else None
    if p.tight and p.mark == "." and (p.cls != "U" or len(p.word) < 3):
        return 0
    if p.mark in "!?":
        return 1
    if p.opener:
        return 1 if free >= name else None
    if p.cls == "U":
        if x == 1:
            return 1 if free >= name else None
        if x == -1:
            return 0 if p.mark == "." and name >= free else 1
        if p.mark == "." and p.word in ties:
            return 0  # what follows this word never begins a sentence elsewhere
        return 1 if free > 4 * name else 0 if name > 4 * free else None
    return None


class Model:
    def __init__(self, weights: dict[str, float], starters: dict[str, int], ties: frozenset[str] = frozenset(), marked: frozenset[str] = frozenset(), reports: frozenset[str] = frozenset(), unmatched: float = -3.0):
        self.weights, self.starters, self.ties, self.marked, self.reports, self.unmatched = weights, starters, ties, marked, reports, unmatched

    def score(self, p: Place, manner: str) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features(p, manner, self.starters, self.ties, self.marked, self.reports)])


def train(texts: list[str], starters: dict[str, int] | None = None, kinds: Kinds | None = None, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit the scores by logistic regression over places whose surroundings tell what they are.

    starters and kinds, what is known of words, are counted from the texts where they are not given.
    """
    starters = starters_of(texts) if starters is None else starters
    kinds = kinds or Kinds(texts, starters)
    ties, marked, reports = kinds.ties(), kinds.marked(), reports_of(kinds.behind, kinds.begins)
    examples: list[tuple[tuple[str, ...], int]] = []
    for t in texts:
        manner = style(t)
        for event in places(t):
            if event[0] != "may":
                continue
            p = event[1]
            y = _label(p, manner, starters, kinds, ties, reports)
            if y is None:
                continue
            examples.append((tuple(features(p, manner, starters, ties, marked, reports)), y))
            if manner == "std" and p.kind != "thai" and p.cls in "Ul" and not p.opener:
                bare = Place(p.end, p.next, p.kind, p.mark, p.word, "l", False, p.quoted, p.tight, p.follow, p.report)
                if not p.quoted and not p.tight:
                    examples.append((tuple(features(bare, "chat", starters, ties, marked, reports)), y))
    weights: dict[str, float] = {"thai": 2.0, "thai|9": -6.0, "thai>d": -6.0, "report": -8.0, "stop|。|o|unc": 4.0}
    sums: dict[str, float] = {}
    order = random.Random(seed)
    examples.sort()
    seen = Counter(examples)
    rows = list(seen.items())
    for epoch in range(epochs):
        order.shuffle(rows)
        for (fs, y), n in rows:
            z = sum(weights.get(f, 0.0) for f in fs)
            g = (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * min(n, 40) ** 0.75
            for f in fs:
                s = sums[f] = sums.get(f, 1.0) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / s**0.5
    if len(weights) > MAX_WEIGHTS:
        weights = dict(sorted(weights.items(), key=lambda x: -abs(x[1]))[:MAX_WEIGHTS])
    return Model(weights, starters, ties, marked, reports, kinds.unmatched())


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text, in characters; the end is after its last character."""
    if not text or text.isspace():
        return []
    events = places(text)
    manner = style(text)
    out_score, in_score, lone = 0.0, -1e9, model.unmatched
    back: list[tuple[int, int, bool]] = []  # where each state came from, and whether outside a boundary was set
    for event in events:
        kind = event[0]
        if kind == "may":
            z = model.score(event[1], manner)
            cut = z > 0
            out_score -= math.log1p(math.exp(-abs(z))) if abs(z) < 30 else 0.0
            back.append((0, 1, cut))
        elif kind == "open":
            stay, enter = out_score + lone, out_score
            came_in = 0 if enter >= in_score else 1
            out_score, in_score = stay, max(enter, in_score)
            back.append((0, came_in, False))
        elif kind == "shut":
            leave, stay = in_score, out_score + lone
            came_out = 1 if leave >= stay else 0
            out_score, in_score = max(leave, stay), in_score + lone
            back.append((came_out, 1, False))
        else:
            leave = in_score + lone
            came_out = 1 if leave > out_score else 0
            out_score, in_score = max(out_score, leave), -1e9
            back.append((came_out, 0, True))
    state = 0 if out_score >= in_score + lone else 1
    cuts: list[tuple[int, int]] = []
    for event, (came_out, came_in, cut) in zip(reversed(events), reversed(back)):
        if event[0] == "para":
            cuts.append((event[1], event[2]))
        elif event[0] == "may" and state == 0 and cut:
            cuts.append((event[1].end, event[1].next))
        state = came_out if state == 0 else came_in
    cuts.reverse()
    out, start = [], len(text) - len(text.lstrip())
    for end, nxt in cuts:
        if end > start:
            out.append((start, end))
            start = nxt
        elif nxt > start:
            start = nxt
    stop = len(text.rstrip())
    if stop > start:
        out.append((start, stop))
    return out


def sample(df: DataFrame, key: str, text: str, limit: int = TRAIN, chars: int = TRAIN_CHARS) -> list[str]:
    """At most limit texts of at most chars characters each, in the order of a hash of the key.

    Only rows whose hash is low enough for about twice limit rows come to the driver, however many tasks there are.
    """
    rows = df.where(F.length(F.trim(text)) > 0).select(F.xxhash64(key).alias("_h"), F.substring(text, 1, chars).alias("_t"))
    share = 2 * limit / max(1, df.count())
    while True:
        low = rows if share >= 1 else rows.where(F.col("_h") < int(share * 2**64) - 2**63)
        found = low.orderBy("_h", "_t").limit(limit).collect()
        if len(found) == limit or share >= 1:
            return [r._t for r in found]
        share *= 4


def statistics(df: DataFrame, texts: list[str], text: str = "text") -> tuple[dict[str, int], Kinds]:
    """starters_of and Kinds over all rows of df, by aggregation.

    Of the words before stops come out those of texts, the sample, and those that can be marked or
    tied; the others have no effect.
    """

    def batch(column):
        seen = Counter()
        for t in column.to_pylist():
            if t and not t.isspace():
                seen.update(_seen(t))
        rows = [(*k, n) for k, n in seen.items()]
        return list(map(list, zip(*rows))) or [[], [], [], []]

    # the counts are small beside the texts; they are kept so that the texts are read once
    seen = scan(df, [text], "part string, word string, follow string, n long", batch).groupBy("part", "word", "follow").agg(F.sum("n").alias("n")).persist()
    try:
        count = lambda *parts: F.sum(F.when(F.col("part").isin(*parts), F.col("n")).otherwise(0))
        words = seen.where(F.col("part").isin("first", "mid")).groupBy("word").agg(count("first").alias("first"), count("mid").alias("mid")).where("first + mid > 1").orderBy(F.desc(F.col("first") + F.col("mid")), "word").limit(MAX_WORDS)
        kind = F.when(F.col("mid") * 4 <= F.col("first"), 1).when(F.col("first") * 8 <= F.col("mid"), -1).otherwise(2)
        known = words.select(F.col("word").alias("follow"), kind.alias("x"))
        starters = {r.follow: r.x for r in known.collect()} | {"A.": -1}

        x = F.when(F.col("follow") == "A.", -1).otherwise(F.coalesce("x", F.lit(0)))
        group = F.when(F.col("part") != "U", F.col("part")).when(x == 1, "free").when(x == -1, "name").otherwise("other")
        before = seen.where(F.col("part").isin("U", "d", "l")).join(known, "follow", "left").select("word", "n", group.alias("part"))
        sums = before.groupBy("word").agg(*(count(c).alias(c) for c in ("free", "name", "other", "d", "l")))
        own = sorted({w for t in texts for _, w, _ in _seen(t)})
        sampled = df.sparkSession.createDataFrame([(w,) for w in own], "word string").withColumn("own", F.lit(True))
        kinds = Kinds([], {})
        told = sums.join(F.broadcast(sampled), "word", "left").where("own or name + other + d + l > 2")
        for r in told.orderBy(F.desc(F.col("free") + F.col("name") + F.col("other") + F.col("d") + F.col("l")), "word").limit(MAX_WORDS).collect():
            for counter, n in ((kinds.free, r.free), (kinds.name, r.name), (kinds.other, r.other), (kinds.digit, r.d), (kinds.low, r.l)):
                if n:
                    counter[r.word] = n
        for r in seen.where("part = 'quote'").select("word", "n").collect():  # two rows
            kinds.quote[r.word] = r.n
        # at most one or two characters each; those that are seldom behind a quotation have no effect
        pairs = seen.where(F.col("part").isin("behind", "begins")).groupBy("word").agg(count("behind").alias("behind"), count("begins").alias("begins")).where("behind > 2")
        for r in pairs.orderBy(F.desc("behind"), "word").limit(MAX_WORDS).collect():
            kinds.behind[r.word], kinds.begins[r.word] = r.behind, r.begins
        return starters, kinds
    finally:
        seen.unpersist()


def fitted(df: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of all rows: words counted over all, weights fitted on the sample."""
    texts = sample(df, key, text)
    return train(texts, *statistics(df, texts, text))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, sent_start, sent_end): every unit of every document, by places in characters (code points)."""
    kind = dict(df.dtypes)[key]
    known = df.sparkSession.sparkContext.broadcast(_plain(model or fitted(df, key, text)))

    def batch(keys, texts):
        loaded = _model(known)
        rows = [(k, a, b) for k, t in zip(keys.to_pylist(), texts.to_pylist()) for a, b in units(t, loaded)]
        return list(map(list, zip(*rows))) or [[], [], []]

    return scan(df, [key, text], f"{key} {kind}, sent_start int, sent_end int", batch)


def _plain(model: Model) -> tuple[dict[str, float], dict[str, int], frozenset[str], frozenset[str], frozenset[str], float]:
    return model.weights, model.starters, model.ties, model.marked, model.reports, model.unmatched


@lru_cache(maxsize=2)
def _loaded(ident: int, known) -> Model:
    return Model(*known.value)


def _model(known) -> Model:
    return _loaded(id(known), known)
