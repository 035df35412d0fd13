"""Exact byte-level BPE by an Aho-Corasick automaton over the vocabulary.

The automaton is a trie with failure links whose nodes already hold the tokens that end there.
A sequence of tokens is the BPE encoding of its bytes exactly when each adjacent pair is, so the
last token of every prefix can be found from left to right among the tokens that end there: one
pass, no merge loop. Texts are first cut into pre-tokens; each distinct pre-token is encoded once
for a worker and then looked up.

For vocabularies that are applied by longest match (word pieces), LongestMatch does the same with
precomputed emissions at the failure links, in time linear in the text. Greedy applies it to a
byte-level vocabulary, which gives an upper estimate: longest match is not BPE.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

import ahocorasick
import regex
import tiktoken

from .scan import tokenizer_dir

#: The public pattern that cuts text into pre-tokens for the byte_bpe vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 1_000_000
#: Pre-tokens of more characters (scripts without spaces) are seldom met twice and are not kept.
KEPT = 24


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (i, len(token)))
        self.trie.make_automaton()
        self.pre = regex.compile(PATTERN)
        self.ids_of: dict[str, list[int]] = {}
        self.n_of: dict[str, int] = {}
        self.native: tiktoken.Encoding | None = None
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge(self, data: bytes) -> list[int]:
        """BPE of a few bytes by its definition: the pair of lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, token in self.trie.iter(data.decode("latin-1")):
            ending[end + 1].append(token)
        last = [-1] * (n + 1)
        for end in range(1, n + 1):
            for i, size in ending[end]:
                before = end - size
                if before == 0 or (last[before] >= 0 and self._may_follow(last[before], i)):
                    last[end] = i
                    break
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return tuple(reversed(out))

    def pieces(self, text: str) -> list[str]:
        return self.pre.findall(text)

    def _merge_loop(self, piece: str) -> list[int]:
        """The library's merge loop: the same ids, faster for a single piece than the trie in Python."""
        if self.native is None:
            self.native = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self.native._encode_single_piece(piece.encode("utf-8", "replace"))

    def encode_into(self, text: str, out) -> None:
        """Append the ids of a text to a list or array."""
        known = self.ids_of
        extend = out.extend
        for piece in self.pre.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._merge_loop(piece)
                if len(piece) <= KEPT:
                    if len(known) >= MEMO:
                        known.clear()
                    known[piece] = ids
            extend(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        self.encode_into(text, out)
        return out

    def count(self, text: str, trie: bool = True) -> int:
        """Tokens of a text; trie=False leaves long pre-tokens to the library's merge loop."""
        total, known = 0, self.n_of
        found = self.pre.findall(text)
        try:
            return sum(map(known.__getitem__, found))
        except KeyError:
            pass
        for piece in found:
            n = known.get(piece)
            if n is None:
                n = len(self.encode_piece(piece)) if trie or len(piece) <= KEPT else len(self._merge_loop(piece))
                if len(piece) <= KEPT:
                    if len(known) >= MEMO:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def decode(self, ids) -> str:
        """The raw bytes of all tokens, concatenated and then read as UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(name: str = "byte_bpe_50k", folder: str | None = None) -> ByteBpe:
    """One encoder for each worker process."""
    with open(f"{folder or tokenizer_dir()}/{name}.tiktoken", "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class LongestMatch:
    """Greedy longest match in linear time: failure links that carry the tokens to emit.

    Each node holds the tokens to emit when no child fits and the node to go on from. A word that
    cannot be covered gives [unknown]. marker is put before every token but a word's first.
    """

    def __init__(self, vocabulary: dict[str, int], unknown: int = -1, marker: str = "##"):
        self.unknown = unknown
        self.child: list[dict[str, int]] = [{}]
        token: list[int | None] = [None]

        def grow(at: int, word: str) -> int:
            for c in word:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    token.append(None)
                at = self.child[at][c]
            return at

        self.inner = len(self.child)
        self.child.append({})
        token.append(None)
        for word, i in vocabulary.items():
            inner = word.startswith(marker) and len(word) > len(marker)
            token[grow(self.inner if inner else 0, word[len(marker) :] if inner else word)] = i
        n = len(self.child)
        self.link: list[int | None] = [None] * n
        self.emit: list[tuple[int, ...]] = [()] * n
        todo = deque((0, self.inner))
        while todo:
            at = todo.popleft()
            for c, to in self.child[at].items():
                if token[to] is not None:
                    self.link[to], self.emit[to] = self.inner, (token[to],)
                else:
                    z, sent = self.link[at], self.emit[at]
                    while z is not None and c not in self.child[z]:
                        sent, z = sent + self.emit[z], self.link[z]
                    if z is not None:
                        self.link[to], self.emit[to] = self.child[z][c], sent
                todo.append(to)

    def encode(self, word: str) -> list[int]:
        out: list[int] = []
        at = 0
        for c in word:
            while c not in self.child[at]:
                if self.link[at] is None:
                    return [self.unknown]
                out += self.emit[at]
                at = self.link[at]
            at = self.child[at][c]
        while at != self.inner:
            if self.link[at] is None:
                return [self.unknown] if word else []
            out += self.emit[at]
            at = self.link[at]
        return out

    def count(self, word: str) -> int:
        return len(self.encode(word))


class Greedy:
    """Longest match over the pre-tokens of a byte-level vocabulary: what a tokenizer without merges would count."""

    def __init__(self, exact: ByteBpe):
        words = {token.decode("latin-1"): i for token, i in exact.ranks.items()}
        self.pre, self.match, self.n_of = exact.pre, LongestMatch(words | {f"##{w}": i for w, i in words.items()}), {}

    def count(self, text: str) -> int:
        total = 0
        for piece in self.pre.findall(text):
            n = self.n_of.get(piece)
            if n is None:
                if len(self.n_of) >= MEMO:
                    self.n_of.clear()
                n = self.n_of[piece] = self.match.count(piece.encode("utf-8", "replace").decode("latin-1"))
            total += n
        return total


@lru_cache(maxsize=2)
def load_greedy(name: str = "byte_bpe_50k", folder: str | None = None) -> Greedy:
    return Greedy(load(name, folder))
