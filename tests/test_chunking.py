import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from whitebrook.operators import chunking as ch

words = lambda parts: [len(x.split()) for x in parts]
chars = lambda parts: list(map(len, parts))
TEXTS = st.text(st.sampled_from("ab .?!\n,;"), max_size=200)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(4, 30), st.integers(0, 3))
def test_pieces_fit_cover_and_stand_in_the_text(text, size, overlap):
    pieces = ch.split(text, chars, size, overlap)
    assert all(p and p == p.strip() and len(p) <= size for p in pieces)
    at = 0
    for p in pieces:  # in order, and nothing but whitespace is lost
        found = text.find(p, max(0, at - overlap - size))
        assert found >= 0
        at = max(at, found + len(p))
    lost = lambda t: re.sub(r"\s", "", t)
    assert set(lost(text)) == set(lost("".join(pieces)))
    if overlap == 0:
        assert lost("".join(pieces)) == lost(text)


def test_separators_stay_at_the_start_or_the_end():
    assert ch.split("aa. bb. cc", chars, 5, 0, (". ", "")) == ["aa", ". bb", ". cc"]
    assert ch.split("aa. bb. cc", chars, 5, 0, (". ", ""), keep="end") == ["aa.", "bb.", "cc"]


def test_overlap_is_made_of_whole_pieces():
    text = " ".join(f"w{i}" for i in range(10))
    got = ch.split(text, words, 4, 1)
    assert got[0].split()[-1] == got[1].split()[0] and all(len(p.split()) <= 4 for p in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=6), max_size=12))
def test_merge_tiny(chunks):
    out, pending = [], ""
    for c in chunks:
        c = f"{pending}\n\n{c}" if pending else c
        pending = c if len(c) < 4 else ""
        if not pending and len(c) >= 4:
            out.append(c)
    if pending:
        out = [*out[:-1], f"{out[-1]}\n\n{pending}"] if out else [pending]
    assert ch.merge_tiny(chunks, 4) == out


def test_columns(spark):
    fragments = ["first. ", ". second", '?!"  third', ".no space", "», x", "é"]
    df = spark.createDataFrame([(1, fragments), (2, []), (3, None), (4, [". only"])], "k int, c array<string>")
    got = {r.k: r.c for r in df.select("k", ch.strip_fragments("c").alias("c")).collect()}
    assert got == {1: ["first. ", "second", "third", ".no space", "x", "é"], 2: [], 3: None, 4: [". only"]}
    folded = {r.k: r.c for r in df.select("k", ch.fold_tiny("c", 4).alias("c")).collect()}
    assert folded == {1: ch.merge_tiny(fragments, 4), 2: [], 3: None, 4: [". only"]}


def test_documents(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcde") for _ in range(5)) + "." * (i % 7 == 6) for i in range(900))
    rows = [(1, "s", text, "x"), (2, "s", text, "x"), (3, None, "short", "y"), (4, "s", "", "z"), (5, "s", None, None), (6, "s", " \n ", "w")]
    corpus = spark.createDataFrame([(*r, "clash") for r in rows], "row_id long, source string, text string, sha string, doc_sha string").repartition(3)
    got = ch.chunk_documents(corpus, tokenizer="words", size=64, overlap=8).collect()
    by = {i: sorted((r.chunk_idx, r.text, r.sha) for r in got if r.row_id == i) for i in range(1, 7)}
    assert by[1] == by[2] and [i for i, _, _ in by[1]] == list(range(len(by[1]))) and len(by[1]) > 10
    assert by[3] == [(0, "short", hashlib.sha256(b"short").hexdigest())] and not by[4] and not by[5] and not by[6]
    own = ch.chunk_documents(corpus, length=words, size=64, overlap=8)
    assert sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, got), key=str)
    s = ch.stats(own, corpus).first()
    assert (s.n_docs, s.n_parents, s.n_chunks, s.mean_per_doc) == (6, 2, len(got), round(len(got) / 6, 2))
    assert tuple(ch.stats(own.limit(0), corpus.limit(0)).first()) == (0, 0, 0, 0.0, 0, 0)
    assert ch.distinct_parents(own).first()[0] == ch.distinct_parents(own, True).first()[0] == 2
    bpe = ch.chunk_documents(corpus).where("row_id = 1").count()
    assert bpe > 1


@pytest.mark.parametrize("keep", ["start", "end"])
def test_a_run_without_boundary_is_cut_hard(keep):
    assert ch.split("x" * 25, chars, 10, 0, keep=keep) == ["x" * 10, "x" * 10, "x" * 5]
