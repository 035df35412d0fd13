"""Every query over empty tables, over nulls in every column, and over long, repeated and clashing rows."""

import datetime as dt
import hashlib

import pytest

import __spark_entry__ as entry
from whitebrook.llm.queries import queries

NOW = dt.datetime(2025, 3, 1)
SCHEMAS = {
    "corpus": "row_id long, source string, text string, sha string, n_chars long, lang string, domain string, language_score double, ingested_at timestamp",
    "chunks": "text string, doc_sha string, chunk_idx int, source string, sha string, domain string",
    "embed_index": "row_id long, sha string, source string, skipped boolean, model_slug string, report_id long, embedded_at timestamp",
    "cost_report": "report_id long, model_slug string, prompt_tokens long, total_tokens long, cost_usd double, n_calls long, n_retried long, n_429 long, flushed_at timestamp, recorded_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, domain string, fetched_at timestamp, loaded_at timestamp",
    "mix_targets": "source string, target_weight double, max_repeats int",
    "common_words": "lang string, word string, word_rank int",
}
#: Names that the operators use themselves.
CLASHES = ["_key", "_text", "_id", "_s", "_n", "lot", "bucket", "packed", "run", "doc", "a", "b", "n", "k", "word", "part", "rule", "copy", "ids", "class_id", "n_tokens", "_place", "_block", "_piece", "_sha", "_part", "size", "root"]


def save(spark, folder, tables):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(tables.get(name, []), schema)
        for clash in CLASHES:
            if clash not in df.columns:
                df = df.selectExpr("*", f"'clash' as {clash}")
        df.repartition(3).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("nulls"), {name: [(None,) * len(schema.split(", "))] * 3 for name, schema in SCHEMAS.items()})


LONG = "Zdanie o kocie numer 1. " * 20_000
SOLID = "x" * 300_000
TEXTS = [None, "", " \n\t ", LONG, LONG, SOLID, SOLID + "y", "漢字。" * 30_000, "- punkt\n" * 9_000, "🙂" * 5_000, "(" * 20_000, "„" * 5_000, "a b c d e f g", "a b c d e f g", "퟿�\x00 zero"]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()[:24]
    corpus = [(i, "s", t, sha(t), None, None, None, None, NOW) for i, t in enumerate(TEXTS)]
    chunks = [(LONG[:815], sha(LONG), 0, "s", "x", None), (LONG[720:1511], sha(LONG), 1, "s", "x", None), ("x" * 900, sha(SOLID), 0, None, None, None), ("x" * 901, sha(SOLID), 1, None, None, None), ("", sha(LONG), 2, "s", "x", None)]
    documents = [(i, t, None, " S ", None, None, None, None) for i, t in enumerate(TEXTS)]
    index = [(i, "x", "s", None, "m", i % 3, NOW) for i in range(len(TEXTS) + 2)]
    cost = [(i, "m", None if i == 1 else 5, 5, 0.1, 1, 0, 0, NOW, NOW) for i in range(4)]
    tables = {"corpus": corpus * 2, "chunks": chunks * 2, "embed_index": index * 2, "cost_report": cost * 2, "documents": documents, "mix_targets": [("s", 0.5, 1), ("t", 0.5, 2)], "common_words": [("pl", "Zdanie", 1)] * 2}
    return save(spark, tmp_path_factory.mktemp("hard"), tables)


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    rows = entry.queries()[name](spark, empty).collect()
    assert [tuple(r) for r in rows] == ([("all", None, 0, 0)] if name == "p5_budget" else [])


@pytest.mark.parametrize("name", sorted(queries()))
def test_nulls_in_every_column(spark, nulls, name):
    rows = [tuple(r) for r in entry.queries()[name](spark, nulls).collect()]
    if name == "p6_ids":
        assert rows == [(None, [])] * 3
    elif name == "p5_budget":
        assert set(rows) == {(s, None, 3, 0) for s in ("all", "source", "lang", "domain")}
    elif name == "p5_greedy":
        assert rows == [(None, 3, 0, 0)]
    elif name in ("p1_repetition", "p1_shares", "p3_statistics", "p3_words"):
        assert len(rows) == 3 and all(r[0] is None and r[1] == 0 for r in rows)
    else:
        assert rows == []


@pytest.mark.parametrize("name", sorted(queries()))
def test_long_repeated_and_clashing_rows(spark, hard, name):
    rows = [tuple(r) for r in entry.queries()[name](spark, hard).collect()]
    if name == "p1_found":
        assert {r[0] for r in rows} == {3, 4, 5, 6, 7, 8} and len(rows) == 12
    elif name == "p2_found":
        assert set(rows) == {(hashlib.sha256(SOLID.encode()).hexdigest()[:24], 1), (hashlib.sha256(LONG.encode()).hexdigest()[:24], 2)}
    elif name == "p4_found":
        assert sorted(rows) == [(3, 4), (12, 13)]
    elif name == "p4_groups":
        assert len(rows) == len(TEXTS) - 1 and {r[0]: r[2] for r in rows}[4] == 3
    elif name == "p6_ids":
        assert len(rows) == len(TEXTS) and {r[0]: r[1] for r in rows}[0] == []
    elif name in ("p6_roundtrip", "p5_found"):
        assert rows == ([] if name == "p6_roundtrip" else [(0,), (2,), (3,)]) or sorted(rows) == [(0,), (2,), (3,)]
    elif name == "p7_found":
        assert rows == [("t",)]
    elif name == "p8_found":
        assert {k for k, _ in rows}.isdisjoint({0, 1, 2}) and {3, 5, 7, 8, 9, 12} <= {k for k, _ in rows}
    else:
        assert rows
