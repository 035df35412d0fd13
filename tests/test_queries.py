"""Every query of the core over small tables, against its SQL where it has one."""

import datetime as dt
import hashlib
import importlib.util
import math
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from whitebrook.plans import oracle, queries


def cases():
    day = dt.datetime(2025, 3, 1)
    texts = [None, "", " \n\t ", " x ", "Zdanie. Drugie zdanie, dość długie? Tak! " * 20, "słowo\n\n" * 90, "a\nbb\n\nccc" * 80, "😀 漢字 " * 150, ". , start " * 60, "tak\n" + "długi wiersz bez końca " * 30]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()[:24]
    corpus = [(i, ("wikipedia", "fineweb", "oasst", "inne")[i % 4], f"{t} {i // 20}" if t else t, sha(t), None if i % 9 == 0 else i, (None, "pl", "en", "pl")[i % 4], None, (None, 0.0, 0.3, 0.8, float("nan"))[i % 5]) for i, t in enumerate(texts * 6)]
    documents = [(i, t, ("pl", None, "und")[i % 3], " Fineweb ", len(t or "")) for i, t in enumerate(texts)]
    chunks = [("kawałek", sha(texts[4]), 0, "s", "x"), ("kawałek", sha(texts[4]), 0, "s", "x"), ("inny", "gone", 1, None, "y")]
    index = [(i % 50, "s", "w", (None, False, True)[i % 3], (queries.MODEL, "qwen_qwen3-embedding-4b")[i % 2], i % 4) for i in range(70)]
    cost = [(i % 6, queries.MODEL if i % 2 else "qwen_qwen3-embedding-4b", None if i == 3 else i * 10, i * 10, i * 0.5, i, 0, 1, day + dt.timedelta(hours=9 * (i % 6)), day) for i in [0, 1, 2, 3, 4, 5, 5, 1]]
    x = np.random.default_rng(1).normal(0.3, 1, (90, 64)) * np.linspace(0.5, 2, 64)
    x[9] = x[8]  # a tie
    return {
        "corpus": (corpus, "row_id long, source string, text string, sha string, n_chars long, lang string, domain string, language_score double"),
        "documents": (documents, "doc_id long, text string, lang string, source string, n_chars long"),
        "chunks": (chunks, "text string, doc_sha string, chunk_idx int, source string, sha string"),
        "embed_index": (index, "row_id long, sha string, source string, skipped boolean, model_slug string, report_id long"),
        "cost_report": (cost, "report_id long, model_slug string, prompt_tokens long, total_tokens long, cost_usd double, n_calls long, n_retried long, n_429 long, flushed_at timestamp, recorded_at timestamp"),
        "embeddings": ([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int"),
        "events": ([(i, float(i)) for i in range(1300)], "event_id long, value double"),
        "nation": ([(i, f"N {i}", 0) for i in range(6)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(i, float(i * 100 - 50)) for i in range(9)], "s_suppkey long, s_acctbal double"),
        "part": ([(i * 53, f"p{i % 3}", f"B{i % 2}", i % 6, 1.0) for i in range(300)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"),
    }


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, (rows, schema) in cases().items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(folder / f"{name}.parquet"))
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in cases():
        db.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return str(folder), db


def plain(rows):
    one = lambda v: round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tables, name):
    folder, db = tables
    got = queries.queries()[name](spark, folder)
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_every_sql_has_a_query_and_the_entry_is_one():
    assert oracle.oracle_sql().keys() <= queries.queries().keys() <= entry.queries().keys()
    assert "topk_whitened" in queries.queries()


def test_a_broken_module_is_not_skipped_and_a_missing_subpackage_is(monkeypatch):
    monkeypatch.setitem(sys.modules, "whitebrook.plans.queries", None)
    with pytest.raises(ImportError):
        entry.queries()
    monkeypatch.undo()
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "whitebrook.llm" else found(n, *a))
    assert entry.queries().keys() == queries.queries().keys()
