import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from whitebrook.operators import corpus as co
from whitebrook.schemas import CORPUS, MANIFEST, RAW
from whitebrook.sources import adapters, sinks, tables


@pytest.fixture(scope="module")
def raw(spark):
    long = lambda i: f" {i} " + "słowo " * 100 + " "
    rows = [(i, "wikipedia", long(i % 7), None, None) for i in range(30)] + [(100 + i, "fineweb", long(i), "pl", s) for i, s in enumerate([None, 0.0, float("nan"), 0.49, 0.5, 0.9] * 6)]
    rows += [(200 + i, "oasst", long(i), lang, None) for i, lang in enumerate(["pl", None, "PL", "en", "pl"])] + [(300, "wikipedia", "short", None, None), (301, "wikipedia", None, None, None), (302, None, long(1), None, None)]
    return spark.createDataFrame(rows, RAW).repartition(5)


def test_gates(spark, raw):
    assert adapters.SOURCES.keys() == {"wikipedia", "fineweb", "oasst"}
    found = {name: {r.row_id for r in make().select("row_id").collect()} for name, make in adapters.sources_of(raw).items()}
    assert found["wikipedia"] == {*range(30), 300, 301} and found["oasst"] == {200, 204}
    assert found["fineweb"] == {100 + i for i in range(36) if i % 6 != 3}


@pytest.mark.parametrize("partitions", [1, 7])
def test_mix_is_the_same_whatever_the_partitions(spark, raw, partitions):
    rows = raw.repartition(partitions)
    tiers = adapters.tiers(10, 8, 4, 12)
    got = [tuple(r) for r in co.mix(tiers, adapters.sources_of(rows), 7, max_chars=520).orderBy("row_id").collect()]
    want = []
    every = {r.row_id: (r.text or "").strip()[:520] for r in raw.collect()}
    order = lambda ids: sorted(ids, key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    web = order(100 + i for i in range(36) if i % 6 != 3)
    for tier, tag, ids in (("wikipedia", "wikipedia", order(range(30))[:10]), ("fineweb", "fineweb", web[:8]), ("oasst", "oasst", order([200, 204])), ("fineweb_more", "fineweb", web[8:20])):
        want += [(tier, tag, i) for i in ids]
    assert got == [(n, *w, every[w[2]], hashlib.sha256(every[w[2]].encode()).hexdigest()[:24], len(every[w[2]])) for n, w in enumerate(want)]
    assert co.shortfalls(spark.createDataFrame(got, "row_id long, tier string, source string, source_row long, text string, sha string, n_chars long"), tiers) == [("oasst", 4, 2)]


def test_fingerprints(spark):
    shas = [hashlib.sha256(str(i % 40).encode()).hexdigest()[:24] for i in range(100)]
    df = spark.createDataFrame([(s,) for s in shas], "sha string")
    assert co.fingerprint(df.repartition(7)).first()[0] == hashlib.sha256("\n".join(sorted(shas)).encode()).hexdigest()
    tree = {co.fingerprint_tree(df.repartition(n)).first()[0] for n in (1, 5)}
    assert len(tree) == 1 and tree != {co.fingerprint_tree(df.limit(99)).first()[0]}
    empty = df.limit(0)
    assert co.fingerprint(empty).first()[0] == co.fingerprint_tree(empty).first()[0] == hashlib.sha256(b"").hexdigest()


def test_manifest_and_sinks(spark, raw, tmp_path):
    targets = dict(zip(("wikipedia", "fineweb", "oasst", "fineweb_more"), (10, 8, 4, 12)))
    corpus = co.mix(adapters.tiers(*targets.values()), adapters.sources_of(raw))
    path, made = str(tmp_path / "corpus"), []

    def make():
        made.append(1)
        return corpus

    for _ in range(2):
        got = sinks.once(spark, path, make, CORPUS)
    assert made == [1] and got.schema.names == CORPUS.names and got.count() == 32
    assert "zstd" in next((tmp_path / "corpus").glob("*.parquet")).name
    sinks.json_lines(sinks.typed(co.manifest(corpus, targets, 42), MANIFEST), str(tmp_path / "manifest"), "overwrite")
    m = tables.json_lines(spark, str(tmp_path / "manifest"), MANIFEST).first()
    assert m.mix_actual == {"wikipedia": 10, "fineweb": 8, "oasst": 2, "fineweb_more": 12} and m.mix_sources == {"wikipedia": 10, "fineweb": 20, "oasst": 2}
    assert m.mix_target == {k: v for k, v in targets.items()} and m.n_total == 32 and m.max_chars_per_doc is None
    sinks.rolling(spark.range(2500), str(tmp_path / "rolled"))
    sinks.rolling(spark.range(10), str(tmp_path / "rolled"))
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "rolled").glob("*.parquet")]
    assert sum(sizes) == 2510 and max(sizes) <= sinks.ROWS_PER_FILE


def test_empty_raw_table(spark, raw):
    none = raw.limit(0)
    corpus = co.mix(adapters.tiers(1, 1, 1, 1), adapters.sources_of(none))
    assert corpus.count() == 0 and tuple(co.totals(corpus).first()) == (0, 0)
    assert co.manifest(corpus, {"wikipedia": 1}, 1).first().n_total == 0


def test_tolerant_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"row_id":\n 1, "reason": "x"}')
    (tmp_path / "b.json").write_text('{"row_id": ')
    rows = tables.json_documents(spark, str(tmp_path / "*.json"), CORPUS).collect()
    assert sorted(((r.row_id, r._corrupt is None) for r in rows), key=str) == [(1, True), (None, False)]
    assert [r.length for r in tables.listing(spark, str(tmp_path), "a*").collect()] == [29]
    env = {"A": "kept"}
    (tmp_path / ".env").write_text("# c\nA=new\n\nB = \"q\" \nmalformed\n=x\n")
    assert tables.load_env(str(tmp_path / ".env"), env) == {"A": "new", "B": '"q"'} and env == {"A": "kept", "B": '"q"'}
    assert tables.load_env(str(tmp_path / "none"), {}) == {}
    with pytest.raises(KeyError, match="nowhere"):
        adapters.read(spark, str(tmp_path), "nowhere")
