import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from whitebrook.operators import embedding as em

GOOD = em.HashingEmbedder(8)
ROWS = [(i, f"s{i}", "src", f"text {i} with words") for i in range(100)]


def quiet(rows, embed, state=em.Controller()):
    waits, records, last = [], [], state
    for record, last in em.drive(rows, embed, state, waits.append):
        records.append(record)
    return records, waits, last


class Flaky:
    """Fails as the list tells, then works; "bad" texts never do."""

    def __init__(self, fails=(), bad=()):
        self.fails, self.bad, self.sent = list(fails), set(bad), []

    def __call__(self, texts):
        self.sent.append(len(texts))
        if self.fails and (f := self.fails.pop(0)) is not None:
            raise f if isinstance(f, Exception) else em.HttpFailure(f)
        if self.bad & set(texts):
            raise em.HttpFailure(400, "too long")
        return GOOD(texts)


def test_batches_double_after_sixteen_successes():
    embed = Flaky()
    records, waits, last = quiet([(i, "", "", "x") for i in range(16 * 16 + 32 * 3)], embed)
    assert embed.sent == [16] * 16 + [32] * 3 and not waits and last.batch == 32
    assert sum(r["kind"] == "call" for r in records) == 19


def test_transient_failures_halve_and_wait():
    embed = Flaky([429, 503, em.Unreachable("x"), 408])
    records, waits, last = quiet(ROWS[:16], embed)
    assert embed.sent[:5] == [16, 8, 4, 4, 2] and waits == [1.5, 3.0, 6.0, 12.0]
    call = next(r for r in records if r["kind"] == "call")
    assert (call["n_retried"], call["n_429"]) == (4, 1) and [r["row_id"] for r in records if r["kind"] == "row"] == list(range(16))


def test_waits_are_capped_and_attempts_bounded():
    with pytest.raises(em.HttpFailure):
        quiet(ROWS[:1], Flaky([429] * 99))
    waits = []
    with pytest.raises(em.HttpFailure):
        list(em.drive(ROWS[:1], Flaky([429] * 99), em.Controller(), waits.append))
    assert len(waits) == 15 and max(waits) == 60.0
    waits = []
    with pytest.raises(em.HttpFailure):
        list(em.drive(ROWS[:64], Flaky([429] * 99), em.Controller(batch=1 << 14, most=1 << 14), waits.append))
    assert 30.0 in waits


@pytest.mark.parametrize("least", [1, 4])
def test_a_poison_row_is_isolated_whatever_the_least_batch(least):
    bad = {ROWS[5][3], ROWS[31][3]}
    records, waits, _ = quiet(ROWS, Flaky(bad=bad), em.Controller(least=least))
    rows = [r for r in records if r["kind"] == "row"]
    assert [r["row_id"] for r in rows] == list(range(100)) and set(waits) == {0.5}
    assert [r["row_id"] for r in rows if r["skipped"]] == [5, 31] and "too long" in next(r["reason"] for r in rows if r["skipped"])


def test_other_failures_raise_at_once():
    for status in (401, 402, 404):
        embed = Flaky([status])
        with pytest.raises(em.HttpFailure):
            quiet(ROWS, embed)
        assert len(embed.sent) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([None, 429, 400, 503]), max_size=12), st.sets(st.integers(0, 59), max_size=4))
def test_every_row_comes_out_once_in_order(fails, bad):
    rows = ROWS[:60]
    records, _, state = quiet(rows, Flaky(fails, {rows[i][3] for i in bad}), em.Controller(max_attempts=1000))
    assert [r["row_id"] for r in records if r["kind"] == "row"] == list(range(60))
    assert bad <= {r["row_id"] for r in records if r["kind"] == "row" and r["skipped"]} and 1 <= state.batch <= 32


def test_classification_and_payload():
    for body, want in (({"data": []}, 200), ({"error": {"code": 429}}, 429), ({"error": {"code": "503"}}, 503), ({"error": {"code": 413}}, 400), ({"error": {"code": "x"}}, 400), ({"error": "busy"}, 400), ({"code": 529}, 529), ({}, 400), ({"error": {"code": None}}, 400)):
        assert em.classify(200, body) == want, body
    assert em.classify(500, {}) == 500
    assert em.provider_block(None, []) is None and em.provider_block(["a"], ["b"]) == {"order": ["a"], "allow_fallbacks": True, "ignore": ["b"]}
    assert em.vectors_of({"data": [{"embedding": [2.0], "index": 1}, {"embedding": [1.0], "index": 0}]}, 2).tolist() == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        em.vectors_of({"data": []}, 1)


def test_http_embedder_against_a_local_server(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    answers, asked = [(200, {"data": [{"embedding": [1.0, 0.0]}], "usage": {"prompt_tokens": 3}}), (200, {"error": {"code": 429}}), (402, {"error": "pay"}), (200, {"data": []})], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["Authorization"]))
            status, body = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("EMBEDDING_API_KEY", "secret")
    embed = em.HttpEmbedder(f"http://127.0.0.1:{server.server_port}/", "m", order=("a",), timeout=5)
    x, usage = embed(["t"])
    assert x.tolist() == [[1.0, 0.0]] and usage == {"prompt_tokens": 3}
    assert asked[0] == ({"model": "m", "input": ["t"], "encoding_format": "float", "provider": {"order": ["a"], "allow_fallbacks": True}}, "Bearer secret")
    for status in (429, 402):
        with pytest.raises(em.HttpFailure) as e:
            embed(["t"])
        assert e.value.status == status
    with pytest.raises(em.Unreachable):
        embed(["t"])
    server.shutdown()


def test_relations(spark):
    corpus = spark.createDataFrame([(*r, "clash") for r in ROWS[:20]], "row_id long, sha string, source string, text string, kind string").repartition(4)
    got = em.embed_rows(corpus.where("row_id < 15"), Flaky(bad={ROWS[3][3]}), 2, em.Controller(max_attempts=99)).cache()
    done, skipped, calls = em.vectors(got), em.skips(got), em.calls(got, "m")
    assert done.count() == 15 and [tuple(r)[:4] for r in skipped.collect()] == [(3, "s3", "src", len(ROWS[3][3]))]
    assert sorted(r.row_id for r in em.remaining(corpus, done).collect()) == list(range(15, 20)) and em.covered(done).first()[0] == 15
    filled = {r.row_id: r for r in em.fill(corpus, done).collect()}
    assert {i for i, r in filled.items() if r.skipped} == {3, *range(15, 20)} and all(len(r.embedding) == 8 and (r.skipped == (not any(r.embedding))) for r in filled.values())
    assert em.attach(done.select("row_id"), corpus).count() == 15
    used = em.usage(calls).first()
    assert used.prompt_tokens == sum(len(r[3].split()) for r in ROWS[:15]) - len(ROWS[3][3].split()) and used.n_retried >= 1
    with pytest.raises(ValueError):
        em.fill(corpus, done.where("skipped"))
    assert em.embed_rows(corpus.limit(0), GOOD).count() == 0


def test_usage_of_repeated_and_null_rows(spark):
    rows = [("a", 1, "2025-01-01 10:00:00", 5), ("a", 1, "2025-01-01 10:00:00", 5), ("a", 2, "2025-01-01 09:00:00", None), ("a", 3, "2025-01-03 00:00:00", 7), ("b", 4, None, 1), ("b", 5, "2025-01-01 00:00:00", 2), (None, 6, "2025-01-01 00:00:00", 9)]
    ledger = spark.createDataFrame(rows, "m string, k int, t string, prompt_tokens long").selectExpr("m as model_slug", "k", "cast(t as timestamp) as t", "prompt_tokens")
    assert {r.model_slug: (r.n_rows, r.prompt_tokens) for r in em.usage(ledger).collect()} == {"a": (3, 12), "b": (2, 3), None: (1, 9)}
    assert {r.k: r.running for r in em.running_usage(ledger, "prompt_tokens", "t", "k").collect()} == {2: 0, 1: 5, 3: 12, 4: 1, 5: 3, 6: 9}


def test_hashing_embedder():
    x, usage = GOOD(["a b", "", "a b"])
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and (x[0] == x[2]).all() and usage["prompt_tokens"] == 4
