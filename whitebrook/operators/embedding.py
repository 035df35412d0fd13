"""Attaching embeddings: a connector with adaptive batches, resume, placeholders and a ledger.

Rows are sent in batches whose size a small state machine steers (Controller): it doubles after a
run of successes, halves on transient failures and on 400, and isolates a row that cannot be
embedded down to a batch of one, whatever the least batch is. Such a row comes out as skipped, with
its reason; placeholders are filled in by a join afterwards. Work is resumed by an anti-join on the
key, so order and number of files do not matter. Calls are an append-only ledger.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from whitebrook.functions.text import TRANSIENT
from whitebrook.schemas import RESULT

Embedder = Callable[[list[str]], tuple[np.ndarray, dict]]


class HttpFailure(Exception):
    def __init__(self, status: int, body: str = ""):
        super().__init__(f"HTTP {status}: {body[:300]}")
        self.status, self.body = status, body


class Unreachable(Exception):
    """The endpoint gave no answer, or none that can be read."""


# --- controller ---


@dataclass(frozen=True)
class Controller:
    """The state between calls; a failure or success gives the next state and what to do."""

    batch: int = 16
    least: int = 1
    most: int = 32
    grow_after: int = 16
    max_attempts: int = 15
    streak: int = 0
    attempt: int = 0
    backoff: float = 1.5

    def _again(self, batch: int, longest: float | None) -> tuple[Controller, str, float]:
        wait = 0.5 if longest is None else self.backoff
        after = self.backoff if longest is None else min(self.backoff * 2, longest)
        state = replace(self, batch=batch, streak=self.streak if batch == self.batch else 0, attempt=self.attempt + 1, backoff=after)
        return state, "raise" if state.attempt > self.max_attempts else "retry", wait

    def failed(self, status: int | None, sent: int) -> tuple[Controller, str, float]:
        """(state, "retry" | "skip" | "raise", seconds to wait) after a failure with sent rows; status None is no answer."""
        if status is None:
            return self._again(self.batch, 60.0)
        if status in TRANSIENT:
            return self._again(max(self.least, sent // 2), 30.0) if sent > self.least else self._again(self.batch, 60.0)
        if status == 400:
            return self._again(max(1, sent // 2), None) if sent > 1 else (replace(self, streak=0), "skip", 0.0)
        return self, "raise", 0.0

    def done(self) -> Controller:
        streak = self.streak + 1
        grow = streak >= self.grow_after and self.batch < self.most
        return replace(self, batch=max(self.least, min(self.most, self.batch * 2)) if grow else max(self.least, self.batch), streak=0 if grow else streak, attempt=0, backoff=1.5)

    def skipped(self) -> Controller:
        return replace(self, batch=max(self.least, self.batch), streak=0, attempt=0, backoff=1.5)


# --- embedders ---


def classify(status: int, body: dict) -> int:
    """The status that an answer without data counts as: the code inside its error if that is transient, else 400."""
    if status != 200 or "data" in body:
        return status
    told = body.get("error") or body
    try:
        code = int(told.get("code"))
    except (AttributeError, TypeError, ValueError):
        return 400
    return code if code in TRANSIENT else 400


def provider_block(order: list[str] | None, ignore: list[str] | None) -> dict | None:
    """What pins and excludes providers, or None if neither is asked for."""
    block: dict = {"order": order, "allow_fallbacks": True} if order else {}
    return (block | ({"ignore": ignore} if ignore else {})) or None


def vectors_of(body: dict, n: int) -> np.ndarray:
    """The vectors of an answer in the order of their index; a wrong number of them raises."""
    data = body["data"]
    if len(data) != n:
        raise ValueError(f"{len(data)} vectors for {n} texts")
    placed = sorted(enumerate(data), key=lambda x: x[1].get("index", x[0]))
    return np.array([d["embedding"] for _, d in placed], np.float32)


@dataclass(frozen=True)
class HttpEmbedder:
    """Posts texts to an endpoint; the key is read on the worker from key_env."""

    url: str
    model: str
    key_env: str = "EMBEDDING_API_KEY"
    timeout: float = 120.0
    order: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, dict]:
        import os

        payload: dict = {"model": self.model, "input": texts, "encoding_format": "float"}
        if block := provider_block(list(self.order), list(self.ignore)):
            payload["provider"] = block
        request = urllib.request.Request(self.url, json.dumps(payload).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_env, '')}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                status, text = answer.status, answer.read().decode()
            body = json.loads(text)
            if (code := classify(status, body)) != 200:
                raise HttpFailure(code, text)
            return vectors_of(body, len(texts)), body.get("usage") or {}
        except urllib.error.HTTPError as e:
            raise HttpFailure(e.code, e.read().decode(errors="replace")) from e
        except (OSError, KeyError, ValueError) as e:
            raise Unreachable(str(e)) from e


@dataclass(frozen=True)
class HashingEmbedder:
    """Offline and deterministic: signed counts of hashed words, scaled to unit length; a text without words gives the first axis."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, dict]:
        out = np.zeros((len(texts), self.dim), np.float32)
        n = 0
        for row, text in zip(out, texts):
            found = text.split()
            n += len(found)
            for word in found:
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
            if not row.any():
                row[0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True), {"prompt_tokens": n, "total_tokens": n, "cost": 0.0}


# --- the connector ---

def drive(rows: list[tuple], embed: Embedder, state: Controller, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[dict, Controller]]:
    """What each call or skip of rows (row_id, sha, source, text) gives, with the state after it."""
    at = 0
    while at < len(rows):
        retried = limited = 0
        while True:
            part = rows[at : at + state.batch]
            try:
                vectors, usage = embed([r[3] or "" for r in part])
                action = "done"
            except (HttpFailure, Unreachable) as e:
                status = getattr(e, "status", None)
                retried += 1
                limited += status == 429
                state, action, wait = state.failed(status, len(part))
                if action == "raise":
                    raise
                reason = str(e)
                if action == "retry":
                    sleep(wait)
                    continue
            break
        row_id, sha, source, text = part[0]
        if action == "skip":
            state = state.skipped()
            yield {"kind": "row", "row_id": row_id, "sha": sha, "source": source, "skipped": True, "n_chars": len(text or ""), "reason": reason[:300]}, state
            yield {"kind": "call", "call_id": f"{row_id}:0", "n_retried": retried, "n_429": limited, "prompt_tokens": 0, "total_tokens": 0, "cost_usd": 0.0}, state
        else:
            state = state.done()
            for (i, s, o, _), v in zip(part, vectors):
                yield {"kind": "row", "row_id": i, "sha": s, "source": o, "embedding": v.tolist(), "skipped": False}, state
            told = {"prompt_tokens": int(usage.get("prompt_tokens", 0)), "total_tokens": int(usage.get("total_tokens", 0)), "cost_usd": float(usage.get("cost", 0.0))}
            yield {"kind": "call", "call_id": f"{row_id}:{len(part)}", "n_retried": retried, "n_429": limited, **told}, state
        at += len(part) if action == "done" else 1


def embed_rows(todo: DataFrame, embed: Embedder, connections: int | None = None, state: Controller = Controller()) -> DataFrame:
    """Rows of RESULT for todo (row_id, sha, source, text): kind "row" for each row, kind "call" for each call.

    connections bounds how many partitions call at once. Calls cost money: write the result to a
    table before anything else is read from it.
    """
    if connections:
        todo = todo.repartition(connections)

    schema = to_arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state
        for batch in batches:
            out = []
            for record, now in drive(list(zip(*(c.to_pylist() for c in batch.columns))), embed, now):
                out.append(record)
            yield pa.RecordBatch.from_pylist(out, schema)

    return todo.select("row_id", "sha", "source", "text").mapInArrow(run, RESULT)


def vectors(result: DataFrame) -> DataFrame:
    return result.where("kind = 'row'").select("row_id", "sha", "source", "skipped", "embedding")


def skips(result: DataFrame) -> DataFrame:
    return result.where("kind = 'row' and skipped").select("row_id", "sha", "source", "n_chars", "reason")


def calls(result: DataFrame, model_slug: str) -> DataFrame:
    return result.where("kind = 'call'").select(F.lit(model_slug).alias("model_slug"), "call_id", "prompt_tokens", "total_tokens", "cost_usd", "n_retried", "n_429")


# --- relations over what is embedded ---


def remaining(corpus: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of corpus that are not in done."""
    return corpus.join(done.select(key), key, "left_anti")


def covered(done: DataFrame, key: str = "row_id") -> DataFrame:
    return done.agg(F.countDistinct(key).alias("rows_covered"))


def attach(done: DataFrame, corpus: DataFrame, key: str = "row_id") -> DataFrame:
    """done with sha and source of its corpus row."""
    return done.join(corpus.select(key, "sha", "source"), key)


def dimension(done: DataFrame, vector: str = "embedding") -> int:
    """The dimension of the first vector; without any vector no placeholder can be made, so it raises."""
    row = done.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if row is None:
        raise ValueError("no row is embedded, so the dimension is not known")
    return row[0]


def fill(corpus: DataFrame, done: DataFrame, dim: int | None = None, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(key, embedding, skipped) for each row of corpus: zeros and skipped where it has no vector."""
    dim = dim or dimension(done, vector)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    both = corpus.select(key).join(done.select(key, vector), key, "left")
    return both.select(key, F.coalesce(vector, zero).alias(vector), F.col(vector).isNull().alias("skipped"))


SUMS = ("n_calls", "prompt_tokens", "total_tokens", "cost_usd", "n_retried", "n_429")


def usage(ledger: DataFrame, by: str = "model_slug") -> DataFrame:
    """Sums of a ledger; rows written several times count once, null counts as 0."""
    once = ledger.distinct()
    return once.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS if c in ledger.columns])


def running_usage(ledger: DataFrame, value: str, time_: str, key: str, by: str = "model_slug", span: str = "day") -> DataFrame:
    """(by, key, time, value, running): value summed from the first row of by on, in the order of (time, key).

    Sums of each span of time give where a span begins, by a window over the few spans; within a
    span a window gives the rest. So one value of by that holds most rows is spread over its spans.
    """
    once = ledger.select(by, key, time_, F.coalesce(value, F.lit(0)).alias(value)).distinct().withColumn("_span", F.date_trunc(span, time_))
    spans = once.groupBy(by, "_span").agg(F.sum(value).alias("_sum"))
    begins = spans.select(F.col(by).alias("_by"), F.col("_span").alias("_at"), (F.sum("_sum").over(Window.partitionBy(by).orderBy("_span")) - F.col("_sum")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(by, "_span").orderBy(time_, key).rowsBetween(Window.unboundedPreceding, 0))
    joined = once.withColumn("_own", own).join(begins, F.col(by).eqNullSafe(F.col("_by")) & F.col("_span").eqNullSafe(F.col("_at")))
    return joined.select(by, key, time_, value, (F.col("_before") + F.col("_own")).alias("running"))
