"""The whole run: corpus, pieces, embeddings, one fit a dimension, registry. What exists is not made again.

Every table lies below one folder and carries granularity in its path, so runs over documents and
over pieces never share one.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import whitebrook
from whitebrook.functions import tokens
from whitebrook.operators import chunking, embedding, whitening
from whitebrook.operators import corpus as co
from whitebrook.plans import catalog
from whitebrook.schemas import CHUNKS, CORPUS, EMBEDDED, LEDGER, MANIFEST, SKIPS
from whitebrook.sources import adapters, sinks, tables


@dataclass(frozen=True)
class Config:
    raw: str
    out: str
    model: str = "qwen/qwen3-embedding-4b"
    granularity: str = "doc"
    prefix: str = "pl_mixed"
    seed: int = 42
    max_chars: int | None = None
    wiki: int = 22_500
    fineweb: int = 22_500
    oasst: int = 156
    fineweb_more: int = 5_000
    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP
    max_tokens: int | None = None
    tokenizer: str | None = None
    dims: tuple[int, ...] = ()
    eps: float = whitening.EPS
    exclude_zero: bool = False
    connections: int | None = None
    controller: embedding.Controller = field(default_factory=embedding.Controller)
    embedder: embedding.Embedder = field(default_factory=embedding.HashingEmbedder)

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"


def slug(model: str) -> str:
    return model.translate(str.maketrans("/:", "__"))


def background_name(model: str, prefix: str, granularity: str, dim: int) -> str:
    short = model.replace("qwen/qwen3-embedding-", "qwen3-").replace("/", "-").replace("-", "_")
    return f"{short}_{prefix}_{granularity}_mrl{dim}"


def build_corpus(spark: SparkSession, cfg: Config) -> DataFrame:
    targets = {"wikipedia": cfg.wiki, "fineweb": cfg.fineweb, "oasst": cfg.oasst, "fineweb_more": cfg.fineweb_more}
    path = cfg.path("corpus")
    if not sinks.exists(spark, path):
        raw = spark.read.parquet(cfg.raw)
        every = co.mix(adapters.tiers(*targets.values()), adapters.sources_of(raw), cfg.seed, cfg.max_chars)
        sinks.parquet(every, cfg.path("corpus_tiers"))
        made = spark.read.parquet(cfg.path("corpus_tiers"))
        sinks.parquet(made, path, CORPUS)
        for name, wanted, found in co.shortfalls(made, adapters.tiers(*targets.values())):
            print(f"tier {name}: {found} of {wanted} rows")
        sinks.json_lines(sinks.typed(co.manifest(made, targets, cfg.seed, cfg.max_chars), MANIFEST).coalesce(1), cfg.path("corpus.manifest"), "overwrite")
    return spark.read.parquet(path)


def items(spark: SparkSession, cfg: Config) -> DataFrame:
    """(row_id, sha, source, text) of what is embedded: the documents, or their pieces numbered from 0."""
    corpus = build_corpus(spark, cfg)
    if cfg.granularity == "doc":
        return corpus.select("row_id", "sha", "source", "text")
    tokenizer = tokens.tokenizer_of(cfg.model, cfg.tokenizer)
    pieces = sinks.once(spark, cfg.path("chunks"), lambda: chunking.chunk_documents(corpus, tokenizer=tokenizer, size=cfg.chunk_size, overlap=cfg.chunk_overlap), CHUNKS)
    key = F.col("row_id") * (1 << 20) + F.col("chunk_idx")  # a document has fewer pieces than that
    return pieces.select(key.alias("row_id"), "sha", "source", "text")


def embed(spark: SparkSession, cfg: Config) -> DataFrame:
    """The filled table of vectors; only rows that no earlier run finished are sent."""
    base = cfg.path(f"{cfg.granularity}/{slug(cfg.model)}")
    wanted = items(spark, cfg)
    if cfg.max_tokens:
        cut = tokens.truncate("text", cfg.max_tokens, tokens.tokenizer_of(cfg.model, cfg.tokenizer))
        wanted = wanted.withColumn("text", cut["text"])  # sha stays that of the whole text
    done = spark.read.schema(EMBEDDED).parquet(f"{base}/vectors") if sinks.exists(spark, f"{base}/vectors") else spark.createDataFrame([], EMBEDDED)
    todo = embedding.remaining(wanted, done)
    if not todo.isEmpty():
        run = f"{base}/runs/{time.time_ns()}"
        sinks.parquet(embedding.embed_rows(todo, cfg.embedder, cfg.connections, cfg.controller), run)
        got = spark.read.parquet(run)
        sinks.rolling(embedding.vectors(got), f"{base}/vectors", EMBEDDED)
        sinks.json_lines(sinks.typed(embedding.skips(got), SKIPS), f"{base}/skips")
        sinks.json_lines(sinks.typed(embedding.calls(got, slug(cfg.model)), LEDGER), f"{base}/ledger")
    vectors = spark.read.schema(EMBEDDED).parquet(f"{base}/vectors")
    return embedding.fill(wanted, vectors)


def fit(spark: SparkSession, cfg: Config) -> catalog.Store:
    store = catalog.Store(spark, cfg.path("backgrounds"))
    filled = embed(spark, cfg)
    native = embedding.dimension(filled)
    dims = cfg.dims or (native,)
    names = {background_name(cfg.model, cfg.prefix, cfg.granularity, d): d for d in dims}
    have = set(store.names())
    todo = {n: d for n, d in names.items() if n not in have}
    if todo:
        began = time.time()
        fits = whitening.fit_ladder(filled, tuple(todo.values()), cfg.eps, exclude_zero=cfg.exclude_zero)
        seconds = round((time.time() - began) / len(todo), 3)
        corpus, own = spark.read.parquet(cfg.path("corpus")), items(spark, cfg)
        about = {
            "corpus_fingerprint_sha256": co.fingerprint(corpus).first()[0],
            "fit_fingerprint_sha256": co.fingerprint(own).first()[0],
            "sample_size_actual": co.counts_map(own).first()[0],
            "embedding_cost": _cost(spark, cfg),
            "max_chars_per_doc": cfg.max_chars,
        }
        for (name, _), bg in zip(todo.items(), fits):
            store.save(bg, catalog.meta_of(bg, name=name, granularity=cfg.granularity, model=cfg.model, native_dim=native, eps=cfg.eps, seconds=seconds, build_script=__name__, **about))
    return store


def _cost(spark: SparkSession, cfg: Config) -> dict | None:
    path = cfg.path(f"{cfg.granularity}/{slug(cfg.model)}/ledger")
    if not sinks.exists(spark, path):
        return None
    row = embedding.usage(tables.json_lines(spark, path, LEDGER)).where(F.col("model_slug") == slug(cfg.model)).first()
    return row and {"prompt_tokens": row.prompt_tokens, "total_tokens": row.total_tokens, "cost_usd": row.cost_usd, "n_calls": row.n_rows, "n_retried": row.n_retried, "n_429": row.n_429}


def run_pipeline(spark: SparkSession, cfg: Config) -> DataFrame:
    """All phases; gives the registry and writes it as JSON and Markdown beside the tables."""
    rows = fit(spark, cfg).registry()
    catalog.registry_json(rows).write.mode("overwrite").text(cfg.path("registry.json"))
    text = catalog.registry_markdown(rows)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(cfg.path("registry.md"))
    return rows


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="whitebrook", description=__doc__)
    defaults = Config("", "")
    p.add_argument("--raw", required=True, help="raw rows (row_id, source, text, lang, language_score) as Parquet")
    p.add_argument("--out", required=True)
    p.add_argument("--dims", default="", help="dimensions, separated by commas; the native one if empty")
    p.add_argument("--granularity", choices=("doc", "chunks"), default="doc")
    for name in ("model", "prefix", "tokenizer"):
        p.add_argument(f"--{name}", default=getattr(defaults, name))
    for name in ("seed", "max_chars", "wiki", "fineweb", "oasst", "fineweb_more", "chunk_size", "chunk_overlap", "max_tokens", "connections"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(defaults, name))
    for name in ("start", "min", "max"):
        p.add_argument(f"--{name}-batch", type=int)
    p.add_argument("--eps", type=float, default=defaults.eps)
    p.add_argument("--exclude-zero", action="store_true")
    p.add_argument("--url", help="embedding endpoint; without one the offline embedder is used")
    p.add_argument("--timeout", type=float, default=120.0)
    p.add_argument("--provider-order", default="")
    p.add_argument("--ignore-providers", default="")
    p.add_argument("--env", default=".env")
    return p


def options(text: str) -> tuple[str, ...]:
    """The trimmed entries of a list with commas, without the empty ones."""
    return tuple(x for x in (part.strip() for part in text.split(",")) if x)


def config(argv: list[str] | None = None) -> Config:
    a = vars(parser().parse_args(argv))
    tables.load_env(a.pop("env"))
    url, timeout, order, ignore = a.pop("url"), a.pop("timeout"), options(a.pop("provider_order")), options(a.pop("ignore_providers"))
    batches = {to: a.pop(f"{name}_batch") for name, to in (("start", "batch"), ("min", "least"), ("max", "most"))}
    embedder = embedding.HttpEmbedder(url, a["model"], timeout=timeout, order=order, ignore=ignore) if url else embedding.HashingEmbedder()
    controller = embedding.Controller(**{k: v for k, v in batches.items() if v is not None})
    return Config(**a | {"dims": tuple(map(int, options(a["dims"]))), "embedder": embedder, "controller": controller})


def main(argv: list[str] | None = None) -> None:
    cfg = config(argv)
    spark = SparkSession.builder.appName("whitebrook").getOrCreate()
    whitebrook.ship(spark)
    run_pipeline(spark, cfg).select("name", "dim", "n_fit", "top_ev_ratio_pre").show(truncate=False)
