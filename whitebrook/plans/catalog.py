"""The store of fitted backgrounds, their meta records, and the registry as rows, JSON and Markdown.

The store is a Parquet table partitioned by name; a fit that is saved again replaces its own
partition only. A background is there when its W is. Listings read names, not arrays.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whitebrook.functions import text as tx
from whitebrook.operators.whitening import EPS, Background, diagnostics
from whitebrook.schemas import BACKGROUNDS, META, REGISTRY
from whitebrook.sources import sinks, tables

STEMS = {"w": "W_A", "mu": "mu_A", "eigvals": "eigvals_A"}


def meta_of(bg: Background, *, name: str, granularity: str, model: str, native_dim: int, eps: float = EPS, seconds: float | None = None, **more) -> dict:
    """The meta record of a fit; more holds the optional fields, among them fit_fingerprint_sha256 (of what was fitted) and corpus_fingerprint_sha256."""
    unknown = set(more) - set(META.names)
    if unknown:
        raise ValueError(f"no such meta fields: {', '.join(sorted(unknown))}")
    own = {"name": name, "granularity": granularity, "embedding_model": model, "embedding_dim": bg.dim, "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
    return own | {"diagnostics": diagnostics(bg, eps, native_dim, seconds)} | more


def _row(bg: Background, meta: dict) -> dict:
    arrays = {c: np.asarray(getattr(bg, c), "<f4").tobytes() for c in STEMS}
    return {"name": meta["name"], "granularity": meta["granularity"], "model": meta["embedding_model"], "dim": bg.dim, **arrays, "meta": {f: meta.get(f) for f in META.names}}


class Store:
    """Backgrounds below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, bg: Background, meta: dict) -> None:
        df = self.spark.createDataFrame([_row(bg, meta)], BACKGROUNDS)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("name").parquet(self.path)

    def table(self) -> DataFrame:
        if not sinks.exists(self.spark, self.path, ""):  # a dynamic overwrite leaves no mark
            return self.spark.createDataFrame([], BACKGROUNDS)
        return self.spark.read.schema(BACKGROUNDS).parquet(self.path).where("w is not null")

    def names(self) -> list[str]:
        return [r.name for r in self.table().select("name").orderBy("name").collect()]  # a row a background

    def load(self, name: str) -> Background:
        """The background of a name; an unknown one raises and tells which there are."""
        r = self.table().where(F.col("name") == name).first()
        if r is None:
            raise KeyError(f"no background {name!r}; there are {', '.join(self.names()) or 'none'}")
        w, mu, eigvals = (np.frombuffer(bytes(r[c]), "<f4") for c in STEMS)
        meta = r.meta.asDict(True)
        return Background(w.reshape(r.dim, r.dim), mu, eigvals, (meta["diagnostics"] or {}).get("n_total") or 0, name, meta)

    def registry(self, parity: bool = False) -> DataFrame:
        return registry(self.table(), parity)

    def export_numpy(self, name: str, folder: str) -> None:
        """The arrays of a background as .npy files and its meta as JSON, for other tools."""
        bg, to = self.load(name), Path(folder) / name
        to.mkdir(parents=True, exist_ok=True)
        for column, stem in STEMS.items():
            np.save(to / f"{stem}.npy", getattr(bg, column))
        (to / f"{name}.meta.json").write_text(json.dumps(bg.meta, ensure_ascii=False, indent=2), encoding="utf-8")

    def import_numpy(self, folder: str, granularity: str) -> None:
        """Every background of a tree of folders with .npy files and a meta record; its files do not tell the granularity."""
        found = tables.matrices(self.spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -2))
        stem = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
        arrays = found.groupBy("name").agg(*[F.max(F.when(stem == s, F.col("values"))).alias(c) for c, s in STEMS.items()], F.max(F.when(stem == STEMS["w"], F.get("shape", F.lit(0)))).alias("dim"))
        metas = tables.json_documents(self.spark, f"{folder}/*/*.meta.json", META).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("name"), F.struct(*META.names).alias("meta"))
        rows = arrays.where("w is not null").join(metas, "name", "left")
        out = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in ("name",)], F.lit(granularity).alias("granularity"), F.col("meta.embedding_model").alias("model"), "dim", *STEMS, "meta")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("name").parquet(self.path)


def registry(backgrounds: DataFrame, parity: bool = False) -> DataFrame:
    """One row of REGISTRY for each background. With parity, a count or ratio of 0 falls through to null, as in the published registry."""
    diag, cost = (lambda f: F.col(f"meta.diagnostics.{f}")), (lambda f: F.col(f"meta.embedding_cost.{f}"))
    quiet = (lambda c: F.nullif(c, F.lit(0))) if parity else (lambda c: c)
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    shape = lambda c, *dims: F.when(F.col(c).isNotNull(), F.array(*dims))
    name = tx.falsy_coalesce("meta.name", "name")
    fields = {
        "name": name,
        "dim": F.coalesce(F.nullif(F.col("meta.embedding_dim"), F.lit(0)), "dim"),
        "n_fit": F.nullif(diag("n_total"), F.lit(0)),
        "rank_full": diag("rank_full_eigvals"),
        "rank_deficient": quiet(diag("rank_deficient_eigvals")),
        "top_ev_ratio_pre": quiet(diag("top_ev_ratio_pre")),
        "embedding_cost_usd": cost("cost_usd"),
        "embedding_tokens": cost("prompt_tokens"),
        "corpus_fingerprint": F.col("meta.corpus_fingerprint_sha256"),
        "path": F.concat(F.lit("backgrounds/"), "name"),
        "W_shape": shape("w", "dim", "dim"),
        "mu_shape": shape("mu", "dim"),
        "eigvals_shape": shape("eigvals", "dim"),
        "size_bytes": (length("w") + length("mu") + length("eigvals")).cast("bigint"),
    }
    fields |= {c: diag(c) for c in ("eigvals_max", "eigvals_min", "fit_s")}
    fields |= {c: F.col(f"meta.{c}") for c in ("embedding_model", "provider", "max_chars_per_doc", "language", "created_at", "build_script")}
    return backgrounds.select(*[fields[f.name].cast(f.dataType).alias(f.name) for f in REGISTRY.fields])


def registry_json(rows: DataFrame) -> DataFrame:
    """One row (registry): {"backgrounds": [...]} in the order of path, nulls kept. There is a row a background, so one group holds them."""
    one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", F.struct(*rows.columns).alias("r")))), lambda x: x["r"]).alias("backgrounds"))
    return one.select(F.to_json(F.struct("backgrounds"), {"ignoreNullFields": "false"}).alias("registry"))


def ordered(rows: DataFrame) -> DataFrame:
    """By model, dimension and name, with null as empty and as 0."""
    return rows.orderBy(F.coalesce("embedding_model", F.lit("")), F.coalesce("dim", F.lit(0)), F.coalesce("name", F.lit("")))


def _dash(c: str) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(tx.DASH))


def registry_lines(rows: DataFrame) -> DataFrame:
    """(line, detail) of each background for the Markdown registry, in order."""
    falsy = lambda c, other: F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0, F.lit(other)).otherwise(F.col(c).cast("string"))
    ratio = F.when(F.coalesce("top_ev_ratio_pre", F.lit(0.0)) == 0, F.lit(tx.DASH)).otherwise(tx.number_text("top_ev_ratio_pre", "%.1f"))
    cost = F.when(F.col("embedding_cost_usd").isNull(), F.lit(tx.DASH)).otherwise(F.concat(F.lit("$"), tx.number_text("embedding_cost_usd", "%.2f")))
    model = F.coalesce("embedding_model", F.lit(tx.DASH))
    cells = [F.format_string("`%s`", F.col("name")), F.format_string("`%s`", model), falsy("dim", "?"), tx.cap_text("max_chars_per_doc"), falsy("n_fit", "?"), _dash("rank_deficient"), ratio, tx.size_text("size_bytes"), cost, tx.time_text("created_at")]
    bullet = lambda label, *parts: F.concat(F.lit(f"- **{label}:** "), *parts)
    shape = lambda c: F.coalesce(F.concat(F.lit("["), F.array_join(F.col(c), ", "), F.lit("]")), F.lit(tx.DASH))
    detail = [
        F.format_string("### `%s`\n", F.col("name")),
        bullet("path", F.format_string("`%s`", F.col("path"))),
        bullet("model", F.format_string("`%s`", model), F.coalesce(F.concat(F.lit(" (via "), F.nullif("provider", F.lit("")), F.lit(")")), F.lit(""))),
        bullet("dim", _dash("dim")),
        bullet("char cap", tx.cap_text("max_chars_per_doc")),
        bullet("shapes", F.lit("W="), shape("W_shape"), F.lit("  ·  mu="), shape("mu_shape"), F.lit("  ·  eigvals="), shape("eigvals_shape")),
        bullet("N fit", falsy("n_fit", "?"), F.lit("  ·  rank full/def.: "), _dash("rank_full"), F.lit(" / "), _dash("rank_deficient")),
        bullet("top_ev_ratio (pre-whitening anisotropy)", ratio),
        F.when(F.col("eigvals_min").isNotNull(), bullet("eigvals range", F.lit("min="), tx.number_text("eigvals_min", "%.3e"), F.lit("  ·  max="), tx.number_text("eigvals_max", "%.3e"))),
        F.when(F.col("embedding_cost_usd").isNotNull(), bullet("embedding cost", F.lit("$"), tx.number_text("embedding_cost_usd", "%.4f"), F.lit("  ·  tokens="), tx.number_text("embedding_tokens", ",d"))),
        F.when(F.coalesce("fit_s", F.lit(0.0)) != 0, bullet("fit wall", F.col("fit_s").cast("string"), F.lit(" s"))),
        bullet("built", tx.time_text("created_at"), F.lit("  ·  by "), F.format_string("`%s`", F.coalesce(F.nullif("build_script", F.lit("")), F.lit("?")))),
        F.when(F.col("corpus_fingerprint").isNotNull(), bullet("corpus fingerprint", F.format_string("`%s…`", F.substring("corpus_fingerprint", 1, 16)))),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return ordered(rows).select(line.alias("line"), F.concat_ws("\n", *detail).alias("detail"))


def registry_markdown(rows: DataFrame, title: str = "Whitening backgrounds") -> str:
    """The registry as text; there is a row a background, so the driver joins the lines."""
    found = registry_lines(rows).collect()
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")
    head = [f"# {title}", "", f"Last scanned: **{now}**  ·  backgrounds: **{len(found)}**", "", "| Name | Model | Dim | Cap | N fit | Rank def. | Top eig / mean | Size | Cost | Built |", "|---|---|---:|---|---:|---:|---:|---:|---:|---|"]
    return "\n".join([*head, *(r.line for r in found), "", "## Details", "", *(f"{r.detail}\n" for r in found)])


def attach_cost(metas: DataFrame, ledger_sums: DataFrame, slug: str = "model_slug") -> DataFrame:
    """metas with the sums of their model's ledger, nulls where there is none; sums are a row a model."""
    sums = ledger_sums.select(slug, F.struct(*[F.col(c).cast(f.dataType).alias(f.name) if (c := f.name) in ledger_sums.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in META["embedding_cost"].dataType.fields]).alias("embedding_cost"))
    return metas.join(sums, slug, "left")


def attach_corpus(metas: DataFrame, about: DataFrame) -> DataFrame:
    """metas with the columns of a one-row frame about the corpus, nulls if it has no row."""
    return metas.withColumn("_one", F.lit(1)).join(F.broadcast(about.limit(1).withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
