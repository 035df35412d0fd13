"""Sources by name: each gives raw rows (row_id, source, text, lang, language_score) after its own gates.

The local raw table stands in for the downloads. A source is a function of the table, so a new one
is an entry in SOURCES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whitebrook.operators import corpus as co

Source = Callable[[DataFrame], DataFrame]


def _named(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda raw: raw.where(F.col("source") == name).select("row_id", "source", "text", "lang", "language_score")


def encyclopedia(raw: DataFrame) -> DataFrame:
    return _named("wikipedia")(raw)


def web(raw: DataFrame) -> DataFrame:
    return _named("fineweb")(raw).where(co.score_gate())


def conversations(raw: DataFrame) -> DataFrame:
    return _named("oasst")(raw).where(co.lang_gate())


SOURCES: dict[str, Source] = {"wikipedia": encyclopedia, "fineweb": web, "oasst": conversations}


def sources_of(raw: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    return {name: lambda f=f: f(raw) for name, f in SOURCES.items()}


def tiers(wikipedia: int, fineweb: int, oasst: int, fineweb_more: int) -> list[co.Tier]:
    """The tiers in their fixed order; the second web tier goes on in the same source where the first ends."""
    return [
        co.Tier("wikipedia", "wikipedia", wikipedia),
        co.Tier("fineweb", "fineweb", fineweb),
        co.Tier("oasst", "oasst", oasst),
        co.Tier("fineweb_more", "fineweb", fineweb_more, skip=fineweb),
    ]


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one source of a raw table; an unknown name raises."""
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; there are {', '.join(SOURCES)}")
    return SOURCES[name](spark.read.parquet(path))
