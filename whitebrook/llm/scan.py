"""Arrow-batched scans over text columns, shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from whitebrook.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts go through Python; one of few partitions is dealt out to all cores first."""
    return spread(table(spark, sf_dir, name))


def scan(df: DataFrame, columns: list[str], schema: str, per_batch: Callable[..., list]) -> DataFrame:
    """Run per_batch over Arrow batches of the named columns.

    per_batch gets one pyarrow array for each column and gives one list, numpy array or Arrow
    array for each field of schema. Only the named columns reach Python, so extra columns of any
    name do no harm; rows may be added or dropped by per_batch.
    """
    spec = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch(*batch.columns)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, spec)


@lru_cache(maxsize=None)
def is_letter() -> np.ndarray:
    """For each code point, whether it is a Unicode letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=None)
def is_space() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def tokenizer_dir() -> str:
    """Where the public vocabularies are: WHITEBROOK_TOKENIZERS, else the machine's own place."""
    return os.environ.get("WHITEBROOK_TOKENIZERS", "/opt/tokenizers")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names, where no checkpoint folder is set yet.

    Where none is named, a session on one machine gets a folder of its own; on a cluster that raises.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="whitebrook-"))
