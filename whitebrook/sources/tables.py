"""Readers: projected scans, row counts, dimensions, tolerant JSON, and matrices of other tools."""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, or the named columns of it; only these are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan that has less than half as many partitions as there are cores dealt out to all of them, any other as it is.

    Such a table is small, or one row group; only then is what follows worth a shuffle. Give plain scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def n_rows(df: DataFrame) -> DataFrame:
    """One row with the count; no column is read."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def dimension(df: DataFrame, vector: str = "embedding") -> int | None:
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return row and row[0]


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A row for each JSON file; what cannot be read gives nulls and the text in _corrupt."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of files below a folder by name, sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").orderBy("path")


def matrices(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """(path, shape, values binary little-endian float32) of .npy files below a folder; half precision is widened."""

    @F.pandas_udf("shape array<int>, values binary")
    def parse(contents: pd.Series) -> pd.DataFrame:
        arrays = [np.load(io.BytesIO(c), allow_pickle=False).astype("<f4") for c in contents]
        return pd.DataFrame({"shape": [list(a.shape) for a in arrays], "values": [a.tobytes() for a in arrays]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", parse("content").alias("a")).select("path", "a.shape", "a.values")


def load_env(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a file of KEY=VALUE lines that env (os.environ) does not hold yet; blank, commented and malformed lines are skipped, quotes are kept."""
    env = os.environ if env is None else env
    found = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as lines:
            for line in map(str.strip, lines):
                key, mark, value = line.partition("=")
                if mark and key.strip() and not line.startswith("#"):
                    found[key.strip()] = value.strip()
    for key, value in found.items():
        env.setdefault(key, value)
    return found
