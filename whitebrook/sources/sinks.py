"""Writers: Parquet with a declared schema, JSON lines, and the rule that what exists is not made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODEC = "zstd"
ROWS_PER_FILE = 1_000


def exists(spark: SparkSession, path: str, mark: str = "/_SUCCESS") -> bool:
    """Whether a write to a path was finished; with mark "" whether there is anything at the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}{mark}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in its order and types; a missing column raises."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def parquet(df: DataFrame, path: str, schema: T.StructType | None = None, mode: str = "overwrite", rows_per_file: int | None = None) -> None:
    out = (typed(df, schema) if schema else df).write.mode(mode).option("compression", CODEC)
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(path)


def rolling(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Appended in files of at most ROWS_PER_FILE rows."""
    parquet(df, path, schema, "append", ROWS_PER_FILE)


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """The table at a path, made first where there is none yet."""
    if not exists(spark, path):
        parquet(make(), path, schema)
    return spark.read.parquet(path)
