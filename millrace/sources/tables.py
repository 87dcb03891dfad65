"""Data files of tables: writing DataFrames as ZSTD Parquet under a tenant's prefix, statistics, reading a snapshot."""

from __future__ import annotations

import os
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import DataFile, Snapshot
from millrace.sources.files import Files

LETTERS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"  # Crockford's base 32
PLAIN = (T.LongType, T.IntegerType, T.ShortType, T.DoubleType, T.FloatType, T.StringType, T.BooleanType)


def ulid() -> str:
    """26 letters that sort by time: 48 bits of milliseconds and 80 random ones."""
    n = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(LETTERS[n >> 5 * k & 31] for k in range(25, -1, -1))


def write(df: DataFrame, table_dir: str, files: Files, partition: str = "_default") -> list[DataFile]:
    """Writes a DataFrame as it is partitioned, one data file a task, and takes each file's statistics in one pass."""
    if not partition or len(partition.encode()) > 256 or "/" in partition:
        raise ValueError(f"not a partition key: {partition!r}")
    path = f"{table_dir}/data/{partition}/{datetime.now(timezone.utc):%Y/%m/%d}/{ulid()}"
    df.write.option("compression", "zstd").parquet(path)
    sizes = {p: n for p, n, folder in files.list(path) if not folder and p.endswith(".parquet")}
    return statistics(df.sparkSession, sizes, df.schema)


def statistics(spark: SparkSession, sizes: dict[str, int], schema: T.StructType) -> list[DataFile]:
    if not sizes:
        return []
    plain = [f.name for f in schema.fields if isinstance(f.dataType, PLAIN)]
    read = spark.read.schema(schema).parquet(*sizes)
    each = [F.count("*").alias("n")]
    for k, c in enumerate(schema.names):
        each.append(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"nulls{k}"))
        if c in plain:
            each += [F.min(f"`{c}`").alias(f"min{k}"), F.max(f"`{c}`").alias(f"max{k}")]
    rows = read.groupBy(F.col("_metadata.file_name").alias("file")).agg(*each).collect()  # a row for each new file
    by = {p.rpartition("/")[2]: p for p in sizes}
    out = []
    for r in rows:
        d = r.asDict()
        columns = {c: {"min": d.get(f"min{k}"), "max": d.get(f"max{k}"), "nulls": d[f"nulls{k}"]} for k, c in enumerate(schema.names)}
        out.append(DataFile(by[r.file], sizes[by[r.file]], r.n, columns))
    return out


def read(spark: SparkSession, snapshot: Snapshot, files: list[DataFile] | None = None) -> DataFrame:
    """The rows of a snapshot, by its manifest, or those of some of its files."""
    schema = snapshot.struct()
    paths = [f.path for f in (snapshot.files if files is None else files)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)
