"""An append-only dataset as a stream: the same condition language over readStream."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.condition import compile_condition, resolver


def tail(spark: SparkSession, path: str, schema: T.StructType, condition: str | None = None, condvars: Mapping[str, Any] | None = None, max_files: int | None = None) -> DataFrame:
    """Rows as files arrive in a Parquet folder, filtered by a condition."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path)
    return rows if condition is None else rows.where(compile_condition(condition, resolver(schema, condvars or {})).column)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> Any:
    """Appends a stream to a Parquet folder, each row once; stops when all that is there has been taken."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def windowed_counts(spark: SparkSession, path: str, schema: T.StructType, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """(hour, keys, n, s): rows and sums by window of event time as files arrive; rows later than ``late`` behind the latest are dropped when
    the sink appends or updates, and state of closed windows goes."""
    rows = spark.readStream.schema(schema).parquet(path).withWatermark(time, late)
    out = rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    return out.select(F.col("window.start").alias("hour"), *keys, "n", "s")
