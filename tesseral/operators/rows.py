"""Row numbers and selection by range, coordinates or mask, by Python's slice rules.

``nrow`` is a column. For Parquet it comes from the scan (file order by name, then row index), at the cost
of a count per file and no shuffle. Renumbering and sorted positions use sums over ranges of rows, never a
window over all rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NROW = "nrow"
RANGE = 1 << 16


#: Coordinates given as a list are sent to all tasks up to this many; larger lists are joined by shuffling.
FEW = 1_000_000


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share, from spark.checkpoint.dir; a local session without one gets a temporary folder."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def read_numbered(spark: SparkSession, path: str, name: str = NROW) -> DataFrame:
    """The rows of a Parquet file or folder, with their numbers."""
    df = spark.read.parquet(path)
    files = df.inputFiles()
    if len(files) <= 1:
        return df.select("*", F.col("_metadata.row_index").alias(name))
    # Row counts per file come from footers alone; the table has one row per file
    counts = df.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__i"))
    return rows.join(offsets, "__file").select(*df.columns, (F.col("__i") + F.col("__at")).cast("long").alias(name))


def slice_of(start: Any, stop: Any, step: Any, n: int, reverse: bool = True) -> tuple[int, int, int]:
    """A slice over n rows; steps below zero only where reading backwards makes sense."""
    step = 1 if step is None else operator.index(step)
    if step == 0:
        raise ValueError("the step must not be zero")
    if step < 0 and not reverse:
        raise ValueError("the step must be positive here")
    return slice(start, stop, step).indices(n)


def query_slice(start: Any, stop: Any, step: Any, n: int) -> tuple[int, int, int]:
    """The rule of conditional reads: a start alone means that one row."""
    if start is not None and stop is None and step is None:
        start = operator.index(start)
        if start < 0:
            start += n
        if not 0 <= start < n:
            raise IndexError("the start is beyond the last row")
        return start, start + 1, 1
    return slice_of(start, stop, step, n, reverse=False)


def in_slice(start: int, stop: int, step: int, at: Column | str = NROW) -> Column:
    c = F.col(at) if isinstance(at, str) else at
    if step > 0:
        inside = (c >= start) & (c < stop)
        return inside if step == 1 else inside & (F.pmod(c - start, F.lit(step)) == 0)
    inside = (c <= start) & (c > stop)
    return inside if step == -1 else inside & (F.pmod(F.lit(start) - c, F.lit(-step)) == 0)


def coordinates(seq: Iterable[Any], n: int) -> list[int]:
    """Checked row numbers: negatives count from the end, order and repeats stay."""
    out = []
    for x in seq:
        k = operator.index(x)
        k += n if k < 0 else 0
        if not 0 <= k < n:
            raise IndexError(f"row {x} is not among {n}")
        out.append(k)
    return out


def gather(df: DataFrame, coords: list[int] | DataFrame) -> DataFrame:
    """Rows at coordinates, with their place in ``pos``; coords may be a DataFrame (pos, nrow) of any size."""
    if not isinstance(coords, DataFrame):
        # a list from the caller: the table stays where it is, and the list travels
        few = len(coords) <= FEW
        coords = df.sparkSession.createDataFrame(list(enumerate(coords)), f"pos long, {NROW} long")
        coords = F.broadcast(coords) if few else coords
    return coords.join(df, NROW)


def renumber(df: DataFrame) -> DataFrame:
    """Numbers from 0 in the present order of nrow, by ranges of the old numbers."""
    ranges = df.withColumn("__r", F.expr(f"{NROW} div {RANGE}"))
    counts = ranges.groupBy("__r").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy(NROW))
    placed = ranges.withColumn("__k", inside).join(offsets, "__r")
    return placed.withColumn(NROW, (F.col("__k") - 1 + F.col("__at")).cast("long")).select(*df.columns)


def removed_before(start: int, stop: int, step: int, at: str = NROW) -> Column:
    """How many members of a rising slice are smaller than nrow: renumbering without counting."""
    c = F.least(F.col(at), F.lit(stop))
    return F.greatest(F.lit(0), F.expr(f"(least({at}, {stop}L) - {start}L + {step - 1}L) div {step}L")) if stop > start else c * 0


def pieces_for(n: int) -> int:
    """Ranges of a sort over n rows."""
    return max(16, min(1024, n // 500_000))


def _cuts(df: DataFrame, first: str, pieces: int) -> list[Any]:
    """At most ``pieces`` values that cut a column into ranges: approximate quantiles, or those of a sample bounded by pieces."""
    kind = dict(df.dtypes)[first]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal"):
        return sorted(set(df.agg(F.percentile_approx(first, [k / pieces for k in range(1, pieces)], 4 * pieces)).first()[0] or []))
    if kind not in ("string", "binary", "boolean"):
        return []
    every = max(1, df.count() // (100 * pieces))
    some = df.where(F.col(first).isNotNull() & (F.pmod(F.xxhash64(NROW), F.lit(every)) == 0)).select(F.col(first).alias("v"))
    tiles = some.withColumn("t", F.ntile(pieces).over(Window.orderBy("v"))).groupBy("t").agg(F.min("v").alias("v"))
    return [r["v"] for r in tiles.select("v").distinct().orderBy("v").collect()]


def positions(df: DataFrame, keys: list[str], out: str = "pos", pieces: int = 32) -> DataFrame:
    """Adds each row's place in the order of keys, then nrow.

    Approximate quantiles of the first key cut the rows into ranges; a row's place is its number within
    its range plus the sizes of the ranges before. A value that is a range of its own is split by nrow. Nulls come first.
    """
    first = keys[0]
    cuts = _cuts(df, first, pieces)
    if cuts:
        # ranges alternate: strictly between two cuts, and equal to one; found by bisection, in generated code
        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(2 * lo)
            mid = (lo + hi) // 2
            cut = F.lit(cuts[mid])
            return F.when(F.col(first) < cut, search(lo, mid)).when(F.col(first) == cut, F.lit(2 * mid + 1)).otherwise(search(mid + 1, hi))

        part = F.when(F.col(first).isNull(), F.lit(-1)).otherwise(search(0, len(cuts)))
    else:
        part = F.when(F.col(first).isNull(), F.lit(-1)).otherwise(F.lit(0))
    rows = df.withColumn("__p", part).withColumn("__q", F.when(F.pmod("__p", F.lit(2)) == 1, F.expr(f"{NROW} div {RANGE}")).otherwise(0) if len(keys) == 1 else F.lit(0))
    counts = rows.groupBy("__p", "__q").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p", "__q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", "__q", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    inside = F.row_number().over(Window.partitionBy("__p", "__q").orderBy(*keys, NROW))
    placed = rows.withColumn("__k", inside).join(offsets, ["__p", "__q"])
    return placed.withColumn(out, (F.col("__k") - 1 + F.col("__at")).cast("long")).drop("__p", "__q", "__n", "__k", "__at")
