"""What users of row-addressed tables write by hand, as one operator each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import NdArray
from .expr import Expr
from .rows import NROW


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Rows of equal keys. Spark broadcasts a side of known small size and splits skewed keys at run time."""
    return left.join(right, left[left_key] == right[right_key], how)


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of equal number."""
    return left.join(right, NROW)


def semi_by_rows(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows whose numbers another table's selection holds."""
    return df.join(selected.select(NROW), NROW, "left_semi")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str, out: str) -> DataFrame:
    """Each left row with the value of the latest right row of its keys that is not later; one shuffle, no pairs."""
    from pyspark.sql import Window

    tagged = left.withColumn("__right", F.lit(0)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(*by, on, F.col(value).alias("__v"), F.lit(-1).alias("__right")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(on, "__right").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__right = 0").select(*left.columns, out)


def group_sum(df: DataFrame, key: str, value: Column, out: str = "s") -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(out))


def exact_sum(values: NdArray | Expr, out: str = "s") -> DataFrame:
    """The sum of the values along one axis, rounded once, so that it does not depend on tasks and order; null without values.

    Each task iterates over its values and passes on a few doubles that have exactly their sum.
    """

    def partial_sums(rows):  # nested, as map_rows wants it
        import math
        from itertools import islice

        numbers, parts, odd, seen = (float(v) for v in rows if v is not None), [], 0.0, False
        while some := list(islice(numbers, 8192)):
            seen = True
            if not math.isfinite(sum(some)):
                odd += sum(v for v in some if not math.isfinite(v))
                some = [v for v in some if math.isfinite(v)]
            some, parts = parts + some, []
            while rest := math.fsum([*some, *(-p for p in parts)]):
                parts.append(rest)
        yield from ((p,) for p in [*parts, odd] if seen)

    @F.udf("double")
    def total(parts):
        import math

        odd = [p for p in parts if not math.isfinite(p)]
        return (sum(odd) if odd else math.fsum(parts)) if parts else None

    return values.map_rows(partial_sums, "part double").agg(F.collect_list("part").alias("parts")).select(total("parts").alias(out))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def row_norms(df: DataFrame, index: str, block: str) -> DataFrame:
    """Euclidean norm of each row's array, without exploding it."""
    total = F.aggregate(block, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.select(index, F.sqrt(total).alias("norm"))


def running(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds rank (r), running sum (running) and the value before (before), within keys in this order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({"r": F.rank().over(w).cast("long"), "running": total, "before": F.lag(value).over(w)})


def set_operation(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both (union), of left that right has too (intersect), or has not (except)."""
    if name == "union":
        return left.unionByName(right).distinct()
    return {"intersect": left.intersect, "except": left.subtract}[name](right.select(*left.columns))


def range_join(left: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of left with each range [low, high) that holds their value; an equi-join on cells of this width, so no cross join.

    A range is copied to each cell that it touches; a value meets it in its own cell only. Choose the width near that of common
    ranges. Empty and null ranges hold nothing.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    some = ranges.where(F.col(low) < F.col(high))
    cut = some.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return left.withColumn("__cell", cell(value)).join(cut, "__cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")


def sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL text over frames named in braces."""
    return spark.sql(text, **frames)
