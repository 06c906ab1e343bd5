"""Column indexes: a sorted sidecar of (value, nrow) on disk, searched by value and read by position.

The sidecar is written once, at the first use after an index is made or its table edited: one sort by (value, nrow),
into Parquet of small row groups. A row's position is its row number in those files, so nothing else is computed.
Searches for a range of values skip row groups by their statistics; so do reads of a range of positions. Nulls come
first, NaN last; equal values follow row numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.condition import is_complex
from .rows import NROW, in_slice, read_numbered, scratch, slice_of

ROW_GROUP = 1 << 20
KINDS = ("ultralight", "light", "medium", "full")


@dataclass
class IndexInfo:
    kind: str = "medium"
    optlevel: int = 6
    dirty: bool = False

    @property
    def is_csi(self) -> bool:
        return self.kind == "full" and self.optlevel == 9 and not self.dirty


def check_indexable(name: str, field: T.StructField) -> None:
    t = field.dataType
    if isinstance(t, T.DecimalType) or field.metadata.get("type") == "uint64":
        raise NotImplementedError(f"{name}: 64-bit unsigned columns cannot be indexed")
    if is_complex(t):
        raise TypeError(f"{name}: complex columns cannot be indexed")
    if isinstance(t, T.ArrayType):
        raise TypeError(f"{name}: multidimensional columns cannot be indexed")
    if isinstance(t, T.StructType):
        raise TypeError(f"{name}: a group of columns cannot be indexed")


class Index:
    """The order of one column."""

    def __init__(self, df: DataFrame, path: str, info: IndexInfo, nrows: int, stored: dict[str, str] | None = None):
        self._df, self.path, self.info, self.nrows = df, path, info, nrows
        self._stored = {} if stored is None else stored

    kind = property(lambda self: self.info.kind)
    optlevel = property(lambda self: self.info.optlevel)
    dirty = property(lambda self: self.info.dirty)
    is_csi = property(lambda self: self.info.is_csi)

    @property
    def is_stored(self) -> bool:
        return self.path in self._stored

    def sidecar(self) -> DataFrame:
        """(value, nrow, pos), by value; equal values by nrow. Written by the first call."""
        spark = self._df.sparkSession
        if not self.is_stored:
            column = F.col(".".join(f"`{p}`" for p in self.path.split("/")))
            to = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
            rows = self._df.select(column.alias("value"), NROW).orderBy("value", NROW)
            rows.write.option("parquet.block.size", ROW_GROUP).parquet(to)
            self._stored[self.path] = to
        return read_numbered(spark, self._stored[self.path], "pos")

    def _part(self, start, stop, step) -> DataFrame:
        return self.sidecar().where(in_slice(*slice_of(start, stop, step, self.nrows), at="pos"))

    def read_sorted(self, start=None, stop=None, step=None) -> DataFrame:
        return self._part(start, stop, step).select("pos", "value")

    def read_indices(self, start=None, stop=None, step=None) -> DataFrame:
        return self._part(start, stop, step).select("pos", NROW)

    def __getitem__(self, key) -> DataFrame:
        return self.read_indices(key.start, key.stop, key.step) if isinstance(key, slice) else self.read_indices(key, key + 1 if key != -1 else None, 1)

    def _matches(self, ops: Sequence[str], limits: Sequence[Any]) -> DataFrame:
        """Sidecar rows for comparisons such as ("ge", "lt") with (3, 7); nulls and NaN match nothing."""
        c, out = F.col("value"), self.sidecar()
        test = {"gt": c.__gt__, "ge": c.__ge__, "lt": c.__lt__, "le": c.__le__, "eq": c.__eq__}
        floating = dict(out.dtypes)["value"] in ("float", "double")
        for op, x in zip(ops, limits, strict=True):
            out = out.where(test[op](F.lit(x)))
            if floating and op in ("gt", "ge"):
                out = out.where(~F.isnan(c))
        return out

    def search(self, ops: Sequence[str], limits: Sequence[Any]) -> DataFrame:
        """(nrow) of the rows whose value meets the comparisons."""
        return self._matches(ops, limits).select(NROW)

    def lookup_range(self, ops: Sequence[str], limits: Sequence[Any]) -> tuple[int, int]:
        """The positions [start, stop) that the comparisons take up in the order."""
        low, high = self._matches(ops, limits).agg(F.min("pos"), F.max("pos")).first()
        return (0, 0) if low is None else (low, high + 1)

    def chunkmap(self, ops: Sequence[str], limits: Sequence[Any], chunk: int = 1 << 16) -> DataFrame:
        """(chunk, hits): which runs of ``chunk`` rows hold matches, and how many."""
        return self.search(ops, limits).groupBy(F.expr(f"{NROW} div {chunk}").alias("chunk")).agg(F.count("*").alias("hits"))
