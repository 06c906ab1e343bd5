"""n-dimensional and ragged arrays.

An array is a DataFrame of cells ``(i0 … ik, value)``; where one row per first index suits better, of
``(i0, v)`` with nested arrays. Slices, gathers and assignments are filters, re-based indices and joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import coordinates, in_slice, slice_of

#: Cells that travel to the driver as one row of the iterators.
BLOCK = 1 << 12


def axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


class NdArray:
    """Cells of a fixed shape. Cells that are missing hold the default."""

    def __init__(self, df: DataFrame, shape: Sequence[int], dflt: Any = 0, extdim: int | None = None, sparse: bool = False):
        self.df, self.shape, self.dflt, self.extdim, self.sparse = df, tuple(shape), dflt, extdim, sparse

    @classmethod
    def from_blocks(cls, df: DataFrame, index: str, value: str, shape: Sequence[int], extdim: int | None = None) -> NdArray:
        """From rows that hold nested arrays: one row per first index."""
        cur, t = df.select(F.col(index).cast("long").alias("i0"), F.col(value).alias("value")), None
        for k in range(1, len(shape)):
            cur = cur.select(*axes(k), F.posexplode("value").alias(f"i{k}", "value"))
            cur = cur.withColumn(f"i{k}", F.col(f"i{k}").cast("long"))
        return cls(cur, shape, 0, extdim)

    @classmethod
    def from_numpy(cls, spark: SparkSession, a: Any, extdim: int | None = None) -> NdArray:
        import numpy as np

        a = np.asarray(a)
        index = np.indices(a.shape).reshape(a.ndim, -1)
        rows = [(*map(int, i), v) for i, v in zip(index.T, a.reshape(-1).tolist())]
        kind = {"b": "boolean", "i": "long", "u": "long", "f": "double", "S": "binary", "U": "string"}[a.dtype.kind]
        schema = ", ".join(f"{x} long" for x in axes(a.ndim)) + f", value {kind}"
        return cls(spark.createDataFrame(rows, schema.lstrip(", ")), a.shape, 0, extdim)

    @classmethod
    def filled(cls, spark: SparkSession, shape: Sequence[int], dflt: Any = 0, kind: str = "double", extdim: int | None = None) -> NdArray:
        """A chunked array nothing was written to: no cell is stored."""
        schema = T.StructType([*(T.StructField(x, T.LongType()) for x in axes(len(shape))), T.StructField("value", T._parse_datatype_string(kind))])
        return cls(spark.createDataFrame([], schema), shape, dflt, extdim, sparse=True)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def nrows(self) -> int:
        return self.shape[self.extdim or 0] if self.shape else 1

    def __len__(self) -> int:
        return self.shape[0]

    def cells(self) -> DataFrame:
        """All cells, the missing ones too."""
        if not self.sparse:
            return self.df
        size = 1
        for n in self.shape:
            size *= n
        every, rest = self.df.sparkSession.range(size).withColumn("__r", F.col("id")), []
        for k in reversed(range(self.ndim)):
            rest.insert(0, k)
            every = every.withColumn(f"i{k}", F.col("__r") % self.shape[k]).withColumn("__r", F.expr(f"__r div {self.shape[k]}"))
        return every.join(self.df, axes(self.ndim), "left").select(*axes(self.ndim), F.coalesce("value", F.lit(self.dflt).cast(self.df.schema["value"].dataType)).alias("value"))

    def _keys(self, key: Any) -> list[Any]:
        key = key if isinstance(key, tuple) else (key,)
        if sum(k is Ellipsis for k in key) > 1:
            raise IndexError("one ellipsis at most")
        if Ellipsis in [k for k in key if k is Ellipsis]:
            at = next(i for i, k in enumerate(key) if k is Ellipsis)
            key = (*key[:at], *[slice(None)] * (self.ndim - len(key) + 1), *key[at + 1 :])
        if len(key) > self.ndim:
            raise IndexError("too many indices")
        return [*key, *[slice(None)] * (self.ndim - len(key))]

    def __getitem__(self, key: Any) -> NdArray:
        """Integers drop an axis, slices re-base it, one list per selection keeps its order."""
        keys, df, shape, out = self._keys(key), self.cells(), [], []
        lists = [k for k in keys if not isinstance(k, slice) and not hasattr(k, "__index__")]
        if len(lists) > 1:
            raise IndexError("one list of indices at most")
        for k, (x, n) in enumerate(zip(keys, self.shape)):
            a = f"i{k}"
            if isinstance(x, slice):
                s = slice_of(x.start, x.stop, x.step, n, reverse=False)
                if s != (0, n, 1):
                    df = df.where(in_slice(*s, at=a))
                out.append(F.expr(f"({a} - {s[0]}L) div {s[2]}L"))
                shape.append(len(range(*s)))
            elif hasattr(x, "__index__"):
                df = df.where(F.col(a) == coordinates([x], n)[0])
            else:
                x = x.tolist() if hasattr(x, "tolist") else list(x)
                if x and all(isinstance(v, bool) for v in x):
                    if len(x) != n:
                        raise IndexError("a mask has the length of its axis")
                    x = [i for i, v in enumerate(x) if v]
                x = coordinates(x, n)
                if not x:
                    raise IndexError("an empty selection")
                if len(set(x)) < len(x):
                    raise IndexError("a selection does not repeat indices")
                place = self.df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(x)], f"{a} long, __to{k} long")
                df = df.join(place, a)
                out.append(F.col(f"__to{k}"))
                shape.append(len(x))
        return NdArray(df.select(*[c.cast("long").alias(f"i{i}") for i, c in enumerate(out)], "value"), shape, self.dflt)

    def read(self, start=None, stop=None, step=None) -> NdArray:
        at = self.extdim or 0
        return self[(*[slice(None)] * at, slice(start, stop, step))]

    def read_coords(self, coords: Sequence[Sequence[int]]) -> DataFrame:
        """(pos, value) of the cells at tuples of indices."""
        rows = [(p, *(coordinates([x], n)[0] for x, n in zip(c, self.shape, strict=True))) for p, c in enumerate(coords)]
        want = self.df.sparkSession.createDataFrame(rows, "pos long, " + ", ".join(f"{a} long" for a in axes(self.ndim)))
        return want.join(self.cells(), axes(self.ndim)).select("pos", "value")

    def mask(self, test: Column) -> DataFrame:
        return self.cells().where(test)

    def set(self, key: Any, value: Any) -> NdArray:
        """A new array with the selected cells replaced by a value, an expression over the cell, or an array of the selection's shape."""
        keys, hit, to, shape = self._keys(key), F.lit(True), [], []
        for k, (x, n) in enumerate(zip(keys, self.shape)):
            if isinstance(x, slice):
                s = slice_of(x.start, x.stop, x.step, n, reverse=False)
                hit = hit & in_slice(*s, at=f"i{k}")
                to.append((f"i{k}", F.expr(f"(i{k} - {s[0]}L) div {s[2]}L")))
                shape.append(len(range(*s)))
            elif hasattr(x, "__index__"):
                hit = hit & (F.col(f"i{k}") == coordinates([x], n)[0])
            else:
                hit = hit & F.col(f"i{k}").isin(coordinates(x, n))
        df, t = self.cells(), self.df.schema["value"].dataType
        if isinstance(value, NdArray):
            if value.shape != tuple(shape):
                raise ValueError(f"an array of shape {value.shape} does not fit a selection of {tuple(shape)}")
            new = value.cells().select(*[F.col(f"i{j}").alias(f"__j{j}") for j in range(value.ndim)], F.col("value").alias("__new"))
            df = df.select("*", *[F.when(hit, c).alias(f"__j{j}") for j, (_, c) in enumerate(to)]).join(new, [f"__j{j}" for j in range(value.ndim)], "left")
            value = F.col("__new")
        new = value if isinstance(value, Column) else F.lit(value)
        return NdArray(df.select(*axes(self.ndim), F.when(hit, new.cast(t)).otherwise(F.col("value")).alias("value")), self.shape, self.dflt, self.extdim)

    def append(self, other: NdArray) -> NdArray:
        """Grows along the enlargeable axis; all other extents must agree."""
        if self.extdim is None:
            raise TypeError("this array cannot grow")
        e = self.extdim
        if other.ndim != self.ndim or any(a != b for k, (a, b) in enumerate(zip(self.shape, other.shape)) if k != e):
            raise ValueError(f"shape {other.shape} cannot be appended to {self.shape}")
        more = other.cells().withColumn(f"i{e}", F.col(f"i{e}") + self.shape[e])
        shape = [n + (other.shape[e] if k == e else 0) for k, n in enumerate(self.shape)]
        return NdArray(self.df.unionByName(more), shape, self.dflt, e, self.sparse)

    def truncate(self, size: int) -> NdArray:
        if self.extdim is None:
            raise TypeError("this array cannot change its extent")
        e = self.extdim
        shape = [size if k == e else n for k, n in enumerate(self.shape)]
        return NdArray(self.df.where(F.col(f"i{e}") < size), shape, self.dflt, e, self.sparse or size > self.shape[e])

    def iterrows(self, start=None, stop=None, step=None) -> Iterator[Any]:
        """The parts along the first axis, as NumPy arrays. Their values go to the driver, in blocks without indices; ``map_rows`` iterates in the tasks."""
        part = self.read(start, stop, step)
        shape = part.shape[1:]
        width = math.prod(shape)
        cells = F.array_sort(F.collect_list(F.struct(*axes(part.ndim), "value")))
        blocks = part.cells().groupBy(F.expr(f"i0 div {max(1, BLOCK // max(1, width))}").alias("b")).agg(cells.alias("c"))
        rows = blocks.select("b", F.transform("c", lambda c: c["value"]).alias("v"), F.size(F.array_distinct(F.transform("c", lambda c: c["i0"]))).alias("n")).orderBy("b").drop("b").toLocalIterator()
        import numpy as np

        for r in rows:
            values = r["v"]
            if len(values) != r["n"] * width:
                raise ValueError(f"{len(values)} cells do not fill {r['n']} parts of shape {shape}")
            for k in range(0, len(values), width):
                yield np.array(values[k : k + width]).reshape(shape)

    def map_rows(self, each: Callable[[Iterator[Any]], Iterator[tuple]], schema: str) -> DataFrame:
        """The records that ``each`` yields in every task from its parts along the first axis: values (None for null) of one axis, NumPy arrays of more.

        Every part is met once, in no set order, and nothing is sent to the driver. ``each`` travels to the workers.
        """
        kind, shape, df = T._parse_datatype_string(schema), self.shape[1:], self.cells()
        if shape:
            cells = F.array_sort(F.collect_list(F.struct(*axes(self.ndim), "value")))
            df = df.groupBy("i0").agg(cells.alias("c")).select(F.transform("c", lambda c: c["value"]).alias("value"))

        def task(batches):  # nested: it needs no package on the workers
            from itertools import islice

            import numpy as np
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            values = (v for b in batches for v in b.column(0).to_pylist())
            records = iter(each((np.array(v).reshape(shape) for v in values) if shape else values))
            into = to_arrow_schema(kind)
            while some := list(islice(records, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), into)], schema=into)

        return df.select("value").mapInArrow(task, kind)

    def to_numpy(self) -> Any:
        import numpy as np

        rows = self.cells().orderBy(*axes(self.ndim)).select("value").collect()
        return np.array([r[0] for r in rows]).reshape(self.shape)


class RaggedArray:
    """Rows (nrow, item) that are sequences of any length, or strings, or pickled objects."""

    def __init__(self, df: DataFrame, nrows: int | None = None, kind: str = "atoms"):
        self.df, self._n, self.kind = df, nrows, kind

    @classmethod
    def from_lists(cls, spark: SparkSession, rows: Sequence[Any], element: str = "long", kind: str = "atoms") -> RaggedArray:
        t = {"atoms": f"array<{element}>", "vlstring": "binary", "vlunicode": "string", "object": "binary"}[kind]
        return cls(spark.createDataFrame([(k, cls._store(r, kind)) for k, r in enumerate(rows)], f"nrow long, item {t}"), len(rows), kind)

    @staticmethod
    def _store(value: Any, kind: str) -> Any:
        if kind == "object":
            import pickle

            return pickle.dumps(value)
        if kind == "vlstring":
            return value.encode() if isinstance(value, str) else bytes(value)
        return value if kind == "vlunicode" else list(value)

    @classmethod
    def grouped(cls, df: DataFrame, key: str, value: str, order: str) -> DataFrame:
        """(key, item): each key's values in order, as one ragged row."""
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        return df.groupBy(key).agg(pairs.alias("p")).select(key, F.transform("p", lambda x: x["v"]).alias("item"))

    @property
    def nrows(self) -> int:
        if self._n is None:
            self._n = self.df.count()
        return self._n

    def __len__(self) -> int:
        return self.nrows

    def append(self, value: Any) -> None:
        n = self.nrows
        row = self.df.sparkSession.createDataFrame([(n, self._store(value, self.kind))], self.df.schema)
        self.df, self._n = self.df.unionByName(row), n + 1

    def read(self, start=None, stop=None, step=None) -> DataFrame:
        return self.df.where(in_slice(*slice_of(start, stop, step, self.nrows)))

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, slice):
            s = slice_of(key.start, key.stop, key.step, self.nrows)
            rows = self.read(key.start, key.stop, key.step).orderBy(F.col("nrow").desc() if s[2] < 0 else "nrow").collect()
            return [self._load(r["item"]) for r in rows]
        if hasattr(key, "__index__"):
            k = coordinates([key], self.nrows)[0]
            return self._load(self.df.where(F.col("nrow") == k).first()["item"])
        keys = key.tolist() if hasattr(key, "tolist") else list(key)
        if keys and all(isinstance(k, bool) for k in keys):
            keys = [i for i, k in enumerate(keys) if k]
        from .rows import gather

        return [self._load(r["item"]) for r in gather(self.df, coordinates(keys, self.nrows)).orderBy("pos").collect()]

    def _load(self, item: Any) -> Any:
        if self.kind == "object":
            import pickle

            return pickle.loads(bytes(item))
        return bytes(item) if self.kind == "vlstring" else item

    def iterrows(self) -> Iterator[Any]:
        return (self._load(r["item"]) for r in self.df.orderBy("nrow").toLocalIterator())

    def __setitem__(self, key: Any, value: Any) -> None:
        """Overwrites elements of a row; values that are longer do not fit, a single one fills it."""
        k = coordinates([key], self.nrows)[0]
        old = self[k]
        if self.kind != "atoms":
            new = self._store(value, self.kind)
        else:
            value = list(value) if hasattr(value, "__iter__") else [value] * len(old)
            if len(value) > len(old) or len(value) not in (1, len(old)):
                raise ValueError(f"{len(value)} values do not fit a row of {len(old)}")
            new = value * len(old) if len(value) == 1 else value
        row = self.df.sparkSession.createDataFrame([(k, new)], self.df.schema)
        self.df = self.df.where(F.col("nrow") != k).unionByName(row)

    def sizes(self, itemsize: int = 1) -> DataFrame:
        n = F.size("item") if self.kind == "atoms" else F.octet_length("item")
        return self.df.select("nrow", (n * itemsize).cast("long").alias("size"))

    def get_row_size(self, row: int, itemsize: int = 8) -> int:
        k = coordinates([row], self.nrows)[0]
        return self.sizes(itemsize).where(F.col("nrow") == k).first()["size"]

    def truncate(self, size: int) -> None:
        self.df, self._n = self.df.where(F.col("nrow") < size), min(size, self.nrows)


def as_array(df: DataFrame, values: list[str], index: str = "nrow") -> NdArray:
    """Columns of a table as a one- or two-dimensional array."""
    if len(values) == 1:
        return NdArray(df.select(F.col(index).cast("long").alias("i0"), F.col(values[0]).alias("value")), (df.count(),))
    n = df.count()
    return NdArray.from_blocks(df.select(index, F.array(*values).alias("v")), index, "v", (n, len(values)))
