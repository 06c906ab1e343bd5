"""Tables of numbered records: reading, conditional selection, sorted reading and edits.

Every read has a form that returns a DataFrame and collects nothing; iterators and records are thin
adapters over it. Edits make a new plan (copy on write); ``flush`` writes it where the table is stored.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..enums import Enum
from ..functions.condition import Node, column_node, compile_condition, resolver
from ..plans.index_plan import IndexPlan, index_plan
from ..types import Col, Description
from .index import Index, IndexInfo, check_indexable
from .rows import FEW, NROW, coordinates, gather, in_slice, query_slice, read_numbered, removed_before, slice_of


def quoted(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split("/")))


def constant(value: Any, t: T.DataType) -> Column:
    """A literal of any storable type."""
    if isinstance(t, T.ArrayType):
        return F.array(*[constant(v, t.elementType) for v in value]).cast(t)
    if isinstance(t, T.StructType):
        get = value.get if isinstance(value, Mapping) else lambda n: value[t.names.index(n)]
        return F.struct(*[constant(get(f.name), f.dataType).alias(f.name) for f in t.fields])
    return F.lit(value).cast(t)


class ColumnHandle:
    """One column or column group of a table, by its path."""

    def __init__(self, table: Table, path: str):
        self.table, self.path = table, path

    @property
    def field(self) -> T.StructField:
        fields, out = self.table.schema, None
        for p in self.path.split("/"):
            out = fields[p]
            fields = out.dataType
        return out

    type = property(lambda self: self.field.metadata.get("type") or self.field.dataType.simpleString())
    dtype = property(lambda self: self.field.dataType)

    def node(self) -> Node:
        return column_node(self.path, self.field.dataType)

    def df(self, start=None, stop=None, step=None) -> DataFrame:
        return self.table.read(start, stop, step, field=self.path)

    def __getitem__(self, key: Any) -> Any:
        name = self.path.split("/")[-1]
        if isinstance(key, slice):
            return [r[name] for r in self.df(key.start, key.stop, key.step).collect()]
        k = coordinates([key], self.table.nrows)[0]
        return self.df(k, k + 1).first()[name]

    def __setitem__(self, key: Any, value: Any) -> None:
        if isinstance(key, slice):
            self.table.modify_column(key.start, key.stop, key.step, column=value, colname=self.path)
        else:
            k = coordinates([key], self.table.nrows)[0]
            self.table.modify_column(k, k + 1, 1, column=[value], colname=self.path)

    def __iter__(self) -> Iterator[Any]:
        name = self.path.split("/")[-1]
        return (r[name] for r in self.df().toLocalIterator())

    def __len__(self) -> int:
        return self.table.nrows

    def __getattr__(self, name: str) -> ColumnHandle:
        t = self.field.dataType
        if isinstance(t, T.StructType) and name in t.names:
            return ColumnHandle(self.table, f"{self.path}/{name}")
        raise AttributeError(name)

    @property
    def attrs(self) -> dict[str, Any]:
        return self.table.column_attrs.setdefault(self.path, {})

    @property
    def is_indexed(self) -> bool:
        return self.path in self.table.indexes

    @property
    def index(self) -> Index | None:
        info = self.table.indexes.get(self.path)
        return None if info is None else Index(self.table._flushed(), self.path, info, self.table.nrows, self.table.orders)

    def create_index(self, optlevel: int = 6, kind: str = "medium") -> int:
        from .index import KINDS

        if kind not in KINDS:
            raise ValueError(f"an index is one of {KINDS}")
        if not 0 <= optlevel <= 9:
            raise ValueError("levels are 0 to 9")
        check_indexable(self.path, self.field)
        if self.is_indexed:
            raise ValueError(f"column {self.path} is indexed already")
        self.table.indexes[self.path] = IndexInfo(kind, optlevel)
        return self.table.nrows

    def create_csindex(self) -> int:
        return self.create_index(9, "full")

    def remove_index(self) -> None:
        self.table.indexes.pop(self.path, None)
        self.table.orders.pop(self.path, None)

    def reindex(self) -> None:
        if self.is_indexed:
            self.table.indexes[self.path].dirty = False

    def reindex_dirty(self) -> None:
        self.reindex()


class Columns:
    """All columns of a table, by attribute."""

    def __init__(self, table: Table):
        self._table = table

    def __getattr__(self, name: str) -> ColumnHandle:
        if name not in self._table.schema.names:
            raise AttributeError(name)
        return ColumnHandle(self._table, name)

    def column(self, path: str) -> ColumnHandle:
        h = ColumnHandle(self._table, path)
        h.field
        return h

    def __getitem__(self, key: Any) -> Any:
        return self._table[key]

    def __setitem__(self, key: Any, value: Any) -> None:
        self._table[key] = value

    def __len__(self) -> int:
        return self._table.nrows


class RowAppender:
    """``table.row``: fields are set by name, ``append`` keeps the record for the next flush."""

    def __init__(self, table: Table):
        self._table, self._now = table, {}

    def __setitem__(self, name: str, value: Any) -> None:
        at, *parts = self._now, *name.split("/")
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = value

    def append(self) -> None:
        self._table.pending.append(self._table.description.row(self._now))
        self._now = {}


class _RowSet:
    """Row numbers, combined as the planner's text says."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __and__(self, other: _RowSet) -> _RowSet:
        return _RowSet(self.df.join(other.df, NROW, "left_semi"))

    def __or__(self, other: _RowSet) -> _RowSet:
        return _RowSet(self.df.unionByName(other.df).distinct())


class Table:
    """A DataFrame with the column ``nrow`` numbering its rows from 0 without gaps."""

    def __init__(self, df: DataFrame, description: Description | None = None, nrows: int | None = None, store: Any = None, path: str | None = None):
        self.df = df
        self.schema = T.StructType([f for f in df.schema.fields if f.name != NROW])
        self._description, self._nrows, self.store, self.path = description, nrows, store, path
        self.indexes: dict[str, IndexInfo] = {}
        self.orders: dict[str, str] = {}
        self.column_attrs: dict[str, dict[str, Any]] = {}
        self.pending: list[dict[str, Any]] = []
        self.autoindex = True

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Table:
        return cls(read_numbered(spark, path))

    @classmethod
    def from_rows(cls, spark: SparkSession, spec: Any, rows: Iterable[Any] = ()) -> Table:
        d = Description(spec)
        t = cls(spark.createDataFrame([], d.schema().add(NROW, "long")), d, 0)
        rows = list(rows)
        if rows:
            t.append(rows)
        return t

    # description

    @property
    def description(self) -> Description:
        if self._description is None:
            self._description = Description.from_schema(self.schema)
        return self._description

    @property
    def nrows(self) -> int:
        if self.pending:
            self._take_pending()
        if self._nrows is None:
            self._nrows = self.df.count()
        return self._nrows

    def __len__(self) -> int:
        return self.nrows

    @property
    def colnames(self) -> list[str]:
        return self.schema.names

    @property
    def cols(self) -> Columns:
        return Columns(self)

    @property
    def row(self) -> RowAppender:
        return RowAppender(self)

    def get_enum(self, name: str) -> Enum:
        import json

        m = self.cols.column(name).field.metadata
        if "enum" not in m:
            raise TypeError(f"column {name} is not enumerated")
        return Enum(json.loads(m["enum"]))

    @property
    def colindexes(self) -> dict[str, Index]:
        return {p: ColumnHandle(self, p).index for p in self.indexes}

    @property
    def indexedcolpathnames(self) -> list[str]:
        return list(self.indexes)

    @property
    def rowsize(self) -> int:
        """Bytes of one record as declared."""
        sizes = {"bool": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int64": 8, "uint64": 8, "float64": 8, "time64": 8, "complex64": 8, "complex128": 16, "float96": 12, "float128": 16}
        total = 0
        for _, c in self.description.paths():
            n = c.itemsize if c.kind == "string" and c.itemsize < 1 << 30 else sizes.get(c.kind, 4)
            for k in c.shape:
                n *= k
            total += n
        return total

    @property
    def size_in_memory(self) -> int:
        return self.rowsize * self.nrows

    # reading

    def _fields(self, df: DataFrame, field: str | None, *keep: str) -> DataFrame:
        return df if field is None else df.select(*keep, quoted(field).alias(field.split("/")[-1]))

    def rows(self, start=None, stop=None, step=None) -> DataFrame:
        """Rows of a slice with their numbers; no order is imposed, so nothing is shuffled."""
        whole = start is None and stop is None and step in (None, 1)
        return self._flushed() if whole else self._flushed().where(in_slice(*slice_of(start, stop, step, self.nrows)))

    def _flushed(self) -> DataFrame:
        if self.pending:
            self._take_pending()
        return self.df

    def read(self, start=None, stop=None, step=None, field: str | None = None) -> DataFrame:
        """Rows of a slice in its direction."""
        down = step is not None and step < 0
        out = self.rows(start, stop, step).orderBy(F.col(NROW).desc() if down else NROW)
        return out.drop(NROW) if field is None else self._fields(out, field)

    def iterrows(self, start=None, stop=None, step=None) -> Iterator[Any]:
        down = step is not None and step < 0
        return self.rows(start, stop, step).orderBy(F.col(NROW).desc() if down else NROW).toLocalIterator(prefetchPartitions=True)

    def __iter__(self) -> Iterator[Any]:
        return self.iterrows()

    def read_coordinates(self, coords: Sequence[int] | DataFrame, field: str | None = None) -> DataFrame:
        """Rows at coordinates with their place (``pos``); order and repeats are kept by it."""
        if not isinstance(coords, DataFrame):
            if len(coords) and all(isinstance(c, bool) or type(c).__name__ == "bool_" for c in coords):
                if len(coords) != self.nrows:
                    raise IndexError("a mask has one value per row")
                coords = [k for k, c in enumerate(coords) if c]
            coords = coordinates(coords, self.nrows)
        return self._fields(gather(self._flushed(), coords), field, "pos")

    def itersequence(self, seq: Iterable[int]) -> Iterator[Any]:
        return self.read_coordinates(list(seq)).orderBy("pos").drop("pos").toLocalIterator()

    def mask(self, test: Column) -> DataFrame:
        """Rows where an expression holds, as a mask would select them."""
        return self._flushed().where(test)

    def to_numpy(self, start=None, stop=None, step=None) -> Any:
        """The records of a slice as a NumPy record array."""
        return self.read(start, stop, step).toPandas().to_records(index=False)

    def col(self, name: str) -> DataFrame:
        return self.read(field=name)

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, slice):
            return self.read(key.start, key.stop, key.step)
        if hasattr(key, "__index__"):
            k = coordinates([key], self.nrows)[0]
            return self.rows(k, k + 1).drop(NROW).first()
        return self.read_coordinates(key.tolist() if hasattr(key, "tolist") else list(key)).orderBy("pos").drop("pos", NROW)

    def contains(self, value: Any) -> Column:
        """Whether any numeric column of a row holds the value."""
        numeric = [f.name for f in self.schema.fields if isinstance(f.dataType, T.NumericType)]
        return F.array_contains(F.array(*[F.col(n).cast("double") for n in numeric]), F.lit(float(value)))

    # conditions

    def _as_node(self, value: Any) -> Node | None:
        if isinstance(value, ColumnHandle):
            if value.table is not self:
                raise ValueError("a condition's columns belong to its table")
            return value.node()
        return None

    def compile(self, condition: str, condvars: Mapping[str, Any] | None = None, depth: int = 2) -> Node:
        frames = None
        if condvars is None:
            f = inspect.currentframe()
            for _ in range(depth):
                f = f.f_back
            frames = {**f.f_globals, **f.f_locals}
        return compile_condition(condition, resolver(self.schema, condvars, frames, self._as_node))

    def where(self, condition: str, condvars: Mapping[str, Any] | None = None, start=None, stop=None, step=None, _depth: int = 2) -> DataFrame:
        """Rows that meet a condition, with their numbers. A start alone means that one row."""
        df = self._flushed()
        ranged = not (start is None and stop is None and step in (None, 1))
        if ranged:
            s = query_slice(start, stop, step, self.nrows)
            if not range(*s):
                return df.where(F.lit(False))
        node = self.compile(condition, condvars, _depth)
        out = df.where(node.column)
        return out.where(in_slice(*s)) if ranged else out

    def iterwhere(self, condition: str, condvars: Mapping[str, Any] | None = None, start=None, stop=None, step=None) -> Iterator[Any]:
        return self.where(condition, condvars, start, stop, step, 3).orderBy(NROW).toLocalIterator()

    def read_where(self, condition: str, condvars: Mapping[str, Any] | None = None, field: str | None = None, start=None, stop=None, step=None) -> DataFrame:
        out = self.where(condition, condvars, start, stop, step, 3)
        return out.drop(NROW) if field is None else self._fields(out, field)

    def get_where_list(self, condition: str, condvars: Mapping[str, Any] | None = None, sort: bool = False, start=None, stop=None, step=None) -> DataFrame:
        out = self.where(condition, condvars, start, stop, step, 3).select(NROW)
        return out.orderBy(NROW) if sort else out

    def append_where(self, dst: Table, condition: str | None = None, condvars: Mapping[str, Any] | None = None, start=None, stop=None, step=None) -> int:
        """Appends matching rows to another table; returns how many."""
        from .rows import renumber

        found = self.rows(start, stop, step) if condition is None else self.where(condition, condvars, start, stop, step, 3)
        before = dst.nrows
        dst._set(dst.df.unionByName(renumber(found).withColumn(NROW, F.col(NROW) + before).select(*dst.df.columns)), None)
        return dst.nrows - before

    def index_plan(self, condition: str, condvars: Mapping[str, Any] | None = None, _depth: int = 2) -> IndexPlan:
        usable = [p for p, i in self.indexes.items() if not i.dirty]
        return index_plan(self.compile(condition, condvars, _depth), usable)

    def will_query_use_indexing(self, condition: str, condvars: Mapping[str, Any] | None = None) -> frozenset[str]:
        return self.index_plan(condition, condvars, 3).columns

    def where_indexed(self, condition: str, condvars: Mapping[str, Any] | None = None) -> DataFrame:
        """The rows of where(), found through the indexes that the condition can use, and tested again in full.

        Sidecars give the row numbers of each indexed comparison; "and" and "or" combine them, and only these rows meet the rest of
        the condition. Without a usable index it is where().
        """
        node = self.compile(condition, condvars)
        plan = index_plan(node, [p for p, i in self.indexes.items() if not i.dirty])
        df = self._flushed()
        if not plan.exprs:
            return df.where(node.column)
        found = [ColumnHandle(self, name).index.search(ops, limits) for name, ops, limits in plan.exprs]
        rows = eval(plan.skeleton, {"__builtins__": {}}, {f"e{k}": _RowSet(f) for k, f in enumerate(found)}).df  # noqa: S307 - a text of e0, &, | and brackets, made by index_plan
        rows = rows.cache()
        try:
            few = rows.count() <= FEW
        finally:
            rows.unpersist()
        return df.join(F.broadcast(rows) if few else rows, NROW, "left_semi").where(node.column)

    # sorted reading

    def _sort_key(self, sortby: str | ColumnHandle, check_csi: bool) -> str:
        path = sortby.path if isinstance(sortby, ColumnHandle) else sortby
        self.cols.column(path)
        info = self.indexes.get(path)
        if info is None or info.kind != "full":
            raise ValueError(f"column {path} has no full index")
        if check_csi and not info.is_csi:
            raise ValueError(f"the index of {path} is not completely sorted")
        return path

    def sorted_rows(self, sortby: str, start=None, stop=None, step=None) -> DataFrame:
        """Rows of a slice of sorted positions, with ``pos`` the place in the sorted order."""
        n = self.nrows
        s = slice_of(start, stop, step, n)
        df = self._flushed()
        key = quoted(sortby)
        r = range(*s)
        index = Index(df, sortby, self.indexes[sortby], n, self.orders)
        if not index.is_stored and len(r) and max(r) < 10_000:  # a top of the order: no full sort
            top = df.orderBy(key, NROW).limit(max(r) + 1)
            from pyspark.sql import Window

            out = top.withColumn("pos", (F.row_number().over(Window.orderBy(key, NROW)) - 1).cast("long"))
        elif not index.is_stored and len(r) and min(r) >= n - 10_000:
            from pyspark.sql import Window

            end = df.orderBy(key.desc(), F.col(NROW).desc()).limit(n - min(r))
            out = end.withColumn("pos", (n - F.row_number().over(Window.orderBy(key.desc(), F.col(NROW).desc()))).cast("long"))
        else:
            places = index.sidecar().where(in_slice(*s, at="pos")).select(NROW, "pos")
            out = df.join(F.broadcast(places) if len(r) <= FEW else places, NROW).select(*df.columns, "pos")
        return out.where(in_slice(*s, at="pos"))

    def read_sorted(self, sortby: str | ColumnHandle, checkCSI: bool = False, field: str | None = None, start=None, stop=None, step=None) -> DataFrame:
        out = self.sorted_rows(self._sort_key(sortby, checkCSI), start, stop, step)
        return self._fields(out, field, "pos")

    def itersorted(self, sortby: str | ColumnHandle, checkCSI: bool = False, start=None, stop=None, step=None) -> Iterator[Any]:
        down = step is not None and step < 0
        return self.read_sorted(sortby, checkCSI, None, start, stop, step).orderBy(F.col("pos").desc() if down else "pos").toLocalIterator()

    def copy(self, start=None, stop=None, step=None, sortby: str | ColumnHandle | None = None, checkCSI: bool = False, propindexes: bool = False) -> Table:
        """A new table of a slice, in sorted order if asked; ready to be stored with neighbours together."""
        from .rows import renumber

        if sortby is None:
            s = slice_of(start, stop, step, self.nrows)
            df = self.rows(start, stop, step)
            if s[2] < 0:
                df = df.withColumn(NROW, F.lit(s[0]) - F.col(NROW))
            new = Table(df if s == (0, self.nrows, 1) else renumber(df), self._description)
        else:
            s = slice_of(start, stop, step, self.nrows)
            df = self.sorted_rows(self._sort_key(sortby, checkCSI), start, stop, step)
            place = (F.col("pos") - s[0]) / s[2] if s[2] != 1 else F.col("pos") - s[0]
            new = Table(df.withColumn(NROW, place.cast("long")).drop("pos"), self._description)
        if propindexes:
            new.indexes = {p: IndexInfo(i.kind, i.optlevel) for p, i in self.indexes.items()}
        return new

    # edits

    def _set(self, df: DataFrame, nrows: int | None) -> None:
        self.df, self._nrows = df, nrows
        self.orders = {}
        for i in self.indexes.values():
            i.dirty = not self.autoindex

    def _frame(self, records: list[dict[str, Any]], first: int) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(NROW, T.LongType())])
        rows = [{**r, NROW: first + k} for k, r in enumerate(records)]
        plain = self.df.sparkSession.createDataFrame([tuple(_as_row(r[f.name], f.dataType) for f in schema.fields) for r in rows], schema)
        return plain

    def _take_pending(self) -> None:
        records, self.pending = self.pending, []
        n = self._nrows if self._nrows is not None else self.df.count()
        self._set(self.df.unionByName(self._frame(records, n).select(*self.df.columns)), n + len(records))

    def append(self, rows: Iterable[Any]) -> None:
        """Records by position or name; columns that are not given take their defaults."""
        try:
            records = [self.description.row(r) for r in rows]
        except (TypeError, KeyError) as e:
            raise ValueError(f"rows do not fit the table: {e}") from e
        n = self.nrows
        self._set(self.df.unionByName(self._frame(records, n).select(*self.df.columns)), n + len(records))

    def _replace(self, new: DataFrame, names: list[str]) -> None:
        """new: (nrow, names...) for the rows that change."""
        n = self._nrows
        marked = new.select(NROW, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{k}") for k, c in enumerate(names)])
        joined = self._flushed().join(marked, NROW, "left")
        cols = [F.when(F.col("__hit"), F.col(f"__new_{names.index(c)}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in self.df.columns]
        self._set(joined.select(*cols), n)

    def modify_rows(self, start=None, stop=None, step=None, rows: Sequence[Any] = ()) -> int:
        at = range(*slice_of(start, stop if stop is not None or start is None else self.nrows, step, self.nrows, reverse=False))
        if len(at) != len(rows):
            raise ValueError(f"{len(at)} rows are to change, {len(rows)} are given")
        return self.modify_coordinates(list(at), rows)

    def modify_coordinates(self, coords: Sequence[int], rows: Sequence[Any]) -> int:
        coords = coordinates(coords, self.nrows)
        if len(rows) < len(coords):
            raise ValueError("there are fewer rows than coordinates")
        last = dict(zip(coords, (self.description.row(r) for r in rows)))
        if last:
            frame = self._frame(list(last.values()), 0)
            place = self.df.sparkSession.createDataFrame(list(enumerate(last)), f"{NROW} long, __to long")
            self._replace(frame.join(place, NROW).drop(NROW).withColumnRenamed("__to", NROW), self.colnames)
        return len(coords)

    def modify_columns(self, start=None, stop=None, step=None, columns: Sequence[Any] = (), names: Sequence[str] = ()) -> int:
        """Columns given as one value, a sequence, or a Column expression over the old row."""
        s = slice_of(start, stop, step, self.nrows, reverse=False)
        at = range(*s)
        df, lists, out = self._flushed(), [], {}
        for value, path in zip(columns, names, strict=True):
            field = self.cols.column(path).field
            if isinstance(value, Column):
                new = value.cast(field.dataType)
            elif isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
                values = list(value.tolist() if hasattr(value, "tolist") else value)
                if len(values) != len(at):
                    raise ValueError(f"{len(at)} cells are to change, {len(values)} are given")
                lists.append((path, field, values))
                continue
            else:
                col = dict(self.description.paths()).get(path)
                new = constant(col.value(value) if col is not None else value, field.dataType)
            df = _with_path(df, path, F.when(in_slice(*s), new).otherwise(quoted(path)), field)
        if lists:
            declared = dict(self.description.paths())
            convert = [declared[p].value if p in declared else (lambda v: v) for p, _, _ in lists]
            data = [(k, *(_as_row(c(v[i]), f.dataType) for c, (_, f, v) in zip(convert, lists))) for i, k in enumerate(at)]
            schema = T.StructType([T.StructField(NROW, T.LongType()), *(T.StructField(f"__new_{k}", f.dataType) for k, (_, f, _) in enumerate(lists)), T.StructField("__hit", T.BooleanType())])
            df = df.join(self.df.sparkSession.createDataFrame([(*d, True) for d in data], schema), NROW, "left")
            for k, (path, field, _) in enumerate(lists):
                df = _with_path(df, path, F.when(F.col("__hit"), F.col(f"__new_{k}")).otherwise(quoted(path)), field)
        self._set(df.select(*self.df.columns), self._nrows)
        return len(at)

    def modify_column(self, start=None, stop=None, step=None, column: Any = None, colname: str | None = None) -> int:
        if column is None or colname is None:
            raise TypeError("a column and its name are needed")
        return self.modify_columns(start, stop, step, [column], [colname])

    def update_where(self, condition: str, changes: Mapping[str, Any], condvars: Mapping[str, Any] | None = None) -> None:
        """Sets columns of the rows that meet a condition; values are constants, Columns or expressions over the row."""
        node = self.compile(condition, condvars)
        df = self._flushed()
        from ..functions.condition import parse

        old = {}
        for path, value in changes.items():
            field = self.cols.column(path).field
            if isinstance(value, str) and not isinstance(field.dataType, (T.StringType, T.BinaryType)):
                value = parse(value, resolver(self.schema, condvars)).column
            new = value.cast(field.dataType) if isinstance(value, Column) else constant(value, field.dataType)
            old[path] = (F.when(node.column, new).otherwise(quoted(path)), field)
        if all("/" not in p for p in old):
            df = df.select(*[old[c][0].alias(c, metadata=old[c][1].metadata) if c in old else F.col(c) for c in df.columns])
        else:
            for p, (c, field) in old.items():
                df = _with_path(df, p, c, field)
        self._set(df, self._nrows)

    def remove_rows(self, start=None, stop=None, step=None) -> int:
        """Removes a slice; later rows move up. Their new numbers follow from the slice: nothing is counted."""
        n = self.nrows
        a, b, s = slice_of(start, stop, step, n, reverse=False)
        gone = len(range(a, b, s))
        if not gone:
            return 0
        kept = self._flushed().where(~in_slice(a, b, s))
        self._set(kept.withColumn(NROW, (F.col(NROW) - removed_before(a, b, s)).cast("long")), n - gone)
        return gone

    def remove_row(self, n: int) -> None:
        k = coordinates([n], self.nrows)[0]
        self.remove_rows(k, k + 1)

    def remove_where(self, condition: str, condvars: Mapping[str, Any] | None = None) -> None:
        from .rows import renumber

        node = self.compile(condition, condvars)
        self._set(renumber(self._flushed().where(~node.column)), None)

    def truncate(self, size: int) -> None:
        """Shrinks, or grows with default rows made where they are needed."""
        n = self.nrows
        if size < 0:
            raise ValueError("a size is not negative")
        if size <= n:
            self._set(self.df.where(F.col(NROW) < size), size)
            return
        more = self.df.sparkSession.range(n, size)
        dflt = self.description.row({})
        cols = [F.col("id").alias(NROW) if c == NROW else constant(dflt[c], self.schema[c].dataType).alias(c) for c in self.df.columns]
        self._set(self.df.unionByName(more.select(*cols)), size)

    def add_column(self, name: str, spec: Col, value: Column | None = None) -> Table:
        """A new table with one column more, of defaults or of an expression over the row."""
        new = constant(spec.default(), spec.data_type) if value is None else value.cast(spec.data_type)
        df = self._flushed().withColumn(name, new)
        t = Table(df.withMetadata(name, spec.metadata()), None, self._nrows)
        t.indexes = dict(self.indexes)
        return t

    def __setitem__(self, key: Any, value: Any) -> None:
        if isinstance(key, slice):
            at = range(*slice_of(key.start, key.stop, key.step, self.nrows, reverse=False))
            self.modify_coordinates(list(at), value if isinstance(value, (list,)) else [value] * len(at))
        elif hasattr(key, "__index__"):
            self.modify_coordinates([key], [value])
        else:
            keys = key.tolist() if hasattr(key, "tolist") else list(key)
            if keys and all(isinstance(k, bool) for k in keys):
                keys = [i for i, k in enumerate(keys) if k]
            self.modify_coordinates(keys, value)

    def reindex(self) -> None:
        for i in self.indexes.values():
            i.dirty = False

    reindex_dirty = reindex

    def flush_rows_to_index(self) -> int:
        self.reindex()
        return self.nrows if self.indexes else 0

    def flush(self) -> None:
        """Takes pending records in and, for a stored table, writes the present state as a new version."""
        self._flushed()
        if self.store is not None:
            self.store.write_table(self.path, self)


def _as_row(value: Any, t: T.DataType) -> Any:
    if isinstance(t, T.StructType):
        return tuple(_as_row(value[f.name], f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [_as_row(v, t.elementType) for v in value]
    if isinstance(t, T.DecimalType):
        import decimal

        return decimal.Decimal(value)
    return value


def _with_path(df: DataFrame, path: str, new: Column, field: T.StructField) -> DataFrame:
    if "/" not in path:
        return df.withColumn(path, new).withMetadata(path, field.metadata)
    top, rest = path.split("/", 1)
    return df.withColumn(top, F.col(top).withField(rest.replace("/", "."), new))
