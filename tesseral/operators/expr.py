"""Element-wise expressions over arrays and columns, with broadcasting; the shortest main axis wins."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.condition import Node, kind_of, literal, parse, variables
from .arrays import NdArray, RaggedArray, axes
from .rows import NROW, in_slice, slice_of
from .table import ColumnHandle, Table


class Expr:
    """``Expr("2*a + c", {"a": array, "c": array}).eval()`` gives an array lazily."""

    def __init__(self, text: str, uservars: Mapping[str, Any] | None = None):
        self.text, self.names = text, variables(text)
        if uservars is None:
            f = inspect.currentframe().f_back
            uservars = {**f.f_globals, **f.f_locals}
        self.values: dict[str, Any] = {}
        for n in self.names:
            if n not in uservars:
                raise NameError(f"name {n!r} is not defined")
            v = uservars[n]
            if isinstance(v, (RaggedArray, Table)):
                raise TypeError(f"{n}: ragged arrays and whole tables cannot be operands")
            if isinstance(v, ColumnHandle):
                kind_of(v.dtype)
                v = NdArray(v.table._flushed().select(F.col(NROW).alias("i0"), F.col(".".join(f"`{p}`" for p in v.path.split("/"))).alias("value")), (v.table.nrows,))
            elif hasattr(v, "ndim") and v.ndim and not isinstance(v, NdArray):
                arrays = [x for x in uservars.values() if isinstance(x, (NdArray, ColumnHandle))]
                if not arrays:
                    raise TypeError("a NumPy operand needs an array beside it")
                spark = (arrays[0].df if isinstance(arrays[0], NdArray) else arrays[0].table.df).sparkSession
                v = NdArray.from_numpy(spark, v)
            self.values[n] = v
        self._in: tuple[Any, Any, Any] = (None, None, None)
        self._out: NdArray | None = None
        self._append, self._out_range = False, (None, None, None)

    def set_inputs_range(self, start=None, stop=None, step=None) -> None:
        self._in = (start, stop, step)

    def set_output(self, out: NdArray, append_mode: bool = False) -> None:
        self._out, self._append = out, append_mode

    def set_output_range(self, start=None, stop=None, step=None) -> None:
        if self._out is None:
            raise IndexError("a range of the output needs an output")
        self._out_range = (start, stop, step)

    def _operands(self) -> tuple[dict[str, NdArray], tuple[int, ...]]:
        arrays = {n: v for n, v in self.values.items() if isinstance(v, NdArray)}
        if not arrays:
            return {}, ()
        rank = max(a.ndim for a in arrays.values())
        main = min(a.shape[0] for a in arrays.values() if a.ndim == rank)
        shape = [main, *[1] * (rank - 1)]
        for a in arrays.values():
            for k, n in enumerate(a.shape):
                at = k + rank - a.ndim
                if at == 0:
                    continue
                if n != shape[at] and 1 not in (n, shape[at]):
                    raise ValueError(f"shapes do not broadcast: {[x.shape for x in arrays.values()]}")
                shape[at] = max(n, shape[at])
        return arrays, tuple(shape)

    def _joined(self, arrays: dict[str, NdArray], shape: tuple[int, ...]) -> DataFrame:
        rank, df, s = len(shape), None, slice_of(*self._in, shape[0], reverse=False)
        for n, a in sorted(arrays.items(), key=lambda x: -x[1].ndim):
            own, shift = a.cells(), rank - a.ndim
            full = a.ndim == rank
            if full and (s != (0, shape[0], 1) or a.shape[0] > shape[0]):
                own = own.where(in_slice(*s, at="i0"))
            keys = [k for k in range(a.ndim) if not (a.shape[k] == 1 and shape[k + shift] > 1)]
            own = own.select(*[F.col(f"i{k}").alias(f"i{k + shift}") for k in keys], F.col("value").alias(f"__{n}"))
            on = [f"i{k + shift}" for k in keys]
            if df is None:
                if len(on) < rank:
                    raise ValueError("the operand of highest rank must not be broadcast itself")
                df = own
            else:
                df = df.join(own, on) if on else df.withColumn(f"__{n}", F.lit(own.first()[0]))
        if s != (0, shape[0], 1):
            df = df.withColumn("i0", F.expr(f"(i0 - {s[0]}L) div {s[2]}L"))
        return df

    def eval(self) -> NdArray:
        arrays, shape = self._operands()
        if not arrays:
            raise ValueError("an expression has at least one array")
        df = self._joined(arrays, shape)

        def resolve(name: str) -> Node:
            v = self.values[name]
            if isinstance(v, NdArray):
                return Node(kind_of(v.df.schema["value"].dataType), F.col(f"__{name}"), "column", name=name, columns=frozenset([name]))
            return literal(v)

        value: Column = parse(self.text, resolve).column
        n = len(range(*slice_of(*self._in, shape[0], reverse=False)))
        result = NdArray(df.select(*axes(len(shape)), value.alias("value")), (n, *shape[1:]))
        if self._out is None:
            return result
        if self._append:
            return self._out.append(result)
        s = slice_of(*self._out_range, self._out.shape[0], reverse=False)
        fits = min(len(range(*s)), n)
        stop = s[0] + (fits - 1) * s[2] + 1 if fits else s[0]
        return self._out.set(slice(s[0], stop, s[2]), result if fits == n else result[slice(0, fits)])

    def __iter__(self) -> Iterator[Any]:
        return self.eval().iterrows()

    def map_rows(self, each: Callable[[Iterator[Any]], Iterator[tuple]], schema: str) -> DataFrame:
        """Iterates over the outcome in the tasks; see ``NdArray.map_rows``."""
        return self.eval().map_rows(each, schema)


def over_blocks(df: DataFrame, index: str, block: str, text: str, name: str = "x", out: str = "y") -> DataFrame:
    """An expression over nested arrays of rows, element by element, without exploding them."""

    def each(v: Column) -> Column:
        return parse(text, lambda n: Node("double", v.cast("double"), "column", name=n, columns=frozenset([n])) if n == name else _unknown(n)).column

    return df.select(index, F.transform(block, each).alias(out))


def _unknown(name: str) -> Node:
    raise NameError(f"name {name!r} is not defined")
