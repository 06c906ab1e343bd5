"""Declared columns, and the Spark schema that carries their declaration in field metadata.

There are no nulls: every column has a default for cells that are not given. Fields without a position
come after those with one, by name.
"""

from __future__ import annotations

import base64
import itertools
import json
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import types as T

from .enums import Enum

_COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
#: kind: (Spark type, default)
KINDS: dict[str, tuple[T.DataType, Any]] = {
    "bool": (T.BooleanType(), False), "int8": (T.ByteType(), 0), "int16": (T.ShortType(), 0), "int32": (T.IntegerType(), 0), "int64": (T.LongType(), 0),
    "uint8": (T.ShortType(), 0), "uint16": (T.IntegerType(), 0), "uint32": (T.LongType(), 0), "uint64": (T.DecimalType(20, 0), 0),
    "float16": (T.FloatType(), 0.0), "float32": (T.FloatType(), 0.0), "float64": (T.DoubleType(), 0.0), "float96": (T.DoubleType(), 0.0), "float128": (T.DoubleType(), 0.0),
    "complex64": (_COMPLEX, 0j), "complex128": (_COMPLEX, 0j), "string": (T.BinaryType(), b""), "unicode": (T.StringType(), ""), "time32": (T.IntegerType(), 0), "time64": (T.DoubleType(), 0.0),
}
RANGES = {"int8": (-128, 127), "int16": (-(1 << 15), (1 << 15) - 1), "int32": (-(1 << 31), (1 << 31) - 1), "int64": (-(1 << 63), (1 << 63) - 1), "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, (1 << 32) - 1), "uint64": (0, (1 << 64) - 1), "time32": (-(1 << 31), (1 << 31) - 1)}
_order = itertools.count()


class Col:
    """A declared column: kind, cell shape, default, position, and for strings the length in bytes."""

    def __init__(self, kind: str, shape: tuple[int, ...] = (), dflt: Any = None, pos: int | None = None, itemsize: int | None = None, enum: Enum | None = None):
        if kind not in KINDS and kind != "enum":
            raise TypeError(f"no column kind {kind!r}")
        if kind == "string" and not itemsize:
            raise TypeError("string columns need an itemsize")
        self.kind, self.shape, self.pos, self.itemsize, self.enum = kind, (shape,) if isinstance(shape, int) else tuple(shape), pos, itemsize, enum
        self.base = "int64" if kind != "enum" else "int32"
        if kind == "enum":
            if enum is None or dflt is None:
                raise TypeError("enumerated columns need their enumeration and a default name")
            self.dflt = enum[dflt]
        else:
            self.dflt = KINDS[kind][1] if dflt is None else dflt

    @property
    def data_type(self) -> T.DataType:
        t = T.IntegerType() if self.kind == "enum" else KINDS[self.kind][0]
        for _ in self.shape:
            t = T.ArrayType(t, containsNull=False)
        return t

    def metadata(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.kind, "default": json.dumps(_plain(self.dflt))}
        if self.shape:
            out["shape"] = list(self.shape)
        if self.itemsize:
            out["itemsize"] = self.itemsize
        if self.enum is not None:
            out["enum"] = json.dumps({n: v for n, v in self.enum})
        return out

    def default(self) -> Any:
        """The default cell as a Spark value, broadcast to the shape."""
        return self.value(self.dflt)

    def value(self, x: Any) -> Any:
        """A Python or NumPy value as this column stores it; ValueError if it does not fit."""
        if self.shape:
            return self._fill(x, self.shape)
        return self.scalar(x)

    def _fill(self, x: Any, shape: tuple[int, ...]) -> list:
        x = x.tolist() if hasattr(x, "tolist") else x
        if not isinstance(x, (list, tuple)):
            x = [x] * shape[0]
        if len(x) != shape[0]:
            raise ValueError(f"a cell of shape {self.shape} got {len(x)} values along an axis")
        return [self._fill(v, shape[1:]) if len(shape) > 1 else self.scalar(v) for v in x]

    def scalar(self, x: Any) -> Any:
        x = x.item() if hasattr(x, "item") else x
        if x is None:
            return self.value(self.dflt) if not self.shape else self.scalar(self.dflt)
        try:
            if self.kind == "bool":
                return bool(x)
            if self.kind == "enum":
                return self.enum[x] if isinstance(x, str) else int(x)
            if self.kind in RANGES:
                n = int(x)
                low, high = RANGES[self.kind]
                if not low <= n <= high:
                    raise ValueError(f"{n} does not fit {self.kind}")
                return n
            if self.kind.startswith("complex"):
                z = complex(x)
                return {"re": z.real, "im": z.imag}
            if self.kind == "string":
                b = x.encode() if isinstance(x, str) else bytes(x)
                return b[: self.itemsize].rstrip(b"\0")
            if self.kind == "unicode":
                return str(x)
            return round(float(x) * 1e6) / 1e6 if self.kind == "time64" else float(x)
        except TypeError as e:
            raise ValueError(f"{x!r} does not fit {self.kind}") from e


def _plain(x: Any) -> Any:
    x = x.tolist() if hasattr(x, "tolist") else x
    if isinstance(x, complex):
        return {"re": x.real, "im": x.imag}
    if isinstance(x, bytes):
        return {"b64": base64.b64encode(x).decode()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


def _back(x: Any) -> Any:
    if isinstance(x, dict):
        return base64.b64decode(x["b64"]) if "b64" in x else complex(x["re"], x["im"])
    return [_back(v) for v in x] if isinstance(x, list) else x


def _col(name: str):
    def make(shape: tuple[int, ...] = (), dflt: Any = None, pos: int | None = None) -> Col:
        return Col(name, shape, dflt, pos)

    make.__name__ = name
    return make


BoolCol, Int8Col, Int16Col, Int32Col, Int64Col, UInt8Col, UInt16Col, UInt32Col, UInt64Col, Float16Col, Float32Col, Float64Col, Complex64Col, Complex128Col, Time32Col, Time64Col = map(
    _col, ("bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "complex64", "complex128", "time32", "time64")
)


def StringCol(itemsize: int, shape: tuple[int, ...] = (), dflt: Any = None, pos: int | None = None) -> Col:
    return Col("string", shape, dflt, pos, itemsize)


def EnumCol(enum: Enum, dflt: str, shape: tuple[int, ...] = (), pos: int | None = None) -> Col:
    return Col("enum", shape, dflt, pos, enum=enum)


class Record:
    """Subclass with Col attributes (and nested Record classes) to declare a record."""


class Description:
    """Named columns and nested descriptions, in their order."""

    def __init__(self, spec: Any):
        if isinstance(spec, type) and issubclass(spec, Record):
            spec = {n: v for k in reversed(spec.__mro__) for n, v in vars(k).items() if not n.startswith("__") and (isinstance(v, Col) or isinstance(v, type) and issubclass(v, Record) or n == "_pos")}
        if hasattr(spec, "fields") and hasattr(spec, "itemsize"):
            spec = self._of_dtype(spec)
        if not isinstance(spec, Mapping):
            raise TypeError("a description is a mapping or a Record class")
        self.pos = spec.get("_pos")
        items = {n: v if isinstance(v, Col) else Description(v) for n, v in spec.items() if n != "_pos"}
        placed = sorted((n for n in items if items[n].pos is not None), key=lambda n: (items[n].pos, n))
        self.columns: dict[str, Col | Description] = {n: items[n] for n in [*placed, *sorted(n for n in items if items[n].pos is None)]}

    @classmethod
    def _of_dtype(cls, dtype: Any) -> dict[str, Any]:
        """Columns of a NumPy record type, in its order."""
        if not dtype.names:
            raise TypeError("a NumPy type needs named fields")
        out: dict[str, Any] = {}
        for k, name in enumerate(dtype.names):
            t = dtype[name]
            base, shape = t.subdtype if t.subdtype else (t, ())
            if base.names:
                out[name] = cls._of_dtype(base) | {"_pos": k}
            elif base.kind == "S":
                out[name] = Col("string", shape, pos=k, itemsize=base.itemsize)
            elif base.kind == "U":
                out[name] = Col("unicode", shape, pos=k)
            else:
                out[name] = Col({"bool_": "bool"}.get(base.name, base.name), shape, pos=k)
        return out

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.schema() if isinstance(c, Description) else c.data_type, True, {} if isinstance(c, Description) else c.metadata()) for n, c in self.columns.items()])

    def row(self, given: Any) -> dict[str, Any]:
        """A record with defaults for what is not given; sequences are by position."""
        if not isinstance(given, Mapping):
            values = given.item() if hasattr(given, "item") and getattr(given, "ndim", 0) == 0 else given
            if len(values) != len(self.columns):
                raise ValueError(f"a record has {len(self.columns)} fields, not {len(values)}")
            given = dict(zip(self.columns, values))
        if extra := set(given) - set(self.columns):
            raise KeyError(f"no columns {sorted(extra)}")
        return {n: (c.row(given.get(n, {})) if isinstance(c, Description) else c.value(given[n]) if n in given else c.default()) for n, c in self.columns.items()}

    def paths(self, prefix: str = "") -> Iterator[tuple[str, Col]]:
        for n, c in self.columns.items():
            if isinstance(c, Description):
                yield from c.paths(f"{prefix}{n}/")
            else:
                yield prefix + n, c

    @classmethod
    def from_schema(cls, schema: T.StructType) -> Description:
        """Reads declarations back from metadata; plain Spark fields get the matching kind and its default."""
        by_type = {T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.DecimalType: "uint64", T.StringType: "unicode"}
        out: dict[str, Any] = {}
        for i, f in enumerate(schema.fields):
            m, t, dims = f.metadata or {}, f.dataType, 0
            while isinstance(t, T.ArrayType):
                t, dims = t.elementType, dims + 1
            if "type" in m:
                enum = Enum(json.loads(m["enum"])) if "enum" in m else None
                dflt = _back(json.loads(m["default"]))
                out[f.name] = Col(m["type"], tuple(m.get("shape", ())), enum(dflt) if enum else dflt, i, m.get("itemsize"), enum)
            elif isinstance(t, T.StructType) and [x.name for x in t.fields] != ["re", "im"]:
                out[f.name] = cls.from_schema(t)
                out[f.name].pos = i
            elif isinstance(t, T.StructType):
                out[f.name] = Col("complex128", pos=i)
            elif isinstance(t, T.BinaryType):
                out[f.name] = Col("string", pos=i, itemsize=1 << 30)
            elif type(t) in by_type and not dims:
                out[f.name] = Col(by_type[type(t)], pos=i)
        new = cls.__new__(cls)
        new.pos, new.columns = None, out
        return new
