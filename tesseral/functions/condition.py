"""Condition strings and array expressions, compiled to Spark columns.

A string is parsed with Python's own grammar, of which a small part is allowed, and typed bottom-up. The
result is an ordinary Column: Catalyst folds constants, pushes comparisons to the scan and generates code.
Floating-point columns follow IEEE 754 where Spark's SQL does not: NaN compares unequal and unordered,
division by zero and logarithms outside of their domain give infinities or NaN, and nothing becomes null.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, INT, LONG, FLOAT, DOUBLE, COMPLEX, TEXT, BYTES = "bool", "int", "long", "float", "double", "complex", "text", "bytes"
_RANK = {BOOL: 0, INT: 1, LONG: 2, FLOAT: 3, DOUBLE: 4, COMPLEX: 5}
COMPARISONS = {ast.Lt: "lt", ast.LtE: "le", ast.Eq: "eq", ast.NotEq: "ne", ast.GtE: "ge", ast.Gt: "gt"}
FLIPPED = {"lt": "gt", "le": "ge", "eq": "eq", "ne": "ne", "ge": "le", "gt": "lt"}


def _inf() -> Column:
    return F.lit(float("inf"))


def _nan_value() -> Column:
    return F.lit(float("nan"))


@dataclass
class Node:
    """One typed subexpression: how to compute it, and enough of its shape for index planning."""

    kind: str
    column: Column
    op: str
    children: tuple["Node", ...] = ()
    name: str | None = None
    value: Any = None
    columns: frozenset[str] = field(default_factory=frozenset)

    @property
    def is_constant(self) -> bool:
        return not self.columns


def is_complex(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and [f.name for f in t.fields] == ["re", "im"]


def kind_of(t: T.DataType) -> str:
    """The language's type of a column type; NotImplementedError for those that conditions exclude."""
    if is_complex(t):
        return COMPLEX
    for cls, kind in ((T.BooleanType, BOOL), (T.ByteType, INT), (T.ShortType, INT), (T.IntegerType, INT), (T.LongType, LONG), (T.FloatType, FLOAT), (T.DoubleType, DOUBLE), (T.StringType, TEXT), (T.BinaryType, BYTES)):
        if isinstance(t, cls):
            return kind
    if isinstance(t, T.ArrayType):
        raise NotImplementedError("multidimensional columns are not supported in conditions")
    if isinstance(t, T.StructType):
        raise TypeError("a group of columns cannot be a variable")
    raise NotImplementedError(f"columns of type {t.simpleString()} are not supported in conditions")


def literal(value: Any) -> Node:
    if hasattr(value, "item") and getattr(value, "ndim", 0) == 0:
        value = value.item()
    if isinstance(value, bool):
        return Node(BOOL, F.lit(value), "const", value=value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise NotImplementedError("integers beyond 64 bits are not supported")
        kind = INT if -(1 << 31) <= value < 1 << 31 else LONG
        return Node(kind, F.lit(value).cast("int" if kind == INT else "bigint"), "const", value=value)
    if isinstance(value, float):
        return Node(DOUBLE, F.lit(value), "const", value=value)
    if isinstance(value, complex):
        return Node(COMPLEX, _pair(F.lit(value.real), F.lit(value.imag)), "const", value=value)
    if isinstance(value, bytes):
        return Node(BYTES, F.lit(value.rstrip(b"\0")), "const", value=value)
    if isinstance(value, str):
        return Node(TEXT, F.lit(value), "const", value=value)
    raise TypeError(f"constants of type {type(value).__name__} are not supported")


def _pair(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def _re(n: Node) -> Column:
    return n.column.getField("re") if n.kind == COMPLEX else n.column.cast("double")


def _im(n: Node) -> Column:
    return n.column.getField("im") if n.kind == COMPLEX else F.lit(0.0)


def _float(n: Node) -> bool:
    return n.kind in (FLOAT, DOUBLE)


def _numeric(op: str, *nodes: Node) -> str:
    for n in nodes:
        if n.kind not in _RANK or n.kind == BOOL:
            raise NotImplementedError(f"{op} is not supported for {n.kind}")
    return max((n.kind for n in nodes), key=_RANK.__getitem__)


def _made(kind: str, column: Column, op: str, *children: Node) -> Node:
    return Node(kind, column, op, children, columns=frozenset().union(*(c.columns for c in children)))


def _nan(n: Node) -> Column | None:
    """Whether a floating value is NaN; None where it cannot be."""
    if not _float(n):
        return None
    if n.op == "const":
        return F.lit(True) if math.isnan(n.value) else None
    return F.isnan(n.column)


def compare(op: str, a: Node, b: Node) -> Node:
    if a.is_constant and not b.is_constant:
        flipped = compare(FLIPPED[op], b, a)
        return flipped
    kinds = {a.kind, b.kind}
    if kinds <= {TEXT, BYTES}:
        x, y = a.column, b.column
        if len(kinds) == 2:
            x, y = (n.column.cast("binary") if n.kind == TEXT else n.column for n in (a, b))
    elif kinds == {BOOL}:
        if op not in ("eq", "ne"):
            raise NotImplementedError("booleans are only equal or not")
        x, y = a.column, b.column
    elif BOOL in kinds or kinds & {TEXT, BYTES}:
        raise NotImplementedError(f"{a.kind} and {b.kind} cannot be compared")
    elif COMPLEX in kinds:
        if op not in ("eq", "ne"):
            raise NotImplementedError("complex numbers are only equal or not")
        same = (_re(a) == _re(b)) & (_im(a) == _im(b)) & ~F.isnan(_re(a)) & ~F.isnan(_im(a))
        return _made(BOOL, same if op == "eq" else ~same, op, a, b)
    else:
        x, y = a.column, b.column
        if FLOAT in kinds and b.op == "const" and b.kind == DOUBLE:
            y = y.cast("float")
    plain = {"lt": x < y, "le": x <= y, "eq": x == y, "ne": x != y, "ge": x >= y, "gt": x > y}[op]
    left, right = _nan(a), _nan(b)
    # Spark orders NaN above all numbers and equal to itself
    if right is None and left is not None and op in ("lt", "le", "eq", "ne"):
        left = None
    for bad in (left, right):
        if bad is not None:
            plain = plain | bad if op == "ne" else plain & ~bad
    return _made(BOOL, plain, op, a, b)


def _wide(n: Node) -> Column:
    return n.column.cast("bigint") if n.kind == INT else n.column


def arithmetic(op: str, a: Node, b: Node) -> Node:
    kind = _numeric(op, a, b)
    x, y = _wide(a), _wide(b)
    if kind == COMPLEX:
        ar, ai, br, bi = _re(a), _im(a), _re(b), _im(b)
        if op == "add":
            out = _pair(ar + br, ai + bi)
        elif op == "sub":
            out = _pair(ar - br, ai - bi)
        elif op == "mul":
            out = _pair(ar * br - ai * bi, ar * bi + ai * br)
        elif op == "div":
            size = br * br + bi * bi
            out = _pair(_divide(ar * br + ai * bi, size), _divide(ai * br - ar * bi, size))
        elif op == "pow" and b.op == "const" and isinstance(b.value, int) and 0 <= b.value <= 16:
            out, now = literal(1 + 0j), a
            for _ in range(b.value):
                out = arithmetic("mul", out, now)
            out = out.column
        elif op == "pow":
            zero = (ar == 0) & (ai == 0)
            found = _pair(*_zexp(_zmul((br, bi), _zlog((ar, ai)))))
            out = F.when(zero & (br == 0) & (bi == 0), _pair(F.lit(1.0), F.lit(0.0))).when(zero & (br > 0), _pair(F.lit(0.0), F.lit(0.0))).otherwise(found)
        else:
            raise NotImplementedError(f"{op} is not supported for complex numbers")
        return _made(COMPLEX, out, op, a, b)
    whole = kind in (INT, LONG)
    if whole:
        kind = LONG
    if op in ("add", "sub", "mul"):
        out = {"add": x + y, "sub": x - y, "mul": x * y}[op]
    elif op == "div":
        out = F.when(y == 0, F.lit(0)).otherwise(F.call_function("div", x, y)) if whole else _divide(x, y)
    elif op == "mod":
        out = F.when(y == 0, F.lit(0) if whole else _nan_value()).otherwise(x % y)
    elif whole and b.op == "const" and b.value >= 0:
        out = F.pow(x, y).cast("bigint")
    else:
        kind, out = DOUBLE, F.pow(x.cast("double"), y.cast("double"))
    return _made(kind, out, op, a, b)


def _divide(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.when(n > 0, F.when(F.isnan(n), _nan_value()).otherwise(_inf())).when(n < 0, -_inf()).otherwise(_nan_value())).otherwise(n / d)


def _log(f: Callable[[Column], Column], low: float) -> Callable[[Column], Column]:
    return lambda x: F.when(x > low, f(x)).when(x == low, -_inf()).otherwise(_nan_value())


REAL: dict[str, Callable[[Column], Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "log": _log(F.ln, 0), "log10": _log(F.log10, 0), "log1p": _log(F.log1p, -1), "exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt,
    "floor": lambda x: F.when(F.isnan(x) | (F.abs(x) == _inf()), x).otherwise(F.floor(x).cast("double")),
    "ceil": lambda x: F.when(F.isnan(x) | (F.abs(x) == _inf()), x).otherwise(F.ceil(x).cast("double")),
}
Z = tuple[Column, Column]


def _z(n: Node) -> Z:
    return _re(n), _im(n)


def _zadd(a: Z, b: Z) -> Z:
    return a[0] + b[0], a[1] + b[1]


def _zmul(a: Z, b: Z) -> Z:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _zdiv(a: Z, b: Z) -> Z:
    size = b[0] * b[0] + b[1] * b[1]
    return _divide(a[0] * b[0] + a[1] * b[1], size), _divide(a[1] * b[0] - a[0] * b[1], size)


def _zscale(a: Z, k: float) -> Z:
    return a[0] * k, a[1] * k


def _zexp(a: Z) -> Z:
    return F.exp(a[0]) * F.cos(a[1]), F.exp(a[0]) * F.sin(a[1])


def _zlog(a: Z) -> Z:
    return _log(F.ln, 0)(F.hypot(*a)), F.atan2(a[1], a[0])


def _zsqrt(a: Z) -> Z:
    size, angle = F.sqrt(F.hypot(*a)), F.atan2(a[1], a[0]) / 2
    return size * F.cos(angle), size * F.sin(angle)


def _zsin(a: Z) -> Z:
    return F.sin(a[0]) * F.cosh(a[1]), F.cos(a[0]) * F.sinh(a[1])


def _zcos(a: Z) -> Z:
    return F.cos(a[0]) * F.cosh(a[1]), -F.sin(a[0]) * F.sinh(a[1])


def _zsinh(a: Z) -> Z:
    return F.sinh(a[0]) * F.cos(a[1]), F.cosh(a[0]) * F.sin(a[1])


def _zcosh(a: Z) -> Z:
    return F.cosh(a[0]) * F.cos(a[1]), F.sinh(a[0]) * F.sin(a[1])


def _one(k: float = 1.0) -> Z:
    return F.lit(k), F.lit(0.0)


def _turn(a: Z, k: int) -> Z:
    """Times i, k times."""
    for _ in range(k % 4):
        a = -a[1], a[0]
    return a


def _zarcsinh(a: Z) -> Z:
    return _zlog(_zadd(a, _zsqrt(_zadd(_zmul(a, a), _one()))))


def _zarcsin(a: Z) -> Z:
    return _turn(_zarcsinh(_turn(a, 1)), 3)


def _zarccos(a: Z) -> Z:
    return _zadd(_one(math.pi / 2), _zscale(_zarcsin(a), -1.0))


def _zarccosh(a: Z) -> Z:
    return _zlog(_zadd(a, _zmul(_zsqrt(_zadd(a, _one())), _zsqrt(_zadd(a, _one(-1.0))))))


def _zarctanh(a: Z) -> Z:
    return _zscale(_zadd(_zlog(_zadd(_one(), a)), _zscale(_zlog(_zadd(_one(), _zscale(a, -1.0))), -1.0)), 0.5)


_OF_COMPLEX: dict[str, Callable[[Z], Z]] = {
    "exp": _zexp, "log": _zlog, "sqrt": _zsqrt, "sin": _zsin, "cos": _zcos, "sinh": _zsinh, "cosh": _zcosh,
    "tan": lambda a: _zdiv(_zsin(a), _zcos(a)), "tanh": lambda a: _zdiv(_zsinh(a), _zcosh(a)),
    "arcsin": _zarcsin, "arccos": _zarccos, "arctan": lambda a: _turn(_zarctanh(_turn(a, 1)), 3),
    "arcsinh": _zarcsinh, "arccosh": _zarccosh, "arctanh": _zarctanh,
    "log10": lambda a: _zscale(_zlog(a), 1 / math.log(10)), "log1p": lambda a: _zlog(_zadd(_one(), a)), "expm1": lambda a: _zadd(_zexp(a), _one(-1.0)),
}
COMPLEXES: dict[str, Callable[[Node], Column]] = {name: (lambda f: lambda n: _pair(*f(_z(n))))(f) for name, f in _OF_COMPLEX.items()}
OTHER = {"where": 3, "arctan2": 2, "fmod": 2, "abs": 1, "real": 1, "imag": 1, "conj": 1, "complex": 2, "ones_like": 1}
FUNCTIONS = frozenset(REAL) | frozenset(OTHER)


def call(name: str, args: list[Node]) -> Node:
    want = OTHER.get(name, 1)
    if len(args) != want:
        raise TypeError(f"{name} takes {want} arguments")
    if name == "where":
        test, a, b = args
        if test.kind != BOOL:
            raise NotImplementedError("where needs a boolean first")
        if {a.kind, b.kind} <= {TEXT, BYTES} or a.kind == b.kind == BOOL:
            kind, x, y = a.kind, a.column, b.column
        else:
            kind = _numeric(name, a, b)
            if kind == COMPLEX:
                x, y = _pair(_re(a), _im(a)), _pair(_re(b), _im(b))
            else:
                x, y = a.column, b.column
        return _made(kind, F.when(test.column, x).otherwise(y), name, *args)
    kind = _numeric(name, *args)
    if name in ("real", "imag"):
        return _made(DOUBLE, (_re if name == "real" else _im)(args[0]), name, *args)
    if name == "complex":
        return _made(COMPLEX, _pair(_re(args[0]), _re(args[1])), name, *args)
    if name == "conj":
        return _made(COMPLEX, _pair(_re(args[0]), -_im(args[0])), name, *args)
    if name == "abs":
        if kind == COMPLEX:
            return _made(DOUBLE, F.sqrt(_re(args[0]) * _re(args[0]) + _im(args[0]) * _im(args[0])), name, *args)
        return _made(LONG if kind == INT else kind, F.abs(_wide(args[0])), name, *args)
    if name == "ones_like":
        return _made(kind, F.when(args[0].column.isNotNull(), F.lit(1)).cast("double"), name, *args)
    if kind == COMPLEX:
        if name not in COMPLEXES:
            raise NotImplementedError(f"{name} is not supported for complex numbers")
        return _made(COMPLEX, COMPLEXES[name](args[0]), name, *args)
    x = [a.column.cast("double") for a in args]
    if name == "arctan2":
        return _made(DOUBLE, F.atan2(*x), name, *args)
    if name == "fmod":
        return _made(DOUBLE, F.when(x[1] == 0, _nan_value()).otherwise(x[0] % x[1]), name, *args)
    return _made(FLOAT if kind == FLOAT else DOUBLE, REAL[name](x[0]).cast("float") if kind == FLOAT else REAL[name](x[0]), name, *args)


_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Mod: "mod", ast.Pow: "pow"}


def parse(text: str, resolve: Callable[[str], Node]) -> Node:
    """The typed tree of an expression; resolve(name) gives its variables."""
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise SyntaxError(f"not an expression: {text!r}") from e

    def go(n: ast.expr) -> Node:
        if isinstance(n, ast.Constant):
            if n.value is None or n.value is Ellipsis:
                raise TypeError("constants must be numbers, booleans or strings")
            return literal(n.value)
        if isinstance(n, ast.Name):
            return resolve(n.id)
        if isinstance(n, ast.Compare):
            if len(n.ops) > 1:
                raise NotImplementedError("chained comparisons do not work: write (a < x) & (x < b)")
            if type(n.ops[0]) not in COMPARISONS:
                raise NotImplementedError("only < <= == != >= > compare")
            return compare(COMPARISONS[type(n.ops[0])], go(n.left), go(n.comparators[0]))
        if isinstance(n, ast.BoolOp) or isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            raise TypeError("use & | ~ in place of and, or, not")
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.BitAnd, ast.BitOr)):
            a, b = go(n.left), go(n.right)
            if a.kind != BOOL or b.kind != BOOL:
                raise NotImplementedError("& and | are for booleans")
            both = isinstance(n.op, ast.BitAnd)
            return _made(BOOL, a.column & b.column if both else a.column | b.column, "and" if both else "or", a, b)
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return arithmetic(_BINARY[type(n.op)], go(n.left), go(n.right))
        if isinstance(n, ast.UnaryOp):
            a = go(n.operand)
            if isinstance(n.op, ast.Invert):
                if a.kind != BOOL:
                    raise NotImplementedError("~ is for booleans")
                return _made(BOOL, ~a.column, "not", a)
            kind = _numeric("sign", a)
            if isinstance(n.op, ast.UAdd):
                return a
            if a.op == "const":
                return literal(-a.value)
            return _made(kind, _pair(-_re(a), -_im(a)) if kind == COMPLEX else -a.column, "neg", a)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            if n.func.id not in FUNCTIONS:
                raise NameError(f"no function {n.func.id}")
            return call(n.func.id, [go(a) for a in n.args])
        raise NotImplementedError(f"{type(n).__name__} is not part of the language")

    return go(body)


def variables(text: str) -> list[str]:
    tree = ast.parse(text.strip(), mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return list(dict.fromkeys(n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called))


def column_node(path: str, t: T.DataType, column: Column | None = None) -> Node:
    c = F.col(".".join(f"`{p}`" for p in path.split("/"))) if column is None else column
    return Node(kind_of(t), c, "column", name=path, columns=frozenset([path]))


def compile_condition(text: str, resolve: Callable[[str], Node]) -> Node:
    """A boolean expression over at least one column."""
    node = parse(text, resolve)
    if node.kind != BOOL:
        raise TypeError(f"condition {text!r} is not boolean")
    if not node.columns:
        raise ValueError(f"condition {text!r} has no columns")
    return node


def resolver(schema: T.StructType, condvars: Mapping[str, Any] | None, frames: Mapping[str, Any] | None = None, as_node: Callable[[Any], Node | None] = lambda v: None) -> Callable[[str], Node]:
    """Names are condvars, then top-level columns, then, only without condvars, the caller's variables."""

    def resolve(name: str) -> Node:
        if condvars is not None and name in condvars:
            value = condvars[name]
            node = as_node(value)
            return literal(value) if node is None else node
        if name in schema.names:
            return column_node(name, schema[name].dataType) if not _unsigned64(schema[name]) else _refuse(name)
        if condvars is None and frames is not None and name in frames:
            node = as_node(frames[name])
            return literal(frames[name]) if node is None else node
        raise NameError(f"name {name!r} is not defined")

    return resolve


def _unsigned64(f: T.StructField) -> bool:
    return f.metadata.get("type") == "uint64" or isinstance(f.dataType, T.DecimalType)


def _refuse(name: str) -> Node:
    raise NotImplementedError(f"column {name!r} holds 64-bit unsigned integers, which conditions do not support")
