import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tesseral import Table, types
from tesseral.functions.condition import FUNCTIONS

NUMBERS = [(k, k % 7, float(k) / 4 - 3, k % 3 == 0, f"{k:02d}".encode()) for k in range(60)]


@pytest.fixture(scope="module")
def numbers(spark):
    return Table(spark.createDataFrame([(*r, r[0]) for r in NUMBERS], "k long, m int, x double, b boolean, s binary, nrow long"))


def chosen(t, condition, condvars=None):
    return sorted(r["k"] for r in t.where(condition, {} if condvars is None else condvars).collect())


@pytest.mark.parametrize("op", ["<", "<=", "==", "!=", ">=", ">"])
@pytest.mark.parametrize("side", ["m {} 4", "4 {} m", "x {} 2.5", "k {} m", "s {} b'12'"])
def test_comparisons(numbers, op, side):
    text = side.format(op)
    want = [k for k, m, x, b, s in NUMBERS if eval(text)]
    assert chosen(numbers, text) == want


@pytest.mark.parametrize("text", ["(m > 2) & ~b", "b | (x < 0)", "~(b & (m > 1)) | (k == 3)", "-x > 1", "k % 5 == 2", "m ** 2 > 10", "(k + m * 2 - 1) / 2 > 10", "where(b, x, k) > 20"])
def test_operators(numbers, text):
    row = dict(where=lambda c, a, d: a if c else d)
    py = text.replace("~b", "(not b)").replace("~(", "not (").replace("/ 2", "// 2").replace("&", " and ").replace("|", " or ")
    want = [k for k, m, x, b, s in NUMBERS if eval(py, row, dict(k=k, m=m, x=x, b=b, s=s))]
    assert chosen(numbers, text) == want


@pytest.mark.parametrize("name", ["sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "arcsinh", "arccosh", "arctanh", "log", "log10", "log1p", "exp", "expm1", "sqrt", "abs", "floor", "ceil"])
def test_functions_are_ieee(spark, name):
    xs = [-2.0, -1.0, -0.5, 0.0, 0.25, 1.0, 3.0, math.nan, math.inf]
    t = Table(spark.createDataFrame([(x, k) for k, x in enumerate(xs)], "x double, nrow long"))
    from tesseral.functions.condition import parse, resolver

    got = [r[0] for r in t.df.orderBy("nrow").select(parse(f"{name}(x)", resolver(t.schema, {})).column).collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(np.array(xs))
    assert None not in got
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_nan_and_zero(spark):
    t = Table(spark.createDataFrame([(math.nan, 0.0, 0), (5.0, 2.0, 1), (20.0, 0.0, 2)], "x double, y double, nrow long"))
    rows = lambda c: sorted(r["nrow"] for r in t.where(c, {}).collect())
    assert rows("x > 10") == [2] and rows("x < 10") == [1] and rows("x != 5") == [0, 2] and rows("x == x") == [1, 2]
    assert rows("~(x > 10)") == [0, 1] and rows("~(x < 10)") == [0, 2]
    assert rows("x / y > 1e300") == [2] and rows("y > x") == [] and rows("x != x") == [0]


def test_complex(spark):
    z = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    t = Table(spark.createDataFrame([((3.0, 4.0), 0), ((1.0, 0.0), 1)], T.StructType([T.StructField("z", z), T.StructField("nrow", T.LongType())])))
    assert [r["nrow"] for r in t.where("abs(z) == 5", {}).collect()] == [0]
    assert [r["nrow"] for r in t.where("z * z == w", {"w": -7 + 24j}).collect()] == [0]
    assert [r["nrow"] for r in t.where("real(z) + imag(conj(z)) == 1", {}).collect()] == [1]
    with pytest.raises(NotImplementedError):
        t.where("z > 1", {})


@pytest.mark.parametrize(
    ("text", "error"),
    [("1 < m < 5", NotImplementedError), ("(m > 1) and b", TypeError), ("not b", TypeError), ("m + 1", TypeError), ("True", ValueError), ("nothing > 1", NameError), ("b > False", NotImplementedError), ("m & 3", NotImplementedError), ("m >", SyntaxError), ("erf(x) > 1", NameError), ("s == 3", NotImplementedError), ("m in [1]", NotImplementedError), ("x.y > 1", NotImplementedError), ("sin(x, x) > 0", TypeError)],
)
def test_errors(numbers, text, error):
    with pytest.raises(error):
        numbers.where(text, {})


def test_types_that_conditions_refuse(spark):
    t = Table.from_rows(spark, {"u": types.UInt64Col(), "v": types.Int32Col(shape=(2,))}, [(1, [1, 2])])
    for c in ("u > 0", "v > 0"):
        with pytest.raises(NotImplementedError):
            t.where(c, {})


def test_names(numbers):
    limit = 50  # noqa: F841
    assert [r["k"] for r in numbers.where("k > limit").orderBy("k").collect()] == list(range(51, 60))
    with pytest.raises(NameError):
        numbers.where("k > limit", {})
    k = 3  # noqa: F841 - columns come before the caller's variables
    assert numbers.where("k > 57").count() == 2
    assert chosen(numbers, "c > 57", {"c": numbers.cols.k}) == [58, 59]
    with pytest.raises(ValueError):
        numbers.where("c > 1", {"c": Table(numbers.df).cols.k})
    assert "where" in FUNCTIONS


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as double) as x").write.parquet(str(tmp_path / "t"))
    t = Table.from_parquet(spark, str(tmp_path / "t"))
    plan = t.where("(id > 990) & (x > 995)", {}).select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(id,990)" in plan and "GreaterThan(x,995" in plan and "Python" not in plan


def test_complex_functions_agree_with_python(spark):
    import cmath
    import math

    names = {"tan": cmath.tan, "tanh": cmath.tanh, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "arcsinh": cmath.asinh, "arccosh": cmath.acosh, "arctanh": cmath.atanh, "log10": cmath.log10, "sqrt": cmath.sqrt}
    names |= {"log1p": lambda z: cmath.log(1 + z), "expm1": lambda z: cmath.exp(z) - 1, "sin": cmath.sin, "exp": cmath.exp}
    points = [complex(x, y) for x in (-0.7, 0.3, 1.6) for y in (-0.9, 0.4, 2.1)]
    t = Table(spark.createDataFrame([(k, z.real, z.imag) for k, z in enumerate(points)], "nrow long, a double, b double"))
    for name, f in names.items():
        for part, of in (("real", lambda z: z.real), ("imag", lambda z: z.imag)):
            column = t.compile(f"{part}({name}(complex(a, b))) > 0", {}).children[0].column
            got = [r[0] for r in t.df.orderBy("nrow").select(column).collect()]
            assert all(math.isclose(x, of(f(z)), rel_tol=1e-9, abs_tol=1e-9) for x, z in zip(got, points)), (name, part)
    column = t.compile("real(complex(a, b) ** complex(b, a)) > 0", {}).children[0].column
    assert all(math.isclose(r[0], (z ** complex(z.imag, z.real)).real, rel_tol=1e-9) for r, z in zip(t.df.orderBy("nrow").select(column).collect(), points))
