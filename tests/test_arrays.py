import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral import Expr, NdArray, RaggedArray, Table
from tesseral.operators.recipes import exact_sum
from tesseral.plans.registry import QUERIES

A = np.arange(60).reshape(5, 4, 3)


@pytest.fixture(scope="module")
def a(spark):
    return NdArray.from_numpy(spark, A, extdim=0)


@pytest.mark.parametrize("key", [np.s_[1:4], np.s_[..., 1], np.s_[2], np.s_[::2, 1:, -1], np.s_[[3, 0]], np.s_[:, [2, 0], 1], np.s_[-1, ..., ::2], np.s_[1, 2, 0:2]])
def test_slicing(a, key):
    got = a[key]
    assert got.shape == A[key].shape
    np.testing.assert_array_equal(got.to_numpy(), A[key])


@pytest.mark.parametrize("key", [np.s_[[1, 1]], np.s_[[0], [1]], np.s_[[]], np.s_[5], np.s_[0, 0, 0, 0]])
def test_bad_selections(a, key):
    with pytest.raises(IndexError):
        a[key]


def test_points_and_assignment(spark, a):
    assert [r["value"] for r in a.read_coords([(0, 0, 0), (-1, 3, 2), (0, 0, 0)]).orderBy("pos").collect()] == [0, 59, 0]
    want = A.copy()
    want[1:3, :, 0] = -1
    np.testing.assert_array_equal(a.set(np.s_[1:3, :, 0], -1).to_numpy(), want)
    want = A.copy()
    want[0] = A[1] * 2
    np.testing.assert_array_equal(a.set(0, NdArray.from_numpy(spark, A[1] * 2)).to_numpy(), want)
    with pytest.raises(ValueError):
        a.set(0, NdArray.from_numpy(spark, A[1:]))


def test_growth(spark, a):
    both = a.append(a[:2])
    np.testing.assert_array_equal(both.to_numpy(), np.concatenate([A, A[:2]]))
    with pytest.raises(ValueError):
        a.append(a[:, :2])
    c = NdArray.filled(spark, (2, 3), 7.0)
    np.testing.assert_array_equal(c.set(np.s_[0, 1], 1.0).to_numpy(), [[7, 1, 7], [7, 7, 7]])
    assert a.truncate(2).shape == (2, 4, 3)
    assert [p.tolist() for p in a.iterrows(3)] == A[3:].tolist()


def test_ragged(spark):
    r = RaggedArray.from_lists(spark, [[1, 2], [3, 4, 5], [], [6]])
    r.append([7, 8])
    assert list(r.iterrows()) == [[1, 2], [3, 4, 5], [], [6], [7, 8]] and r[-1] == [7, 8] and r[::2] == [[1, 2], [], [7, 8]]
    assert r[[3, 0]] == [[6], [1, 2]] and r.get_row_size(1) == 24
    r[1] = 9
    r[0] = [4, 5]
    assert r[:2] == [[4, 5], [9, 9, 9]]
    with pytest.raises(ValueError):
        r[3] = [1, 2]
    o = RaggedArray.from_lists(spark, [{"a": 1}, (2, 3)], kind="object")
    assert list(o.iterrows()) == [{"a": 1}, (2, 3)]
    s = RaggedArray.from_lists(spark, ["é", ""], kind="vlunicode")
    assert s[0] == "é" and [x["size"] for x in s.sizes().orderBy("nrow").collect()] == [2, 0]


def test_expressions(spark, a):
    v = NdArray.from_numpy(spark, np.array([1.0, 2.0, 3.0]))
    np.testing.assert_allclose(Expr("2*a + v", {"a": a, "v": v}).eval().to_numpy(), 2 * A + [1, 2, 3])
    short = a[:3]
    np.testing.assert_array_equal(Expr("a - b", {"a": a, "b": short}).eval().to_numpy(), A[:3] * 0)
    e = Expr("a * 2", {"a": a})
    e.set_inputs_range(1, 5, 2)
    np.testing.assert_array_equal(e.eval().to_numpy(), A[1:5:2] * 2)
    e.set_output(a, append_mode=True)
    np.testing.assert_array_equal(e.eval().to_numpy(), np.concatenate([A, A[1:5:2] * 2]))
    e.set_output(a)
    e.set_output_range(0, 1)
    want = A.copy()
    want[0] = A[1] * 2
    np.testing.assert_array_equal(e.eval().to_numpy(), want)
    t = Table(spark.createDataFrame([(float(k), k) for k in range(4)], "x double, nrow long"))
    np.testing.assert_allclose(Expr("x**2 + w", {"x": t.cols.x, "w": np.arange(4.0)}).eval().to_numpy(), np.arange(4.0) ** 2 + np.arange(4.0))
    with pytest.raises(ValueError):
        Expr("a + b", {"a": a, "b": NdArray.from_numpy(spark, np.zeros(2))}).eval()
    with pytest.raises(TypeError):
        Expr("r + 1", {"r": RaggedArray.from_lists(spark, [[1]])})


def sent(spark):
    """Bytes that tasks have sent to the driver so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).resultSize() for k in range(stages.size()))


def test_iteration_in_tasks_sends_no_rows(spark, tmp_path):
    n = 100_000
    prices = spark.range(n, numPartitions=1).select(F.col("id").alias("o_orderkey"), ((F.col("id") * 7919) % 100_003 / 7 + 0.1).alias("o_totalprice"))
    prices.write.parquet(f"{tmp_path}/orders.parquet")
    want = math.fsum(r[0] / 2 for r in prices.select("o_totalprice").collect())
    before = sent(spark)
    (row,) = QUERIES["expr_iterate"](spark, str(tmp_path)).collect()
    assert row["total"] == want
    assert sent(spark) - before < n


def test_iteration_on_the_driver_sends_values_only(spark):
    n = 20_000
    t = Table(spark.range(n, numPartitions=3).select((F.col("id") / 3).alias("x"), F.col("id").alias("nrow")))
    before = sent(spark)
    assert [float(v) for v in Expr("x * 2", {"x": t.cols.x})] == [k / 3 * 2 for k in range(n)]
    assert sent(spark) - before < 20 * n


def test_iteration_over_blocks(spark):
    wide = np.arange(9000.0).reshape(3, 1500, 2)
    a = NdArray.from_numpy(spark, wide)
    assert [p.tolist() for p in a.iterrows()] == wide.tolist() and [p.tolist() for p in a.iterrows(1, 3, 2)] == wide[1:3:2].tolist()
    long = NdArray.from_numpy(spark, np.arange(5000))
    assert [int(v) for v in long.iterrows(10, None, 3)] == list(range(10, 5000, 3))
    gap = NdArray(a.df.where("i0 != 1 or i1 > 0"), a.shape)
    with pytest.raises(ValueError):
        list(gap.iterrows())
    got = a.map_rows(lambda parts: ((float(p[0, 0]), float(p.sum())) for p in parts), "first double, total double").orderBy("first").collect()
    assert [tuple(r) for r in got] == [(float(p[0, 0]), float(p.sum())) for p in wide]


@pytest.mark.parametrize(
    ("values", "want"),
    [([1e16, 1.0, -1e16, None, 1e-30] * 5000, math.fsum([1e16, 1.0, -1e16, 1e-30] * 5000)), ([0.1] * 30_000, math.fsum([0.1] * 30_000)), ([1e308, -1e308, 5e-324], 5e-324), ([0.0, -0.0], 0.0), ([None, None], None), ([], None)]
    + [([1.0, math.inf], math.inf), ([math.inf, 2.0, -math.inf], math.nan), ([math.nan, None], math.nan)],
)
def test_exact_sum(spark, values, want):
    a = NdArray(spark.createDataFrame(list(enumerate(values)), "i0 long, value double").repartition(3), (len(values),))
    (row,) = exact_sum(a).collect()
    assert row["s"] == want or (want is not None and math.isnan(want) and math.isnan(row["s"]))
