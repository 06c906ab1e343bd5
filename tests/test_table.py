import random

import pytest
from pyspark.sql import functions as F

from tesseral import Table, types
from tesseral.types import Record

ROWS = list(range(100, 130))


@pytest.fixture
def t(spark):
    return Table(spark.createDataFrame([(v, float(v % 5), k) for k, v in enumerate(ROWS)], "v long, x double, nrow long").repartition(3))


def values(df, by="nrow", name="v"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize("s", [(None, None, None), (3, 20, 4), (-5, None, None), (20, 3, None), (None, None, 7), (0, 1000, 1)])
def test_slices(t, s):
    assert values(t.rows(*s)) == ROWS[slice(*s)]
    assert [r["v"] for r in t.read(*s).collect()] == ROWS[slice(*s)]


def test_reverse_and_steps(t):
    assert [r["v"] for r in t.iterrows(20, 3, -4)] == ROWS[20:3:-4]
    with pytest.raises(ValueError):
        t.rows(0, 5, 0)
    with pytest.raises(ValueError):
        t.where("v > 0", {}, 5, 1, -1)


def test_coordinates(t):
    got = t.read_coordinates([5, 5, -1, 0], "v").orderBy("pos").collect()
    assert [r["v"] for r in got] == [105, 105, 129, 100]
    with pytest.raises(IndexError):
        t.read_coordinates([30])
    with pytest.raises(IndexError):
        t.read_coordinates([True] * 3)
    assert [r["v"] for r in t[[True] + [False] * 28 + [True]].collect()] == [100, 129]
    assert t[-1]["v"] == 129 and [r["v"] for r in t[2:4].collect()] == [102, 103]
    assert [r["v"] for r in t.itersequence([3, 1])] == [103, 101]
    with pytest.raises(IndexError):
        t[30]


def test_where_ranges(t):
    assert values(t.where("x == 0", {}, 1, -5, 3)) == [v for v in ROWS[1:-5:3] if v % 5 == 0]
    assert values(t.where("v > 0", {}, start=17)) == [117]
    with pytest.raises(IndexError):
        t.where("v > 0", {}, start=30)
    assert t.where("this is not looked at", {}, 5, 5).count() == 0
    assert values(t.get_where_list("x == 1", {}), name="nrow") == [1, 6, 11, 16, 21, 26]
    assert sorted(r["x"] for r in t.read_where("v < 103", {}, field="x").collect()) == [0.0, 1.0, 2.0]


def test_sorted(t):
    with pytest.raises(ValueError):
        t.read_sorted("x")
    t.cols.x.create_index(kind="full", optlevel=3)
    with pytest.raises(ValueError):
        t.read_sorted("x", checkCSI=True)
    order = sorted(range(30), key=lambda k: (ROWS[k] % 5, k))
    for s in [(0, 30, 1), (3, 9, 2), (29, 20, -1)]:
        got = sorted(t.read_sorted("x", start=s[0], stop=s[1], step=s[2]).collect(), key=lambda r: r["pos"] * (1 if s[2] > 0 else -1))
        assert [r["nrow"] for r in got] == order[slice(*s)]
    assert [r["nrow"] for r in t.cols.x.index.read_indices().orderBy("pos").collect()] == order
    c = t.copy(sortby="x", propindexes=True)
    assert values(c.rows()) == [ROWS[k] for k in order] and c.indexedcolpathnames == ["x"]
    assert values(t.copy(2, 20, 3).rows()) == ROWS[2:20:3]


def test_positions_of_many_ties(spark):
    from tesseral.operators.rows import positions

    random.seed(2)
    data = [(random.choice([1.0] * 5 + [random.random() * 9 for _ in range(5)]), k) for k in range(3000)]
    got = positions(spark.createDataFrame(data, "x double, nrow long"), ["x"]).collect()
    assert [r["nrow"] for r in sorted(got, key=lambda r: r["pos"])] == [k for _, k in sorted(data)]


def test_removal(t):
    model = list(ROWS)
    for s in [(10, 20, 1), (0, 19, 3), (-1, None, None), (5, 5, 1)]:
        del model[slice(*s)]
        t.remove_rows(*s)
        assert values(t.rows()) == model and sorted(r["nrow"] for r in t.df.collect()) == list(range(len(model)))
        assert t.nrows == len(model)
    t.remove_where("x == 2", {})
    assert values(t.rows()) == [v for v in model if v % 5 != 2]


def test_edits(t):
    model = [[v, float(v % 5)] for v in ROWS]
    t.modify_rows(6, 13, 3, [(1, 1.0), (2, 2.0), (3, 3.0)])
    for k, v in zip(range(6, 13, 3), (1, 2, 3)):
        model[k] = [v, float(v)]
    t.modify_coordinates([-1, 0], [{"v": 7}, (8, 8.0)])
    model[-1], model[0] = [7, 0.0], [8, 8.0]
    t.modify_column(1, None, 2, column=-1.0, colname="x")
    t.modify_columns(0, 3, None, [[5, 6, 7], F.col("x") * 10], ["v", "x"])
    for k in range(1, 30, 2):
        model[k][1] = -1.0
    for k in range(3):
        model[k] = [5 + k, model[k][1] * 10]
    t.update_where("v > 120", {"x": "v * 2", "v": 0})
    model = [[0, v * 2.0] if v > 120 else [v, x] for v, x in model]
    t[4] = (44, 4.0)
    model[4] = [44, 4.0]
    assert [[r["v"], r["x"]] for r in t.df.orderBy("nrow").collect()] == model
    for bad in (lambda: t.modify_rows(0, 3, None, [(1, 1.0)]), lambda: t.modify_coordinates([1, 2], [(1, 1.0)])):
        with pytest.raises(ValueError):
            bad()


def test_append_and_truncate(spark, t):
    d = Table.from_rows(spark, {"v": types.Int64Col(dflt=-1, pos=0), "x": types.Float64Col(dflt=2.5, pos=1)})
    d.append([(1, 1.0), {"v": 2}])
    r = d.row
    r["x"] = 9.0
    r.append()
    assert d.nrows == 3
    assert t.append_where(d, "v >= 128", {}) == 2 and t.append_where(d, None, None, 0, 2) == 2
    d.truncate(6)
    d.truncate(8)
    assert [(r["v"], r["x"]) for r in d.df.orderBy("nrow").collect()] == [(1, 1.0), (2, 2.5), (-1, 9.0), (128, 3.0), (129, 4.0), (100, 0.0), (-1, 2.5), (-1, 2.5)]
    for bad in ([(1,)], [{"w": 1}], [("a", 1.0)]):
        with pytest.raises(ValueError):
            d.append(bad)


def test_no_global_window_or_python_in_row_plans(t):
    for df in (t.rows(3, 20, 2), t.where("v > 3", {}), Table(t.df).rows()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Python" not in plan


class Inner(Record):
    a = types.Int16Col(dflt=4)
    z = types.Complex128Col(dflt=1 - 1j)


class Outer(Record):
    when = types.Time64Col(pos=1)
    name = types.StringCol(4, dflt=b"ab", pos=0)
    flag = types.BoolCol(dflt=True)
    grid = types.Int32Col(shape=(2, 2), dflt=3)
    inner = Inner


def test_declared_records(spark):
    t = Table.from_rows(spark, Outer, [{"name": b"toolong", "when": 1.23456789}, {"inner": {"a": 7}}])
    assert t.colnames == ["name", "when", "flag", "grid", "inner"]
    first, second = t.df.orderBy("nrow").collect()
    assert bytes(first["name"]) == b"tool" and first["when"] == 1.234568 and first["flag"] and first["grid"] == [[3, 3], [3, 3]]
    assert second["inner"]["a"] == 7 and second["inner"]["z"]["im"] == -1.0
    assert [r["nrow"] for r in t.where("a > 5", {"a": t.cols.inner.a}).collect()] == [1]
    t.modify_column(column=1, colname="inner/a")
    assert list(t.cols.inner.a) == [1, 1]
    with pytest.raises(TypeError):
        t.where("g > 1", {"g": t.cols.inner})
    with pytest.raises(ValueError):
        types.UInt8Col().value(300)


def test_multi_file_numbers(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    t = Table.from_parquet(spark, str(tmp_path / "d"))
    assert sorted(r["nrow"] for r in t.df.collect()) == list(range(30)) and t.nrows == 30


@pytest.mark.parametrize("kind", ["string", "double", "boolean"])
def test_positions_of_any_kind_with_nulls_first(spark, kind):
    import random

    from tesseral.operators.rows import positions

    r = random.Random(3)
    make = {"string": lambda: r.choice(["a", "b", "zz", "é", ""]), "double": lambda: r.choice([1.5, -2.0, 9.0]), "boolean": lambda: r.random() < 0.5}[kind]
    data = [(None if r.random() < 0.1 else make(), k) for k in range(400)]
    df = positions(spark.createDataFrame(data, f"x {kind}, nrow long"), ["x"], pieces=4)
    got = [(x, n) for x, n, _ in sorted(df.collect(), key=lambda t: t["pos"])]
    assert got == sorted(data, key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1]) if kind != "string" else (t[0] is not None, (t[0] or "").encode(), t[1]))


def test_index_is_written_once_and_searched(spark):
    t = Table(spark.createDataFrame([(float(k * 7 % 100) if k % 10 else (None if k % 20 else float("nan")), k) for k in range(200)], "x double, nrow long"))
    t.cols.x.create_csindex()
    index = t.cols.x.index
    assert not index.is_stored
    got = sorted(r[0] for r in index.search(("ge", "lt"), (10.0, 40.0)).collect())
    rows = {r["nrow"]: r["x"] for r in t.df.collect()}
    want = sorted(n for n, x in rows.items() if x is not None and 10 <= x < 40)
    assert got == want and t.cols.x.index.is_stored
    low, high = index.lookup_range(("ge", "lt"), (10.0, 40.0))
    assert high - low == len(want) and sorted(r["nrow"] for r in index.read_indices(low, high).collect()) == want
    first = index.read_sorted(0, 12).orderBy("pos").collect()
    assert [r["value"] for r in first[:10]] == [None] * 10
    assert sorted(r["nrow"] for r in t.where_indexed("(x >= 10) & (x < 40)").collect()) == want
    assert sorted(r["nrow"] for r in t.where_indexed("x > 90").collect()) == sorted(n for n, x in rows.items() if x is not None and x > 90)
    stored = dict(t.orders)
    t.cols.x.index.read_indices().count()
    assert t.orders == stored
    t.modify_column(0, 1, 1, 55.0, "x")
    assert not t.cols.x.index.is_stored and t.where_indexed("x == 55").count() == sum(x == 55 for n, x in rows.items() if n) + 1


def test_coordinates_travel_to_the_table(spark):
    t = Table(spark.range(1000).withColumnRenamed("id", "nrow").withColumn("x", F.col("nrow") * 2))
    plan = t.read_coordinates([5, 5, 1])._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" in plan


def test_range_join(spark):
    from tesseral.operators.recipes import range_join

    left = spark.createDataFrame([(k, k / 3) for k in range(-30, 60)] + [(None, None)], "k int, v double")
    ranges = [("a", -5.0, 2.5), ("b", 2.5, 2.5), ("c", 0.0, 19.0), ("d", None, 3.0), ("e", 5.0, 1.0)]
    got = sorted((r["k"], r["n"]) for r in range_join(left, spark.createDataFrame(ranges, "n string, low double, high double"), "v", "low", "high", 4.0).collect())
    assert got == sorted((k, n) for k in range(-30, 60) for n, a, b in ranges if a is not None and a <= k / 3 < b)
