"""What the planner says of conditions over an integer ``n`` and a flag ``f``, both indexed, and an ``o`` that is not."""

import pytest

from tesseral import Table

N, F = "n", "f"
GOLDEN = [
    (["n > 0", "(n > 0) & (o > 0)", "(n > 0) & ((~f) | (o > 0))", "(n > 0) & ((o < 3) & (o > 0))"], [(N, ("gt",), (0,))], "e0"),
    (["(n > 0) & (n < 5)", "(n > 0) & (n < 5) & (o > 0)", "(n > 0) & (n < 5) & ((f == True) | (o > 0))"], [(N, ("gt", "lt"), (0, 5))], "e0"),
    (["f == True", "(f == True) & (o > 0)", "((o > 0) & (o < 4)) & (f == True)", "(f == True) & ((o > 0) & (o < 4))"], [(F, ("eq",), (True,))], "e0"),
    (["((n > 0) & (f == True)) & (o > 0)", "((n > 0) & (f == True)) & ((o > 0) & (o < 4))"], [(N, ("gt",), (0,)), (F, ("eq",), (True,))], "(e0 & e1)"),
    (["(n >= 1) & (n < 2) & (f == True)"], [(N, ("ge", "lt"), (1, 2)), (F, ("eq",), (True,))], "(e0 & e1)"),
    (["(n >= 1) & (n < 2) & (n > 0) & (n < 5)"], [(N, ("ge", "lt"), (1, 2)), (N, ("gt",), (0,)), (N, ("lt",), (5,))], "((e0 & e1) & e2)"),
    (["(n >= 1) & (n < 2) & ((n > 0) & (n < 5))", "((n >= 1) & (n < 2)) & ((n > 0) & (n < 5)) & (o > 0)"], [(N, ("ge", "lt"), (1, 2)), (N, ("gt", "lt"), (0, 5))], "(e0 & e1)"),
    (["(o > 0) & ((n > 0) & (n < 5))"], [(N, ("gt", "lt"), (0, 5))], "e0"),
    (["(o > 0) & (n > 0) & (n < 5)", "((o > 0) & (n > 0)) & (n < 5)"], [(N, ("gt",), (0,)), (N, ("lt",), (5,))], "(e0 & e1)"),
    (["(n < 5) & (o > 0) & (f == True)", "(n < 5) & (o > 2) & f", "(n < 5) & (f == True) & (o > 0) & (o < 4)"], [(N, ("lt",), (5,)), (F, ("eq",), (True,))], "(e0 & e1)"),
    (["sin(n) > 0", "(n * 2.4) > 0", "(n + n) > 0", "n**2 > 0"], [], ""),
    (["~f", "~(f)", "~f & (o > 0)"], [(F, ("eq",), (False,))], "e0"),
    (["~(f == True)", "~(f == True) & (o > 0)"], [(F, ("eq",), (False,))], "e0"),
    (["~(n > 0)", "~((n > 0)) & (o > 0)", "~(n > 0) & ((~f) | (o > 0))"], [(N, ("le",), (0,))], "e0"),
    (["(~(n > 0) | ~f)", "(~(n > 0) | ~(f)) & (o > 0)", "(~(n > 0) | ~(f == True)) & ((o > 0) & (o < 4))"], [(N, ("le",), (0,)), (F, ("eq",), (False,))], "(e0 | e1)"),
    (["(~(n > 0) & ~(n < 2))", "(~(n > 0) & ~(n < 2)) & (o > 0)"], [(N, ("le",), (0,)), (N, ("ge",), (2,))], "(e0 & e1)"),
    (["~((n > 0) & (f))", "~((n > 0) & (f)) & (o > 0)"], [], ""),
    (["~((n > 0) & (f)) & ((f == False) & (o < 4))"], [(F, ("eq",), (False,))], "e0"),
    (["((n > 0) & ~(f))", "((n > 0) & ~(f == True)) & ((o > 0) & (o < 4))"], [(N, ("gt",), (0,)), (F, ("eq",), (False,))], "(e0 & e1)"),
    (["(~(n > 0) & (f))", "(~(n > 0) & (f)) & (o > 0)"], [(N, ("le",), (0,)), (F, ("eq",), (True,))], "(e0 & e1)"),
    (["~((n >= 1) & (n < 2)) & ~(f == True)", "~(f == True) & (o > 0)"], [(F, ("eq",), (False,))], "e0"),
    (["n != 1", "f != False", "~(n != 1)", "~(f != False)", "(n != 1) & (o != 2)", "True != f"], [], ""),
    (["f", "True == f", "~(~f)", "~~~~f", "~(~f) & (o != 2)"], [(F, ("eq",), (True,))], "e0"),
    (["f == False", "False == f", "~~~f", "~~(~f) & (o != 2)"], [(F, ("eq",), (False,))], "e0"),
    (["(n == 3) | f | (n == 5)", "(((n == 3) | (f == True)) | (n == 5)) & (o > 0)"], [(N, ("eq",), (3,)), (F, ("eq",), (True,)), (N, ("eq",), (5,))], "((e0 | e1) | e2)"),
    (["((n == 3) | f) & (n == 5)"], [(N, ("eq",), (3,)), (F, ("eq",), (True,)), (N, ("eq",), (5,))], "((e0 | e1) & e2)"),
    (["(n == 3) | ((n == 4) & (n == 5))", "((n == 3) | ((n == 4) & (n == 5))) & (o > 0)"], [(N, ("eq",), (4,)), (N, ("eq",), (5,)), (N, ("eq",), (3,))], "((e0 & e1) | e2)"),
    (["((n == 3) | (n == 4)) & (n == 5)"], [(N, ("eq",), (3,)), (N, ("eq",), (4,)), (N, ("eq",), (5,))], "((e0 | e1) & e2)"),
    (["(o > 0) & ((o < 4) & (f == True))", "(o > 0) & ((f == True) & (o < 5))", "((n > 0) | (o > 0)) & (f == True)"], [(F, ("eq",), (True,))], "e0"),
    (["(n < 5) & (o > 0) & (f == True) | (o < 4)"], [], ""),
    (["5 > n"], [(N, ("lt",), (5,))], "e0"),
    (["~(n == 1)"], [], ""),
    (["((n == 1) & f) | ((n == 2) & ~f)"], [(N, ("eq",), (1,)), (F, ("eq",), (True,)), (N, ("eq",), (2,)), (F, ("eq",), (False,))], "((e0 & e1) | (e2 & e3))"),
]


@pytest.fixture(scope="module")
def t(spark):
    t = Table(spark.createDataFrame([(1, True, 2, 0)], "n int, f boolean, o int, nrow long"))
    t.cols.n.create_index()
    t.cols.f.create_index()
    return t


@pytest.mark.parametrize(("conditions", "exprs", "skeleton"), GOLDEN)
def test_plan(t, conditions, exprs, skeleton):
    for c in conditions:
        p = t.index_plan(c, {})
        assert (p.exprs, p.skeleton) == (exprs, skeleton), c
        assert t.will_query_use_indexing(c, {}) == frozenset(e[0] for e in exprs)


def test_dirty_indexes_are_not_used(t):
    t.indexes["n"].dirty = True
    assert not t.will_query_use_indexing("n > 0", {})
    t.reindex()
    assert t.will_query_use_indexing("n > 0", {}) == {"n"}


def test_eligibility(spark):
    from tesseral import types

    t = Table.from_rows(spark, {"u": types.UInt64Col(), "z": types.Complex128Col(), "v": types.Int32Col(shape=(2,)), "i": types.Int32Col()})
    with pytest.raises(NotImplementedError):
        t.cols.u.create_index()
    for name in ("z", "v"):
        with pytest.raises(TypeError):
            t.cols.column(name).create_index()
    t.cols.i.create_csindex()
    assert t.cols.i.index.is_csi and t.indexedcolpathnames == ["i"]
    with pytest.raises(ValueError):
        t.cols.i.create_index()
    t.cols.i.remove_index()
    assert not t.cols.i.is_indexed
