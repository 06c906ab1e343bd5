"""Queries that go through each public method, one by one, with their expected SQL; registry imports them."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import recipes
from ..operators.arrays import NdArray, RaggedArray
from ..operators.expr import Expr
from ..operators.rows import NROW, scratch
from ..operators.table import Table
from ..streaming import append_stream, windowed_counts
from ..types import Col
from .registry import _CELLS, _ROWS, embeddings, query, table

_N = "select *, row_number() over () - 1 as nrow from"


def small(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# reading


@query(f"select nrow, r_name from ({_N} region) where nrow >= 1 and (nrow - 1) % 2 = 0")
def iterrows(spark, sf):
    return small(spark, [(r[NROW], r["r_name"]) for r in table(spark, sf, "region").iterrows(1, None, 2)], "nrow long, r_name string")


@query("select r_regionkey, r_name from region")
def iterate_table(spark, sf):
    return small(spark, [(r["r_regionkey"], r["r_name"]) for r in table(spark, sf, "region")], "r_regionkey int, r_name string")


@query(f"select i::bigint as i, n_name from (values (0, 7), (1, 2), (2, 7)) t(i, k) join ({_N} nation) n on n.nrow = k")
def itersequence(spark, sf):
    rows = table(spark, sf, "nation").itersequence([7, 2, 7])
    return small(spark, [(i, r["n_name"]) for i, r in enumerate(rows)], "i long, n_name string")


@query(f"select n_nationkey, n_name from ({_N} nation) where nrow >= 3 and nrow < 17 and (nrow - 3) % 5 = 0")
def getitem_slice(spark, sf):
    return table(spark, sf, "nation")[3:17:5].select("n_nationkey", "n_name")


@query(f"select n_nationkey, n_name from ({_N} nation) where nrow in (4, (select count(*) - 2 from nation))")
def getitem_list(spark, sf):
    return table(spark, sf, "nation")[[4, -2]].select("n_nationkey", "n_name")


@query(f"select n_name from ({_N} nation) where nrow = 11")
def getitem_row(spark, sf):
    return small(spark, [(table(spark, sf, "nation")[11]["n_name"],)], "n_name string")


@query(f"select n_name from ({_N} nation) where nrow < 4")
def getitem_mask(spark, sf):
    t = table(spark, sf, "nation")
    return t[[k < 4 for k in range(t.nrows)]].select("n_name")


@query("select s_name from supplier")
def col(spark, sf):
    return table(spark, sf, "supplier").col("s_name")


@query(f"select s_acctbal from ({_N} supplier) where nrow >= 2 and nrow < 9 and (nrow - 2) % 3 = 0")
def column_slice(spark, sf):
    return small(spark, [(x,) for x in table(spark, sf, "supplier").cols.s_acctbal[2:9:3]], "s_acctbal double")


@query("select r_name from region")
def column_iterate(spark, sf):
    return small(spark, [(x,) for x in table(spark, sf, "region").cols.r_name], "r_name string")


@query(f"select n_name, n_regionkey from ({_N} nation) where nrow < 6 and nrow >= 2")
def columns_getitem(spark, sf):
    return table(spark, sf, "nation").cols[2:6].select("n_name", "n_regionkey")


@query(f"select n_name from ({_N} nation) where nrow <= 20 and nrow > 5 and (20 - nrow) % 4 = 0")
def read_backwards(spark, sf):
    return table(spark, sf, "nation").read(20, 5, -4, field="n_name")


@query("select count(*) as n, 2::integer as width, 'r_regionkey r_name' as names from region")
def table_info(spark, sf):
    t = table(spark, sf, "region")
    return small(spark, [(len(t), len(t.colnames), " ".join(t.colnames))], "n long, width int, names string")


@query("select r_name from region")
def to_numpy(spark, sf):
    return small(spark, [(x,) for x in table(spark, sf, "region").to_numpy()["r_name"].tolist()], "r_name string")


@query("select * from (values (0, 'F'), (1, 'O'), (2, 'P')) t(code, status)")
def get_enum(spark, sf):
    from ..enums import Enum

    status = Enum(["F", "O", "P"])
    t = table(spark, sf, "orders").add_column("code", Col("enum", dflt="F", enum=status), status.to_value(F.col("o_orderstatus")))
    e = t.get_enum("code")
    return small(spark, [(e[n], n) for n in ("F", "O", "P")], "code int, status string")


# conditions


@query("select l_orderkey, l_linenumber from lineitem where -l_quantity < -40 and 0.02 < l_discount and l_discount <= 0.05")
def where_unary_minus(spark, sf):
    return table(spark, sf, "lineitem").where("(-l_quantity < -40) & (0.02 < l_discount) & (l_discount <= 0.05)").select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where exp(l_discount) - 1 > 0.07 and floor(l_quantity / 7) = 3 and ceil(l_tax * 10) = 1 and fmod(l_quantity, 4) = 1")
def where_rounding(spark, sf):
    return table(spark, sf, "lineitem").where("(expm1(l_discount) > 0.07) & (floor(l_quantity / 7) == 3) & (ceil(l_tax * 10) == 1) & (fmod(l_quantity, 4) == 1)").select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 30 and l_linenumber > 5 and (l_quantity - l_linenumber) * (l_quantity + l_linenumber) > 900")
def where_complex_parts(spark, sf):
    c = "(real(complex(l_quantity, l_linenumber)) > 30) & (imag(complex(l_quantity, l_linenumber)) > 5) & (real(complex(l_quantity, l_linenumber) * complex(l_quantity, l_linenumber)) > 900)"
    return table(spark, sf, "lineitem").where(c).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where sin(2*l_discount)/(cos(2*l_discount)+cosh(2*l_tax)) > 0.05")
def where_complex_tan(spark, sf):
    return table(spark, sf, "lineitem").where("real(tan(complex(l_discount, l_tax))) > 0.05").select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where atan2(2*l_discount, 1 - l_discount*l_discount - l_tax*l_tax) / 2 > 0.0501 and log10(l_quantity*l_quantity + l_linenumber*l_linenumber) / 2 > 1.5")
def where_complex_inverse(spark, sf):
    c = "(real(arctan(complex(l_discount, l_tax))) > 0.0501) & (real(log10(complex(l_quantity, l_linenumber))) > 1.5)"
    return table(spark, sf, "lineitem").where(c).select("l_orderkey", "l_linenumber")


@query("select c_custkey from customer where c_acctbal > 9000")
def iterwhere(spark, sf):
    return small(spark, [(r["c_custkey"],) for r in table(spark, sf, "customer").iterwhere("c_acctbal > 9000")], "c_custkey long")


@query(f"select nrow from ({_N} customer) where c_acctbal > 9000")
def get_where_list_sorted(spark, sf):
    return table(spark, sf, "customer").get_where_list("c_acctbal > limit", {"limit": 9000.0}, sort=True)


@query("select true as uses, false as other")
def will_query_use_indexing(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_custkey.create_index()
    return small(spark, [(bool(t.will_query_use_indexing("o_custkey > 3")), bool(t.will_query_use_indexing("o_totalprice > 3")))], "uses boolean, other boolean")


# indexes


@query(f"select nrow from ({_N} orders) where o_totalprice >= 50000 and o_totalprice < 60000")
def index_search(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_totalprice.create_csindex()
    return t.cols.o_totalprice.index.search(("ge", "lt"), (50000.0, 60000.0))


@query(f"select nrow // 100 as chunk, count(*) as hits from ({_N} orders) where o_totalprice > 170000 group by 1")
def index_chunkmap(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_totalprice.create_index()
    return t.cols.o_totalprice.index.chunkmap(("gt",), (170000.0,), 100)


@query("select count(*) filter (o_totalprice <= 50000) as start, count(*) filter (o_totalprice < 60000) as stop from orders")
def index_lookup_range(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_totalprice.create_csindex()
    return small(spark, [t.cols.o_totalprice.index.lookup_range(("gt", "lt"), (50000.0, 60000.0))], "start long, stop long")


@query("select o_orderkey from orders where (o_custkey = 7 or o_totalprice > 190000) and o_orderstatus <> 'F'")
def where_indexed(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_custkey.create_index()
    t.cols.o_totalprice.create_csindex()
    return t.where_indexed("((o_custkey == 7) | (o_totalprice > 190000)) & (o_orderstatus != b'F')").select("o_orderkey")


@query(f"select row_number() over (order by o_orderpriority, nrow) - 1 as pos, nrow from ({_N} orders)")
def index_of_strings(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_orderpriority.create_csindex()
    return t.cols.o_orderpriority.index.read_indices()


@query(f"select * from (select row_number() over (order by o_orderpriority, nrow) - 1 as pos, o_orderpriority as value from ({_N} orders)) where pos >= 90 and pos < 400 and (pos - 90) % 3 = 0")
def index_read_sorted(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_orderpriority.create_csindex()
    return t.cols.o_orderpriority.index.read_sorted(90, 400, 3)


@query(f"select * from (select row_number() over (order by k nulls first, nrow) - 1 as pos, o_orderkey, k from (select *, nullif(o_custkey % 7, 0) as k from ({_N} orders))) where pos < 300 and pos >= 40")
def read_sorted_nulls(spark, sf):
    t = table(spark, sf, "orders").add_column("k", Col("int64"), F.nullif(F.col("o_custkey") % 7, F.lit(0)))
    t.cols.k.create_csindex()
    return t.read_sorted("k", start=40, stop=300).select("pos", "o_orderkey", "k")


@query(f"select row_number() over (order by c_mktsegment, nrow) - 1 as nrow, c_custkey, c_mktsegment from ({_N} customer)")
def copy_sortby_string(spark, sf):
    t = table(spark, sf, "customer")
    t.cols.c_mktsegment.create_csindex()
    return t.copy(sortby="c_mktsegment", propindexes=True).rows().select(NROW, "c_custkey", "c_mktsegment")


@query("select n_name from nation order by n_name desc limit 5")
def itersorted(spark, sf):
    t = table(spark, sf, "nation")
    t.cols.n_name.create_csindex()
    return small(spark, [(r["n_name"],) for r in t.itersorted("n_name", start=t.nrows - 1, stop=t.nrows - 6, step=-1)], "n_name string")


@query("select * from (values ('made', true, true, false), ('edited', true, true, true), ('reindexed', true, true, false), ('removed', false, false, false)) t(step, is_indexed, is_csi_kind, dirty)")
def index_lifecycle(spark, sf):
    t, rows = table(spark, sf, "region"), []
    t.autoindex = False
    c = t.cols.r_regionkey

    def look(step):
        i = c.index
        rows.append((step, c.is_indexed, bool(i and i.kind == "full" and i.optlevel == 9), bool(i and i.dirty)))

    c.create_csindex()
    look("made")
    t.modify_column(0, 1, 1, 9, "r_regionkey")
    look("edited")
    t.reindex_dirty()
    look("reindexed")
    c.remove_index()
    look("removed")
    return small(spark, rows, "step string, is_indexed boolean, is_csi_kind boolean, dirty boolean")


# expressions and arrays


@query(f"with e as {_CELLS} select vec_id, j, case when vec_id >= 2 and vec_id < 6 then (select 3*x.v from e x where x.vec_id = e.vec_id - 2 and x.j = e.j) else v end as y from e where vec_id < 10")
def expr_output(spark, sf):
    a = embeddings(spark, sf)
    e = Expr("3*a", {"a": a})
    e.set_output(a)
    e.set_inputs_range(0, 4)
    e.set_output_range(2, 6)
    return e.eval()[:10].df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("y"))


@query(f"select nrow // 3 as i, o_totalprice * 2 as y from ({_N} orders) where nrow < 90 and nrow % 3 = 0")
def expr_inputs_range(spark, sf):
    e = Expr("2*x", {"x": table(spark, sf, "orders").cols.o_totalprice})
    e.set_inputs_range(0, 90, 3)
    return e.eval().df.select(F.col("i0").alias("i"), F.col("value").alias("y"))


@query(f"with e as {_CELLS} select vec_id, j, v from e union all select vec_id + (select count(*) from embeddings), j, v + 1 from e")
def expr_append(spark, sf):
    a = embeddings(spark, sf)
    e = Expr("a + 1", {"a": a})
    e.set_output(a, append_mode=True)
    return e.eval().df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query("select sum(o_totalprice / 2) as total from orders where o_orderkey >= 0")
def expr_iterate(spark, sf):
    return recipes.exact_sum(Expr("x / 2", {"x": table(spark, sf, "orders").cols.o_totalprice}), "total")


@query(f"select vec_id, j, case when vec_id < 5 and j % 4 = 0 then 0.0 else v end as v from {_CELLS} where vec_id < 9")
def array_set(spark, sf):
    return embeddings(spark, sf).set((slice(0, 5), slice(None, None, 4)), 0.0)[:9].df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query(f"with e as {_CELLS} select e.vec_id, e.j, coalesce(b.v, e.v) as v from e left join e b on b.vec_id = e.vec_id - 3 and b.j = e.j and e.vec_id >= 13 and e.vec_id < 16 where e.vec_id < 20")
def array_set_array(spark, sf):
    a = embeddings(spark, sf)
    return a.set(slice(13, 16), a[10:13])[:20].df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query(f"with e as {_CELLS} select pos::bigint as pos, v as value from (values (0, 3, 2), (1, 0, 0), (2, 3, 2)) t(pos, a, b) join e on e.vec_id = a and e.j = b")
def array_read_coords(spark, sf):
    return embeddings(spark, sf).read_coords([(3, 2), (0, 0), (3, 2)])


@query(f"select (vec_id - 5) // 3 as i, j, v from {_CELLS} where vec_id >= 5 and vec_id < 40 and (vec_id - 5) % 3 = 0")
def array_read(spark, sf):
    return embeddings(spark, sf).read(5, 40, 3).df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query(f"select vec_id as i, v from {_CELLS} where j = (select max(len(embedding)) - 1 from embeddings)")
def array_ellipsis(spark, sf):
    return embeddings(spark, sf)[..., -1].df.select(F.col("i0").alias("i"), F.col("value").alias("v"))


@query(f"select j, v from {_CELLS} where vec_id = 4")
def array_iterrows(spark, sf):
    (row,) = embeddings(spark, sf).iterrows(4, 5)
    return small(spark, [(j, float(v)) for j, v in enumerate(row)], "j long, v double")


@query(f"select vec_id, j, v from {_CELLS} where vec_id < 7")
def earray_truncate(spark, sf):
    return embeddings(spark, sf).truncate(7).df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query(f"select vec_id, j, v from {_CELLS} where v > 0.5")
def array_mask(spark, sf):
    return embeddings(spark, sf).mask(F.col("value") > 0.5).select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("v"))


def _ragged(spark, sf):
    rows = RaggedArray.grouped(spark.read.parquet(f"{sf}/events.parquet").where("user_id < 40"), "user_id", "event_id", "event_id")
    t = Table(rows.select(F.col("user_id").alias("u"), "item", F.col("user_id").alias(NROW)))
    from ..operators.rows import renumber

    return RaggedArray(renumber(t.df).select(NROW, "item"))


_RAGGED = "(select row_number() over (order by user_id) - 1 as nrow, items from (select user_id, list(event_id order by event_id) as items from events where user_id < 40 group by user_id))"


@query(f"select nrow, items from {_RAGGED} where nrow >= 1 and nrow < 20 and (nrow - 1) % 2 = 0")
def vlarray_read(spark, sf):
    return _ragged(spark, sf).read(1, 20, 2).select(NROW, F.col("item").alias("items"))


@query(f"select i::bigint as i, items from (values (0, 3), (1, 0), (2, 3)) t(i, k) join {_RAGGED} r on r.nrow = k")
def vlarray_getitem(spark, sf):
    return small(spark, list(enumerate(_ragged(spark, sf)[[3, 0, 3]])), "i long, items array<long>")


@query(f"select nrow, items from {_RAGGED}")
def vlarray_iterrows(spark, sf):
    return small(spark, list(enumerate(_ragged(spark, sf).iterrows())), "nrow long, items array<long>")


@query(f"select nrow, items from {_RAGGED} union all select (select count(*) from {_RAGGED}), [7, 8, 9]")
def vlarray_append(spark, sf):
    r = _ragged(spark, sf)
    r.append([7, 8, 9])
    return r.df.select(NROW, F.col("item").alias("items"))


@query(f"select nrow, case when nrow = 2 then list_transform(items, lambda x: 5::bigint) else items end as items from {_RAGGED}")
def vlarray_setitem(spark, sf):
    r = _ragged(spark, sf)
    r[2] = [5]
    return r.df.select(NROW, F.col("item").alias("items"))


@query(f"select nrow, len(items) * 8 as size from {_RAGGED} where nrow in (0, 4)")
def vlarray_row_size(spark, sf):
    r = _ragged(spark, sf)
    return small(spark, [(k, r.get_row_size(k)) for k in (0, 4)], "nrow long, size long")


@query("select * from (values (0, 'one'), (1, ''), (2, 'drei')) t(i, item)")
def vlarray_pseudo_atoms(spark, sf):
    r = RaggedArray.from_lists(spark, ["one", "", "drei"], kind="vlunicode")
    return small(spark, list(enumerate(r.iterrows())), "i int, item string")


# edits


@query("select r_regionkey, r_name from region union all select 7, 'seven' union all select 8, ''")
def append_records(spark, sf):
    t = table(spark, sf, "region")
    t.append([(7, "seven"), {"r_regionkey": 8}])
    return t.rows().drop(NROW)


@query(f"select nrow, r_regionkey, r_name from ({_N} region) union all select (select count(*) from region), 9, 'nine'")
def row_append(spark, sf):
    t = table(spark, sf, "region")
    t.row["r_regionkey"] = 1  # a record that is never appended
    r = t.row
    r["r_regionkey"], r["r_name"] = 9, "nine"
    r.append()
    t.flush()
    return t.rows().select(NROW, "r_regionkey", "r_name")


@query(f"select nrow, case nrow when 1 then 70 when 3 then 71 else r_regionkey end as r_regionkey, case nrow when 1 then 'a' when 3 then 'b' else r_name end as r_name from ({_N} region)")
def modify_rows_records(spark, sf):
    t = table(spark, sf, "region")
    t.modify_rows(1, 4, 2, [(70, "a"), (71, "b")])
    return t.rows().select(NROW, "r_regionkey", "r_name")


@query(f"select nrow, case nrow when 4 then 'last' when 0 then 'first' else r_name end as r_name from ({_N} region)")
def modify_coordinates(spark, sf):
    t = table(spark, sf, "region")
    t.modify_coordinates([4, 0], [(4, "last"), (0, "first")])
    return t.rows().select(NROW, "r_name")


@query(f"select nrow, case when nrow in (2, 3) then 'same' else r_name end as r_name from ({_N} region)")
def setitem_slice(spark, sf):
    t = table(spark, sf, "region")
    t[2:4] = (5, "same")
    return t.rows().select(NROW, "r_name")


@query(f"select nrow, case when nrow >= 2 and nrow < 50 and nrow % 2 = 0 then 0 else p_size end as p_size from ({_N} part)")
def column_setitem(spark, sf):
    t = table(spark, sf, "part")
    t.cols.p_size[2:50:2] = 0
    return t.rows().select(NROW, "p_size")


@query(f"select row_number() over (order by nrow) - 1 as nrow, n_name from ({_N} nation) where nrow <> 3")
def remove_row(spark, sf):
    t = table(spark, sf, "nation")
    t.remove_row(3)
    return t.rows().select(NROW, "n_name")


@query(f"select row_number() over (order by nrow) - 1 as nrow, o_orderkey from ({_N} orders) where not (nrow >= 10 and nrow < 500 and (nrow - 10) % 7 = 0)")
def remove_rows_step(spark, sf):
    t = table(spark, sf, "orders")
    t.remove_rows(10, 500, 7)
    return t.rows().select(NROW, "o_orderkey")


@query(f"select row_number() over (order by nrow) - 1 as nrow, o_orderkey from ({_N} orders) where not o_totalprice > 100000")
def remove_where(spark, sf):
    t = table(spark, sf, "orders")
    t.remove_where("o_totalprice > 100000")
    return t.rows().select(NROW, "o_orderkey")


@query(f"select (nrow - 5) // 4 as nrow, n_name from ({_N} nation) where nrow >= 5 and nrow < 22 and (nrow - 5) % 4 = 0")
def copy_slice(spark, sf):
    return table(spark, sf, "nation").copy(5, 22, 4).rows().select(NROW, "n_name")


@query(f"select row_number() over (order by nrow desc) - 1 as nrow, n_name from ({_N} nation)")
def copy_reversed(spark, sf):
    return table(spark, sf, "nation").copy(None, None, -1).rows().select(NROW, "n_name")


# what users write beside it


@query("select o_orderkey, rank() over w as r, sum(o_totalprice) over (w rows between unbounded preceding and current row) as running, lag(o_totalprice) over w as before from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def window_functions(spark, sf):
    return recipes.running(table(spark, sf, "orders").rows(), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "r", "running", "before")


@query("select p_size as k from part intersect select s_nationkey from supplier")
def set_intersect(spark, sf):
    return recipes.set_operation("intersect", table(spark, sf, "part").rows().select(F.col("p_size").alias("k")), table(spark, sf, "supplier").rows().select(F.col("s_nationkey").alias("k")))


@query("select p_size as k from part except select s_nationkey from supplier")
def set_except(spark, sf):
    return recipes.set_operation("except", table(spark, sf, "part").rows().select(F.col("p_size").alias("k")), table(spark, sf, "supplier").rows().select(F.col("s_nationkey").alias("k")))


@query("select p_size as k from part union select s_nationkey from supplier")
def set_union(spark, sf):
    return recipes.set_operation("union", table(spark, sf, "part").rows().select(F.col("p_size").alias("k")), table(spark, sf, "supplier").rows().select(F.col("s_nationkey").alias("k")))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def join_anti(spark, sf):
    c, o = table(spark, sf, "customer").rows(), table(spark, sf, "orders").rows()
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 150000")
def join_outer(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 150000").select("o_custkey", "o_orderkey")
    return recipes.equi_join(table(spark, sf, "customer").rows(), o, "c_custkey", "o_custkey", "left").select("c_custkey", "o_orderkey")


@query("select o_orderkey, (select max_by(value, (ts, event_id)) from events e where e.user_id = o.o_custkey and e.ts <= o.o_orderdate) as latest from orders o where o_orderkey < 400")
def join_asof(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey < 400").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return recipes.asof_join(o, e, "ts", ["user_id"], "value", "latest").select("o_orderkey", "latest")


@query("select p_partkey, k as band from part join (values (0, 900.0, 950.0), (1, 950.0, 1010.0), (2, 1005.0, 1100.0)) b(k, low, high) on p_retailprice >= low and p_retailprice < high")
def join_range(spark, sf):
    bands = small(spark, [(0, 900.0, 950.0), (1, 950.0, 1010.0), (2, 1005.0, 1100.0)], "band int, low double, high double")
    return recipes.range_join(table(spark, sf, "part").rows(), bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", "band")


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as s from lineitem group by rollup (l_returnflag, l_linestatus)")
def group_rollup(spark, sf):
    return table(spark, sf, "lineitem").rows().rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def group_cube(spark, sf):
    return table(spark, sf, "lineitem").rows().cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def group_sets(spark, sf):
    return table(spark, sf, "lineitem").rows().groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select p_partkey from part order by p_retailprice desc, p_partkey limit 15")
def sort_without_index(spark, sf):
    return table(spark, sf, "part").rows().orderBy(F.desc("p_retailprice"), "p_partkey").limit(15).select("p_partkey")


@query("select c_custkey from customer c where c_acctbal > (select avg(c_acctbal) from customer d where d.c_nationkey = c.c_nationkey)")
def sql_subquery(spark, sf):
    return recipes.sql(spark, "select c_custkey from {c} c where c_acctbal > (select avg(c_acctbal) from {c} d where d.c_nationkey = c.c_nationkey)", c=table(spark, sf, "customer").rows())


@query("select o_orderkey, o_totalprice * 2 + 1 as y from orders")
def udf_vectorised(spark, sf):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return table(spark, sf, "orders").rows().select("o_orderkey", twice("o_totalprice").alias("y"))


@query("select event_type, max(value) - min(value) as spread from events group by event_type")
def udf_aggregate(spark, sf):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return table(spark, sf, "events").rows().groupBy("event_type").agg(spread("value").alias("spread"))


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, sum(value) as s from events group by all")
def stream_windows(spark, sf):
    """A stream with a watermark, counted in windows as files arrive, and read back."""
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source.write.parquet(f"{base}/in")
    out = windowed_counts(spark, f"{base}/in", source.schema, "ts", "1 hour", "10 minutes", ["event_type"], "value")
    name = f"w{uuid.uuid4().hex}"
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/check").start().awaitTermination()
    return spark.table(name).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", "s")


@query("select event_id, value from events where value > 50")
def stream_where(spark, sf):
    from ..streaming import tail

    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    source.write.parquet(f"{base}/in")
    append_stream(tail(spark, f"{base}/in", source.schema, "value > 50"), f"{base}/out", f"{base}/check").awaitTermination()
    return spark.read.parquet(f"{base}/out")


# stores


def _store(spark):
    from ..sources.catalog import open_store

    return open_store(spark, scratch(spark).removeprefix("file://") + f"/store-{uuid.uuid4().hex}", "w")


@query("select n_name from nation where n_nationkey > 3")
def store_table(spark, sf):
    s = _store(spark)
    s.create_table("/deep/er", "nation", obj=table(spark, sf, "nation"), createparents=True)
    return s.get_node("/deep/er/nation", classname=None).data().where("n_nationkey > 3").select("n_name")


@query("select r_regionkey, r_name from region union all select 77, 'added'")
def store_append_flush(spark, sf):
    s = _store(spark)
    s.create_table("/", "region", obj=table(spark, sf, "region"))
    t = s.get_node("/region").data()
    t.append([(77, "added")])
    t.flush()
    return s.get_node("/region").data().rows().drop(NROW)


@query(f"select vec_id as i0, j as i1, v as value from {_CELLS} where vec_id < 20")
def store_earray(spark, sf):
    s = _store(spark)
    s.create_earray("/", "a", obj=embeddings(spark, sf)[:20])
    return s.get_node("/a").data().df.select("i0", "i1", "value")


@query("select * from (values ('/a', 'group'), ('/a/n', 'table'), ('/c', 'group'), ('/c/n2', 'table'), ('/l', 'soft')) t(path, kind)")
def store_edits(spark, sf):
    s = _store(spark)
    s.create_group("/", "a")
    s.create_group("/", "b")
    s.create_table("/a", "n", obj=table(spark, sf, "region"))
    s.copy_node("/a/n", "/b", "n2")
    s.create_soft_link("/", "l", "/a/n")
    s.rename_node("/b", "c")
    s.create_group("/", "gone")
    s.remove_node("/gone")
    return small(spark, [(n.path, n.kind) for n in s.walk_nodes("/") if n.path != "/"], "path string, kind string")


@query("select * from (values ('title', 'lands'), ('unit', 'm'), ('n', '3')) t(name, value)")
def store_attributes(spark, sf):
    s = _store(spark)
    s.create_group("/", "g")
    a = s.get_node("/g").attrs
    a.unit, a.n, a.gone, a.old = "m", 3, 1, "lands"
    del a.gone
    a.rename("old", "title")
    return small(spark, [(n, str(a[n])) for n in a.names()], "name string, value string")


@query("select r_name from region")
def store_soft_link(spark, sf):
    s = _store(spark)
    s.create_table("/", "region", obj=table(spark, sf, "region"))
    s.create_soft_link("/", "link", "/region")
    return s.get_node("/link")().data().rows().select("r_name")


@query("select * from (values ('/t', true), ('/u', false)) t(path, found)")
def store_list_nodes(spark, sf):
    s = _store(spark)
    s.create_table("/", "t", obj=table(spark, sf, "region"))
    names = {n.path for n in s.list_nodes("/")}
    return small(spark, [(p, p in names and p in s) for p in ("/t", "/u")], "path string, found boolean")
