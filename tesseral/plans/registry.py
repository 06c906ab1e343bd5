"""The queries over the reference data set, through the library's own operators, and their expected SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import Enum
from ..operators import recipes
from ..operators.arrays import NdArray, RaggedArray
from ..operators.expr import Expr, over_blocks
from ..operators.rows import NROW, in_slice
from ..operators.table import Table
from ..sources.filters import quantize
from ..types import Col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_ROWS = "(select *, row_number() over () - 1 as nrow from {})"
_CELLS = "(select vec_id, unnest(range(len(embedding))) as j, unnest(embedding)::double as v from embeddings)"
BENCH = "((l_discount >= lim1) & (l_discount < lim2)) | (((l_quantity > lim3) & (l_quantity < lim4)) & ((l_linenumber + 3.1 * l_quantity + l_tax * l_extendedprice) > lim5))"
BENCH_VARS = {"lim1": 0.02, "lim2": 0.04, "lim3": 10.0, "lim4": 20.0, "lim5": 1000.0}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> Table:
    return Table.from_parquet(spark, f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> NdArray:
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    n, width = df.count(), df.select(F.size("embedding")).first()[0]
    return NdArray.from_blocks(df.withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding", (n, width), 0)


@query(f"select o_orderkey, nrow from {_ROWS.format('orders')} where nrow>=100 and nrow<1000 and (nrow-100)%7=0")
def scan_range(spark, sf):
    return table(spark, sf, "orders").rows(100, 1000, 7).select("o_orderkey", NROW)


@query(f"select (900-nrow)//3 as pos, o_orderkey from {_ROWS.format('orders')} where nrow<=900 and nrow>100 and (900-nrow)%3=0")
def scan_reverse(spark, sf):
    rows = table(spark, sf, "orders").rows(900, 100, -3)
    return rows.select(F.expr("(900 - nrow) div 3").alias("pos"), "o_orderkey")


@query("select o_totalprice from orders")
def read_field(spark, sf):
    return table(spark, sf, "orders").rows().select("o_totalprice")


@query(f"with n as {_ROWS.format('orders')}, c(pos,k) as (values (0,5),(1,5),(2,-1),(3,99)) select pos::bigint as pos, o_orderkey from c join n on n.nrow = case when k<0 then k+(select count(*) from orders) else k end")
def read_coordinates(spark, sf):
    return table(spark, sf, "orders").read_coordinates([5, 5, -1, 99], "o_orderkey")


@query(f"select o_orderkey from {_ROWS.format('orders')} where nrow%2=0")
def bool_mask(spark, sf):
    return table(spark, sf, "orders").mask(F.col(NROW) % 2 == 0).select("o_orderkey")


@query("select o_custkey, o_totalprice, o_orderpriority from orders")
def row_field_slice(spark, sf):
    t = table(spark, sf, "orders")
    return t.rows().select(*t.colnames[1::2])


@query("select l_orderkey, l_quantity from lineitem where l_quantity > 45")
def where_simple(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("select l_orderkey, l_quantity from lineitem where (l_discount>=0.02 and l_discount<0.04) or ((l_quantity>10 and l_quantity<20) and (l_linenumber+3.1*l_quantity+l_tax*l_extendedprice) > 1000)")
def where_bench(spark, sf):
    return table(spark, sf, "lineitem").where(BENCH, BENCH_VARS).select("l_orderkey", "l_quantity")


@query("select o_orderkey from orders where not (o_totalprice > 100000)")
def where_not(spark, sf):
    return table(spark, sf, "orders").where("~(o_totalprice > 100000)").select("o_orderkey")


@query("select o_orderkey from orders where o_custkey <> 7")
def where_ne(spark, sf):
    return table(spark, sf, "orders").where("o_custkey != 7").select("o_orderkey")


@query("select o_orderkey from orders where o_orderpriority >= '3' and o_orderpriority < '5'")
def where_string(spark, sf):
    return table(spark, sf, "orders").where("(o_orderpriority >= b'3') & (o_orderpriority < b'5')").select("o_orderkey")


@query(f"select o_orderkey, nrow from {_ROWS.format('orders')} where nrow>=1 and nrow<(select count(*) from orders)-5 and (nrow-1)%3=0 and o_totalprice<50000")
def where_range_slice(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice < 50000", start=1, stop=-5, step=3).select("o_orderkey", NROW)


@query(f"select o_orderkey from {_ROWS.format('orders')} where nrow=17 and o_totalprice>=0")
def where_start_only(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice >= 0", start=17).select("o_orderkey")


@query("select o_orderkey from (select *, o_orderstatus='F' as is_f from orders) where is_f and o_totalprice>150000")
def where_bool_col(spark, sf):
    t = table(spark, sf, "orders").add_column("is_f", Col("bool"), F.col("o_orderstatus") == "F")
    return t.where("is_f & (o_totalprice > 150000)").select("o_orderkey")


@query("select l_orderkey from lineitem where sin(l_quantity)+cos(l_tax)+tan(l_discount)+asin(l_discount)+acos(l_tax)+atan(l_quantity)+atan2(l_tax,l_quantity) > 4")
def where_trig(spark, sf):
    c = "sin(l_quantity) + cos(l_tax) + tan(l_discount) + arcsin(l_discount) + arccos(l_tax) + arctan(l_quantity) + arctan2(l_tax, l_quantity) > 4"
    return table(spark, sf, "lineitem").where(c).select("l_orderkey")


@query("select l_orderkey from lineitem where sinh(l_discount)+cosh(l_tax)+tanh(l_quantity)+asinh(l_quantity)+acosh(l_quantity)+atanh(l_discount) > 10")
def where_hyper(spark, sf):
    c = "sinh(l_discount) + cosh(l_tax) + tanh(l_quantity) + arcsinh(l_quantity) + arccosh(l_quantity) + arctanh(l_discount) > 10"
    return table(spark, sf, "lineitem").where(c).select("l_orderkey")


@query("select l_orderkey from lineitem where ln(l_quantity)+log10(l_extendedprice)+ln(1+l_discount)+exp(l_tax)+sqrt(l_quantity)+abs(l_discount-0.05) > 16")
def where_log(spark, sf):
    c = "log(l_quantity) + log10(l_extendedprice) + log1p(l_discount) + exp(l_tax) + sqrt(l_quantity) + abs(l_discount - 0.05) > 16"
    return table(spark, sf, "lineitem").where(c).select("l_orderkey")


@query("select l_orderkey from lineitem where (case when l_discount>0.05 then l_quantity else l_tax end) > 20")
def where_func(spark, sf):
    return table(spark, sf, "lineitem").where("where(l_discount > 0.05, l_quantity, l_tax) > 20").select("l_orderkey")


@query("select o_orderkey from orders where o_custkey % 5 = 2 and o_totalprice**2 > 1e10")
def where_mod_pow(spark, sf):
    return table(spark, sf, "orders").where("(o_custkey % 5 == 2) & (o_totalprice**2 > 1e10)").select("o_orderkey")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey // l_linenumber > 1500")
def where_int_div(spark, sf):
    return table(spark, sf, "lineitem").where("l_partkey / l_linenumber > 1500").select("l_orderkey", "l_linenumber")


@query("select event_id from events where epoch(ts) >= 1704153600.0 and epoch(ts) < 1704240000.0")
def where_time64(spark, sf):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    t = table(spark, sf, "events").add_column("t64", Col("time64"), seconds)
    return t.where("(t64 >= 1704153600.0) & (t64 < 1704240000.0)").select("event_id")


@query("select o_orderkey from (select o_orderkey, {'key':o_custkey,'price':o_totalprice} as info from orders) where info.price > 190000")
def where_nested(spark, sf):
    df = table(spark, sf, "orders").rows().select("o_orderkey", F.struct(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("price")).alias("info"), NROW)
    t = Table(df)
    return t.where("p > 190000", {"p": t.cols.info.price}).select("o_orderkey")


@query("select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as code from orders where (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end) = 2")
def where_enum(spark, sf):
    status = Enum(["F", "O", "P"])
    t = table(spark, sf, "orders").add_column("code", Col("enum", dflt="F", enum=status), status.to_value(F.col("o_orderstatus")))
    return t.where("code == wanted", {"wanted": status["P"]}).select("o_orderkey", "code")


@query("select l_orderkey from lineitem where sqrt(l_quantity*l_quantity + l_linenumber*l_linenumber) > 50")
def where_complex(spark, sf):
    return table(spark, sf, "lineitem").where("abs(complex(l_quantity, l_linenumber)) > 50").select("l_orderkey")


@query(f"select nrow from {_ROWS.format('orders')} where o_totalprice > 180000")
def get_where_list(spark, sf):
    return table(spark, sf, "orders").get_where_list("o_totalprice > 180000")


@query("select o_custkey from orders where o_totalprice > 180000")
def read_where_field(spark, sf):
    return table(spark, sf, "orders").read_where("o_totalprice > 180000", field="o_custkey")


@query(f"select o_orderkey from {_ROWS.format('orders')} where nrow<10 union all select o_orderkey from orders where o_totalprice>190000")
def append_where(spark, sf):
    src = table(spark, sf, "orders")
    dst = src.copy(0, 10)
    src.append_where(dst, "o_totalprice > 190000")
    return dst.rows().select("o_orderkey")


@query("select * from (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey)-1 as pos from orders) where pos>=10 and pos<50")
def read_sorted(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_totalprice.create_csindex()
    return t.read_sorted("o_totalprice", start=10, stop=50).select("o_orderkey", "o_totalprice", "pos")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 20")
def read_sorted_desc(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_totalprice.create_csindex()
    n = t.nrows
    return t.read_sorted("o_totalprice", checkCSI=True, start=n - 1, stop=n - 21, step=-1).select("o_orderkey", "o_totalprice")


@query(f"select nrow, row_number() over (order by o_totalprice, nrow)-1 as pos from {_ROWS.format('orders')}")
def index_argsort(spark, sf):
    t = table(spark, sf, "orders")
    t.cols.o_totalprice.create_csindex()
    return t.cols.o_totalprice.index.read_indices().select(NROW, "pos")


@query("select row_number() over (order by p_retailprice, p_partkey)-1 as nrow, p_partkey, p_retailprice from part")
def copy_sortby(spark, sf):
    t = table(spark, sf, "part")
    t.cols.p_retailprice.create_csindex()
    return t.copy(sortby="p_retailprice", checkCSI=True).rows().select(NROW, "p_partkey", "p_retailprice")


@query("select l_orderkey, .25*l_tax**3 + .75*l_tax**2 - 1.5*l_tax - 2 as y from lineitem")
def expr_poly(spark, sf):
    from ..functions.condition import parse, resolver

    t = table(spark, sf, "lineitem")
    y = parse(".25*x**3 + .75*x**2 - 1.5*x - 2", resolver(t.schema, {"x": t.cols.l_tax}, None, t._as_node)).column
    return t.rows().select("l_orderkey", y.alias("y"))


@query(f"select vec_id, j, 2*v+1 as y from {_CELLS}")
def expr_array(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    blocks = over_blocks(df, "vec_id", "embedding", "2*x + 1")
    return blocks.select("vec_id", F.posexplode("y").alias("j", "y")).select("vec_id", F.col("j").cast("long").alias("j"), "y")


@query(f"with e as {_CELLS} select e.vec_id, e.j, e.v - c.v as y from e join (select j, v from e where vec_id=0) c using (j)")
def expr_broadcast(spark, sf):
    a = embeddings(spark, sf)
    return Expr("a - c", {"a": a, "c": a[0]}).eval().df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("y"))


@query(f"select a.nrow, a.o_totalprice + b.p_retailprice as y from {_ROWS.format('orders')} a join {_ROWS.format('part')} b using (nrow)")
def expr_shortest(spark, sf):
    a, b = table(spark, sf, "orders"), table(spark, sf, "part")
    out = Expr("x + y", {"x": a.cols.o_totalprice, "y": b.cols.p_retailprice}).eval()
    return out.df.select(F.col("i0").alias(NROW), F.col("value").alias("y"))


@query(f"select vec_id-10 as i, j//8 as j, v from {_CELLS} where vec_id>=10 and vec_id<20 and j%8=0")
def array_slice(spark, sf):
    return embeddings(spark, sf)[10:20, ::8].df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query(f"with e as {_CELLS}, c(i,k) as (values (0,5),(1,1),(2,3)) select i::bigint as i, j, v from c join e on e.vec_id=k where j<2")
def array_fancy(spark, sf):
    return embeddings(spark, sf)[[5, 1, 3], :2].df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query("select user_id, list(value order by event_id) as vals from events group by user_id")
def vlarray_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    return RaggedArray.grouped(df, "user_id", "value", "event_id").withColumnRenamed("item", "vals")


@query(f"select vec_id, j, v from {_CELLS} union all select vec_id+(select count(*) from embeddings), j, v from {_CELLS} where vec_id<10")
def earray_append(spark, sf):
    a = embeddings(spark, sf)
    return a.append(a[:10]).df.select(F.col("i0").alias("vec_id"), F.col("i1").alias("j"), F.col("value").alias("v"))


@query("select o_orderkey, case when o_orderstatus='P' then o_totalprice*1.1 else o_totalprice end as o_totalprice from orders")
def update_conditional(spark, sf):
    t = table(spark, sf, "orders")
    t.update_where("o_orderstatus == 'P'", {"o_totalprice": "o_totalprice * 1.1"})
    return t.rows().select("o_orderkey", "o_totalprice")


@query(f"select nrow, case when nrow in (6,9,12) then -1 else o_orderkey end as o_orderkey from {_ROWS.format('orders')}")
def modify_rows(spark, sf):
    t = table(spark, sf, "orders")
    t.modify_columns(6, 13, 3, [[-1, -1, -1]], ["o_orderkey"])
    return t.rows().select(NROW, "o_orderkey")


@query(f"select nrow, case when nrow%2=1 then 0.0::double else p_retailprice end as p_retailprice from {_ROWS.format('part')}")
def modify_column(spark, sf):
    t = table(spark, sf, "part")
    t.modify_column(start=1, step=2, column=0.0, colname="p_retailprice")
    return t.rows().select(NROW, "p_retailprice")


@query(f"select row_number() over (order by nrow)-1 as nrow, o_orderkey from {_ROWS.format('orders')} where not (nrow>=10 and nrow<20)")
def remove_rows(spark, sf):
    t = table(spark, sf, "orders")
    t.remove_rows(10, 20)
    return t.rows().select(NROW, "o_orderkey")


@query(f"select o_orderkey from {_ROWS.format('orders')} where nrow<100")
def truncate_shrink(spark, sf):
    t = table(spark, sf, "orders")
    t.truncate(100)
    return t.rows().select("o_orderkey")


@query("select r_regionkey, r_name from region union all select 0::integer, '' from range(5)")
def truncate_extend(spark, sf):
    t = table(spark, sf, "region")
    t.truncate(t.nrows + 5)
    return t.rows().drop(NROW)


@query("select c_name, o_orderkey from customer join orders on c_custkey=o_custkey where c_acctbal>5000 and o_totalprice>150000")
def join_equi(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").where("o_totalprice > 150000").select("o_custkey", "o_orderkey")
    return recipes.equi_join(c, o, "c_custkey", "o_custkey").select("c_name", "o_orderkey")


@query(f"select a.nrow, a.p_partkey, b.s_suppkey from {_ROWS.format('part')} a join {_ROWS.format('supplier')} b using (nrow) where a.p_size>10")
def join_positional(spark, sf):
    a = table(spark, sf, "part").where("p_size > 10").select(NROW, "p_partkey")
    return recipes.positional_join(a, table(spark, sf, "supplier").rows().select(NROW, "s_suppkey"))


@query(f"select b.s_suppkey from {_ROWS.format('supplier')} b where b.nrow in (select nrow from {_ROWS.format('part')} where p_size>25)")
def semi_coordinates(spark, sf):
    chosen = table(spark, sf, "part").get_where_list("p_size > 25")
    return recipes.semi_by_rows(table(spark, sf, "supplier").rows(), chosen).select("s_suppkey")


@query("select l_returnflag, sum(l_quantity+l_tax) as s from lineitem group by l_returnflag")
def group_sum(spark, sf):
    return recipes.group_sum(table(spark, sf, "lineitem").rows(), "l_returnflag", F.col("l_quantity") + F.col("l_tax"))


@query("select event_type, sum(value) as s from events group by event_type")
def per_key_sum(spark, sf):
    return recipes.group_sum(table(spark, sf, "events").rows(), "event_type", F.col("value"))


@query("select distinct c_mktsegment from customer")
def distinct_keys(spark, sf):
    return recipes.distinct_values(table(spark, sf, "customer").rows(), "c_mktsegment")


@query("select sum(value) as s, count(*) as n from events where user_id=34 and event_type='click'")
def sum_filtered(spark, sf):
    found = table(spark, sf, "events").where("(user_id == 34) & (event_type == b'click')")
    return found.agg(F.sum("value").alias("s"), F.count("*").alias("n"))


@query(f"select vec_id, sqrt(sum(v*v)) as norm from {_CELLS} group by vec_id")
def row_norm(spark, sf):
    return recipes.row_norms(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")


@query("select l_orderkey, round_even(l_extendedprice*16,0)/16 as q from lineitem")
def quantize_lsd(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", quantize(F.col("l_extendedprice"), 1).alias("q"))


@query("select user_id, count(*) as n from events group by user_id")
def vlarray_sizes(spark, sf):
    rows = RaggedArray.grouped(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "value", "event_id")
    return rows.select("user_id", F.size("item").cast("long").alias("n"))


@query("select l_orderkey, l_linenumber from lineitem where list_contains([l_orderkey,l_partkey,l_suppkey,l_linenumber],7)")
def contains_value(spark, sf):
    t = Table(table(spark, sf, "lineitem").rows().select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", NROW))
    return t.mask(t.contains(7)).select("l_orderkey", "l_linenumber")


@query("""select * from (values ('l_linenumber > 3', 'e0', 'l_linenumber gt 3'), ('(l_linenumber > 3) & (l_linenumber < 5)', 'e0', 'l_linenumber gt lt 3 5'), ('~(l_quantity <= 7) & (l_tax > 0)', 'e0', 'l_quantity gt 7'),
('(l_quantity == 3) | ((l_quantity == 4) & (l_linenumber == 5))', '((e0 & e1) | e2)', 'l_quantity eq 4, l_linenumber eq 5, l_quantity eq 3'), ('(l_quantity + 1) > 3', '', '')) t(condition, skeleton, exprs)""")
def index_plan(spark, sf):
    """The planner's answers, for each of some conditions over a table with two indexes."""
    t = table(spark, sf, "lineitem")
    t.cols.l_linenumber.create_index()
    t.cols.l_quantity.create_index()
    conditions = ["l_linenumber > 3", "(l_linenumber > 3) & (l_linenumber < 5)", "~(l_quantity <= 7) & (l_tax > 0)", "(l_quantity == 3) | ((l_quantity == 4) & (l_linenumber == 5))", "(l_quantity + 1) > 3"]
    rows = [(c, p.skeleton, ", ".join(f"{n} {' '.join(o)} {' '.join(map(str, v))}" for n, o, v in p.exprs)) for c, p in ((c, t.index_plan(c, {})) for c in conditions)]
    return spark.createDataFrame(rows, "condition string, skeleton string, exprs string")


def _demo_store(spark, sf):
    import uuid

    from ..operators.rows import scratch
    from ..sources.catalog import open_store

    at = scratch(spark).removeprefix("file://") + f"/store-{uuid.uuid4().hex}"
    s = open_store(spark, at, "w")
    s.create_group("/", "geo", "places")
    for n in ("nation", "region"):
        s.create_table("/geo", n, obj=table(spark, sf, n), title=n)
    s.create_soft_link("/", "lands", "/geo/nation")
    return s


@query("select * from (values ('/', 'group'), ('/geo', 'group'), ('/lands', 'soft'), ('/geo/nation', 'table'), ('/geo/region', 'table')) t(path, kind)")
def walk_nodes(spark, sf):
    return spark.createDataFrame([(n.path, n.kind) for n in _demo_store(spark, sf).walk_nodes("/")], "path string, kind string")


@query(None)
def tree_sizes(spark, sf):
    import io

    from ..cli import tree

    return spark.createDataFrame(tree(_demo_store(spark, sf), "/", io.StringIO()), "path string, kind string, bytes long, percent double")


@query("select * from (values (0, 'move', '/ /geo /lands /parts /geo/nation'), (1, 'remove', '/ /geo /parts /geo/nation'), (2, 'undo', '/ /geo /lands /geo/nation /geo/region'), (3, 'redo', '/ /geo /parts /geo/nation')) t(step, what, nodes)")
def undo_redo_trace(spark, sf):
    s, rows = _demo_store(spark, sf), []
    look = lambda step: rows.append((len(rows), step, " ".join(n.path for n in s.walk_nodes("/"))))
    s.enable_undo()
    s.mark("begin")
    s.move_node("/geo/region", "/", "parts")
    look("move")
    s.remove_node("/lands")
    look("remove")
    s.undo("begin")
    look("undo")
    s.redo()
    look("redo")
    return spark.createDataFrame(rows, "step int, what string, nodes string")


@query("select n::integer as written, n::integer as read, true as same from (select sum(strlen(n_name)) + count(*) - 1 as n from nation)")
def filenode_roundtrip(spark, sf):
    from ..sources.filenode import new_node, open_node

    s = _demo_store(spark, sf)
    text = "\n".join(r["n_name"] for r in table(spark, sf, "nation").iterrows()).encode()
    with new_node(s, "/", "letter") as f:
        f.write(text)
    with open_node(s, "/letter") as f:
        back = f.read()
    return spark.createDataFrame([(len(text), len(back), text == back)], "written int, read int, same boolean")


@query("select o_orderkey, nrow from (select *, row_number() over () - 1 as nrow from orders) where nrow%2=1 and o_totalprice<20000")
def chained_selection(spark, sf):
    """A native condition over rows of an odd number: both reach the scan as one filter."""
    t = table(spark, sf, "orders")
    return Table(t.rows().where(in_slice(1, t.nrows, 2))).where("o_totalprice < 20000").select("o_orderkey", NROW)


from . import methods  # noqa: E402, F401 - adds its queries
