"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesseral import Table
from tesseral.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
NAMES = ["where_simple", "where_bench", "read_coordinates", "get_where_list", "read_sorted", "read_sorted_desc", "index_argsort", "copy_sortby", "expr_poly", "expr_array", "append_where", "update_conditional", "modify_rows", "remove_rows", "join_equi", "group_sum", "per_key_sum", "row_norm"]


def timed(run) -> float:
    began = time.time()
    run()
    return time.time() - began


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    times = {}
    for name in NAMES:
        run = lambda: done(registry.QUERIES[name](spark, SF))  # noqa: B023, E731
        run()
        times[name] = round(min(timed(run) for _ in range(2)), 4)
    # a selective range over a sorted and an unsorted copy: row groups are skipped in the first
    t = Table.from_parquet(spark, f"{SF}/lineitem.parquet")
    t.cols.l_extendedprice.create_csindex()
    to = tempfile.mkdtemp()
    for name, df in (("sorted", t.copy(sortby="l_extendedprice").rows().orderBy("nrow")), ("unsorted", t.rows())):
        df.write.option("parquet.block.size", 1 << 20).mode("overwrite").parquet(f"{to}/{name}")
        low = t.rows().agg(F.percentile_approx("l_extendedprice", 0.999)).first()[0]
        run = lambda: done(Table(spark.read.parquet(f"{to}/{name}")).where("l_extendedprice > low", {"low": low}))  # noqa: B023, E731
        run()
        times[f"where_{name}"] = round(min(timed(run) for _ in range(3)), 4)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rsplit("sf", 1)[-1], "rows_per_second": {n: round(rows / times[n]) for n in ("where_simple", "where_bench", "expr_poly")}}))
    spark.stop()


if __name__ == "__main__":
    main()
