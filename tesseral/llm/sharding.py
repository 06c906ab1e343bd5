"""Shards by proportional stratified interleaving.

Rows are put in a seeded random order within their source; row r of a source of n rows sits at the
fraction (r + 1/2) / n, and all rows in order of their fractions are cut into shards whose counts differ by
one at most (the law ``rows``). So every stretch, and every shard, holds the sources in the proportions of
the whole.

Ranks are found in hashed ranges: rows of one range of one source are numbered in a window, and sums over
the table of ranges (one row per source and about 50,000 rows) give its offset. The same is done along the
fractions. So no source is in one task, however large it is, and texts are reduced to size and checksum
before anything is shuffled.

A null source is a source of its own; null texts have no bytes; null and repeated ids are rows like
others (equal rows are interchangeable). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_RANGE = 50_000
SEED = 17


def _number(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``, the row's number from 0 within keys[:-1] when these are ordered by keys[-1], then order."""
    tally = rows.groupBy(*keys).agg(F.count("*").alias("__llm_c"))
    before = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select(*keys, F.coalesce(F.sum("__llm_c").over(before), F.lit(0)).alias("__llm_o"), F.sum("__llm_c").over(Window.partitionBy(*keys[:-1])).alias("__llm_all"))
    ranked = rows.withColumn("__llm_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(tally, keys).withColumn(out, F.col("__llm_k") - 1 + F.col("__llm_o"))


def stratified_shards(docs: DataFrame, n_shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), source."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    total = docs.count()
    ranges = max(1, -(-total // PER_RANGE))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), docs[source_col].cast("string").alias("source")
    )
    rows = rows.withColumns({"__llm_s": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "__llm_h": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))})
    high = F.conv(F.substring("__llm_h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__llm_r", F.shiftright(high * ranges, 32))
    order = ["__llm_h", "text_crc32", "size", "doc_id"]
    rows = _number(rows, ["__llm_s", "__llm_r"], order, "__llm_rank")
    rows = rows.withColumn("__llm_f", (F.col("__llm_rank") + 0.5) / F.col("__llm_all")).drop("__llm_c", "__llm_o", "__llm_all", "__llm_k", "__llm_r")
    rows = rows.withColumns({"__llm_one": F.lit(0), "__llm_fr": F.floor(F.col("__llm_f") * ranges)})
    rows = _number(rows, ["__llm_one", "__llm_fr"], ["__llm_f", "__llm_s", *order], "__llm_p")
    n = max(total, 1)
    rows = rows.withColumn("shard", F.expr(f"cast(__llm_p * {n_shards}L div {n}L as int)"))
    slot = F.expr(f"__llm_p - (shard * {n}L + {n_shards - 1}L) div {n_shards}L").cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")


def write_shards(docs: DataFrame, shards: DataFrame, to: str, id_col: str = "doc_id") -> None:
    """Writes the rows of docs to ``to``/shard=N in order of slot; doc_id must be unique and not null."""
    placed = docs.join(shards.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(to)
