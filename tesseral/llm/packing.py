"""Best-fit packing by a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens; only the histogram of piece lengths (at most
``capacity`` rows) goes to the driver, where best-fit decreasing is run over counts: all pieces of one
length are placed at once, always into the open sequences with the least room that still fits. The plan
is a list of slot ranges per length; a piece takes the slot of its rank within its length. Ranks come
from hashed sub-buckets of each length, so that a length held by a third of all rows is ranked in parallel.

Null texts are empty documents (one piece: the end id). Equal rows are packed once each, and which of
them takes which slot is immaterial. An empty table gives an empty result; null ids pass through.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .runtime import checkpoint, enter, ship, trim

PER_BUCKET = 50_000
BATCH_BYTES = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enter("tokens")
    # ids go on through Spark, whose buffers then take the memory that the memo of words would
    enc = bpe.packed_encoder(path, cap=bpe.MEMO_WORDS // 2 if keep_ids else bpe.MEMO_WORDS)
    mark = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def made() -> pa.RecordBatch:
        cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
        return pa.record_batch([*cols, pa.array(ids, pa.binary())] if keep_ids else cols, [*names, "ids"] if keep_ids else names)

    for b in batches:
        doc, piece, start, length, crc, ids, size = [], [], [], [], [], [], 0
        for d, x in zip(b.column(0).to_pylist(), b.column(1)):
            data = enc.encode(x.as_py() or "") + mark
            n = len(data) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for k in range(len(edges) - 1):
                part = data[4 * edges[k] : 4 * edges[k + 1]]
                doc.append(d)
                piece.append(k)
                start.append(edges[k])
                length.append(edges[k + 1] - edges[k])
                crc.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(part)
                    size += len(part)
            if size > BATCH_BYTES:
                yield made()
                doc, piece, start, length, crc, ids, size = [], [], [], [], [], [], 0
        yield made()
    trim()


def pieces(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece. Only documents beyond the capacity are cut; their first piece is the short one."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    f = functools.partial(_pieces, path=path or bpe.default_path(), end=end, capacity=capacity, keep_ids=keep_ids)
    return rows.mapInArrow(f, PIECES + (", ids binary" if keep_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts.

    Returns slot ranges (length, first rank, first sequence, slots per sequence, first offset) in order
    of length and rank, and the number of sequences. Its size depends on the capacity, not on the rows.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    open_rooms: list[int] = []
    segments, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                heapq.heappush(open_rooms, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        if length < 1 or length > capacity:
            raise ValueError(f"a piece of {length} tokens")
        small = []
        while open_rooms and open_rooms[0] < length:
            small.append(heapq.heappop(open_rooms))
        while count:
            if open_rooms:
                left = open_rooms[0]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    heapq.heappop(open_rooms)
            else:
                left, first = capacity, sequences
                n = -(-count // (capacity // length))
                sequences += n
            each = left // length
            full = min(n, count // each)
            segments.append((length, rank, first, each, capacity - left))
            taken = full * each
            rest = min(count - taken, each - 1) if full < n else 0
            put_back = []
            put_back.append((left - each * length, first, full))
            if rest:
                put_back.append((left - rest * length, first + full, 1))
                put_back.append((left, first + full + 1, n - full - 1))
            else:
                put_back.append((left, first + full, n - full))
            rank += taken + rest
            count -= taken + rest
            for r, f, m in put_back:
                if r < length:
                    if n and m and r:
                        if r not in room:
                            room[r] = []
                            small.append(r)
                        room[r].append((f, m))
                else:
                    put(r, f, m)
        for r in small:
            heapq.heappush(open_rooms, r)
    segments.sort()
    return np.array(segments, np.int64).reshape(-1, 5), sequences


def _place(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    enter("places")
    key = slots[:, 0] << 44 | slots[:, 1]
    for b in batches:
        length, rank = b.column(3).to_numpy(), b.column(b.num_columns - 1).to_numpy()
        s = slots[np.searchsorted(key, length << 44 | rank, "right") - 1]
        k = rank - s[:, 1]
        seq, off = s[:, 2] + k // s[:, 3], s[:, 4] + k % s[:, 3] * length
        yield pa.record_batch([*b.columns[:-1], pa.array(seq), pa.array(off)], [*b.schema.names[:-1], "sequence_id", "offset"])


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Places rows of pieces(): adds sequence_id and offset."""
    ship(parts.sparkSession)
    columns, spark = parts.columns, parts.sparkSession
    heavy = "ids" in columns  # rows then get a number, are ranked without their ids, and meet their places by it
    parts = checkpoint(parts.withColumn("__llm_id", F.monotonically_increasing_id()) if heavy else parts)
    light = parts.drop("ids")
    counts = {r[0]: r[1] for r in light.groupBy("length").count().collect()}
    slots, _ = plan(counts, capacity)
    if not counts:
        return parts.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_of = spark.createDataFrame([(n, -(-c // PER_BUCKET)) for n, c in counts.items()], "length long, __llm_n long")
    rows = light.join(F.broadcast(n_of), "length").withColumn("__llm_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "__llm_n"))
    tally = rows.groupBy("length", "__llm_b").agg(F.count("*").alias("__llm_c"))
    before = Window.partitionBy("length").orderBy("__llm_b").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select("length", "__llm_b", F.coalesce(F.sum("__llm_c").over(before), F.lit(0)).alias("__llm_o"))
    inside = Window.partitionBy("length", "__llm_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("__llm_r", F.row_number().over(inside)).join(tally, ["length", "__llm_b"])
    ranked = ranked.select(*light.columns, (F.col("__llm_r") - 1 + F.col("__llm_o")).cast("long").alias("__llm_rank"))
    schema = ", ".join(f"{c} {t}" for c, t in light.dtypes) + ", sequence_id long, offset long"
    placed = ranked.mapInArrow(functools.partial(_place, slots=slots), schema)
    if not heavy:
        return placed
    return parts.join(placed.select("__llm_id", "sequence_id", "offset"), "__llm_id").select(*columns, "sequence_id", "offset")


def best_fit_pack(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, end, capacity, id_col, text_col, keep_ids), capacity)
