"""Documents in blocks that ask questions of hashed partitions and get the answers back in order.

A block is a few MB of consecutive documents, named by a digest of its rows. Each block sends one packed
row per question bucket; whoever owns the bucket answers with one packed row per block, in the order of
the questions; block and answers meet again by the digest. So the shuffles carry a block's distinct
questions once, in large binary rows, and no row per word or per position.

The name is the content: if lost executors make Spark rebuild blocks from input that comes in another
order, a block without its answers is an error and never a wrong result. Equal blocks get equal answers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import partitions, ship, trim

BLOCK_BYTES = 6 << 20
ASKED = "block binary, bucket int, asked binary"


class Block:
    """doc ids (None where null), texts in UTF-8, and whatever else the rows carry along, in bytes."""

    def __init__(self, docs: list[int | None], texts: list[bytes], extra: list[bytes] | None = None):
        self.docs, self.texts, self.extra = docs, texts, extra or [b""] * len(docs)
        h = hashlib.blake2b(digest_size=16)
        for d, t, e in zip(docs, texts, self.extra):
            h.update(b"%d;%d;%d;%d;" % (d is None, d or 0, len(t), len(e)))
            h.update(t)
            h.update(e)
        self.name = h.digest()

    def dump(self) -> bytes:
        ids = np.array([d or 0 for d in self.docs], "<i8").tobytes()
        none = np.array([d is None for d in self.docs], np.uint8).tobytes()
        sizes = np.array([len(t) for t in self.texts], "<i8").tobytes()
        more = np.array([len(e) for e in self.extra], "<i8").tobytes()
        return zstandard.ZstdCompressor(3).compress(np.array([len(self.docs)], "<i8").tobytes() + ids + none + sizes + more + b"".join(self.texts) + b"".join(self.extra))

    @classmethod
    def load(cls, data: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, none = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
        sizes = np.frombuffer(raw, "<i8", 2 * n, 8 + 9 * n)
        at, parts = 8 + 25 * n, []
        for size in sizes.tolist():
            parts.append(raw[at : at + size])
            at += size
        return cls([None if x else int(d) for d, x in zip(ids, none)], parts[:n], parts[n:])


def packed(rows: pa.StructArray) -> list[bytes]:
    """Each row as an Arrow message, without its schema."""
    batch = pa.RecordBatch.from_struct_array(rows)
    return [batch.slice(k, 1).serialize().to_pybytes() for k in range(len(rows))]


def unpacked(rows: list[bytes], kind: pa.StructType) -> pa.StructArray:
    schema = pa.schema(list(kind))
    batches = [pa.ipc.read_record_batch(pa.py_buffer(x), schema) for x in rows]
    return pa.Table.from_batches(batches, schema).combine_chunks().to_struct_array().combine_chunks().cast(kind)


def blocks_of(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[Block]:
    docs, texts, extra, size = [], [], [], 0
    for b in batches:
        more = packed(b.column(2)) if b.num_columns > 2 else [None] * b.num_rows
        for d, x, y in zip(b.column(0).to_pylist(), b.column(1), more):
            t = x.as_buffer()
            t = t.to_pybytes() if t is not None else b""
            if docs and size + len(t) > most:
                yield Block(docs, texts, extra)
                docs, texts, extra, size = [], [], [], 0
            docs.append(d)
            texts.append(t)
            extra.append(y or b"")
            size += len(t)
    if docs:
        yield Block(docs, texts, extra)


def _dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks_of(batches):
        yield pa.record_batch([pa.array([b.name], pa.binary()), pa.array([b.dump()], pa.binary())], ["block", "data"])
    trim()


def _ask(batches: Iterator[pa.RecordBatch], ask: Callable[[Block, int], dict[int, bytes]], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in blocks_of(batches):
        sent = ask(b, buckets)
        yield pa.record_batch([pa.array([b.name] * len(sent), pa.binary()), pa.array(list(sent), pa.int32()), pa.array(list(sent.values()), pa.binary())], ["block", "bucket", "asked"])
    trim()


def _answer(t: pa.Table, answer: Callable[[list[bytes]], list[bytes]]) -> pa.Table:
    got = answer([x.as_py() for x in t.column("asked")])
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "answer": pa.array(got, pa.binary())})


def source(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Rows for blocks; carry keeps all columns but the text, as Arrow messages of carried()."""
    ship(docs.sparkSession)
    rest = [F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("extra")] if carry else []
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *rest)


def carried(docs: DataFrame, text_col: str) -> StructType:
    """The type of what source() carries."""
    return StructType([f for f in docs.schema.fields if f.name != text_col])


def dumped(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_dump, "block binary, data binary")


def asked(rows: DataFrame, ask: Callable[[Block, int], dict[int, bytes]], buckets: int | None = None) -> DataFrame:
    """(block, bucket, asked): ask(block, buckets) gives the packed questions by bucket, as many as shuffle partitions if not said."""
    return rows.mapInArrow(functools.partial(_ask, ask=ask, buckets=buckets or partitions(rows.sparkSession)), ASKED)


def answered(questions: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, bucket, answer): answer() sees all of one bucket's packed questions and replies to each."""


    def reply(t):  # without hints: Spark reads them to choose how to call it
        return _answer(t, answer)

    return questions.groupBy("bucket").applyInArrow(reply, "block binary, bucket int, answer binary")


def _meet(left: pa.Table, right: pa.Table, finish: Callable) -> pa.Table:
    n = left.num_rows
    if not n:
        raise RuntimeError("answers for a block that is no longer there: the input changed between two reads")
    got: dict[tuple[int, int], bytes] = {}
    for k, b, a in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("answer")):
        got[k, b] = a.as_py()
    out = finish(Block.load(left.column("data")[0].as_py()), got)
    del got
    trim()
    return pa.concat_tables([out] * n)


def met(data: DataFrame, answers: list[DataFrame], finish: Callable[[Block, dict[tuple[int, int], bytes]], pa.Table], schema: str) -> DataFrame:
    """finish(block, {(place of the frame in answers, bucket): answer}) for every block."""
    all_answers = None
    for k, a in enumerate(answers):
        a = a.withColumn("kind", F.lit(k))
        all_answers = a if all_answers is None else all_answers.unionByName(a)

    def meet(left, right):
        return _meet(left, right, finish)

    return data.groupBy("block").cogroup(all_answers.groupBy("block")).applyInArrow(meet, schema)
