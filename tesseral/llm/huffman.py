"""Token ids on disk: canonical length-limited Huffman code of ids, in independent blocks.

File layout of one part (little-endian):

    magic ``TIDH`` | u32 version | u32 block tokens | u64 tokens | u64 documents | u64 payload bytes
    u64 bit offsets, one per block of tokens
    i64 ids, u8 id-present flags and u64 token counts of its documents, in order
    payload: code words, most significant bit first, four zero bytes after the last

The code is one for all parts: only lengths per id are kept (``code.bin``), canonical order gives the
words. Lengths come from counts over the whole corpus, limited by package-merge so that one table
look-up of ``limit`` bits decodes any id. A block is decoded from its offset without its neighbours, so
a reader fetches and decodes only the blocks of the range it wants, side by side, one table look-up each per step.
Parts are rolled at ROLL ids and read in ranges of about a million, so memory follows neither the corpus nor its partitions.

Parts hold ascending ranges of doc_id (nulls first; rows of equal id and ids in any order). A part is
written under another name and renamed, so a task that runs twice leaves one whole file. Null texts
are empty documents (one end id). An empty table gives no rows.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .runtime import checkpoint, partitions, shared_dir, ship

MAGIC, VERSION, BLOCK = b"TIDH", 1, 512
#: Ids of a part, about: what a task holds of it while writing is some 1.5 bytes each, and the driver's list has a row a part.
ROLL = 1 << 24
HEAD = struct.Struct("<4sIIQQQ")
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Package-merge: optimal code lengths of at most limit bits; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n, levels, merged = len(order), [], weight
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by)
        merged = both[by]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for by in reversed(levels):
        chosen = by[:take]
        lengths[: int((chosen < n).sum())] += 1
        take = 2 * int((chosen >= n).sum())
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by (length, id)."""
    words = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            words[i], last = code, int(lengths[i])
            code += 1
    return words


def encode(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
    """(bit offset of each block, payload)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    total = int(end[-1]) if len(ids) else 0
    out = np.zeros(total // 32 + 3, np.uint32)
    if len(ids):
        shifted = words[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
        cell = at >> 5
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out[cell[first]] |= np.bitwise_or.reduceat((shifted >> np.uint64(32)).astype(np.uint32), first)
        out[cell[first] + 1] |= np.bitwise_or.reduceat(shifted.astype(np.uint32), first)
    return at[::block].astype(np.uint64), out.astype(">u4").tobytes()[: -(-total // 8) + 4]


def decode_table(lengths: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """For every limit bits: id << 8 | length of the word they begin with."""
    out = np.zeros(1 << limit, np.int64)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        low = int(words[i]) << (limit - n)
        out[low : low + (1 << (limit - n))] = int(i) << 8 | n
    return out


def decode(payload: bytes, offsets: np.ndarray, n: int, look: np.ndarray, limit: int, block: int = BLOCK) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(8, np.uint32)])
    wide = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = offsets.astype(np.int64)
    out = np.zeros((len(at), block), np.uint32)
    down, mask, top = 32 - limit, (1 << limit) - 1, len(wide) - 1
    for k in range(block):
        seen = look[(wide[np.minimum(at >> 3, top)] >> (down - (at & 7)).astype(np.uint32)) & mask]
        out[:, k] = seen >> 8
        at += seen & 255
    return out.reshape(-1)[:n]


def open_fs(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url else "file://" + url)


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    enc = bpe.packed_encoder(path, "<u2" if bpe.vocabulary(path).size <= 1 << 16 else "<u4")
    mark = np.array([end], enc_kind(path)).tobytes()
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([enc.encode(x.as_py() or "") + mark for x in b.column(1)], pa.binary())], ["doc_id", "ids"])


def enc_kind(path: str) -> str:
    return "<u2" if bpe.vocabulary(path).size <= 1 << 16 else "<u4"


def _histogram(batches: Iterator[pa.RecordBatch], kind: str, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for b in batches:
        held, n = [], 0
        for x in b.column(0):
            held.append(x.as_py())
            n += len(held[-1])
            if n > 1 << 22:
                total += np.bincount(np.frombuffer(b"".join(held), kind), minlength=size)
                held, n = [], 0
        total += np.bincount(np.frombuffer(b"".join(held), kind), minlength=size)
    ids = np.flatnonzero(total)
    yield pa.record_batch([pa.array(ids), pa.array(total[ids])], ["id", "n"])


class _Part:
    """One file while it is written: documents and whole blocks of ids, encoded as they come."""

    def __init__(self, kind: str, lengths: np.ndarray, words: np.ndarray):
        self.kind, self.lengths, self.words = kind, lengths, words
        self.docs, self.flags, self.sizes, self.offsets, self.payload = [], [], [], [], []
        self.tokens, self.bits, self.held, self.n_held = 0, 0, [], 0

    def add(self, doc: int | None, data: bytes) -> None:
        n = len(data) // np.dtype(self.kind).itemsize
        self.docs.append(doc or 0)
        self.flags.append(doc is not None)
        self.sizes.append(n)
        self.held.append(data)
        self.tokens += n
        self.n_held += n
        if self.n_held >= 1 << 20:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        if cut:
            at, data = encode(ids[:cut], self.lengths, self.words)
            n_bits = int(self.lengths[ids[:cut]].sum(dtype=np.int64))
            self.offsets.append(at + np.uint64(self.bits))
            whole = data[: -(-n_bits // 8)]
            # blocks of separate flushes begin on a byte, so that they can simply be put one after another
            self.payload.append(whole)
            self.bits += 8 * len(whole)
        self.held, self.n_held = [ids[cut:].tobytes()], len(ids) - cut

    def save(self, to: str, name: str) -> None:
        self.flush(True)
        body = b"".join(self.payload) + bytes(4)
        at = np.concatenate(self.offsets) if self.offsets else np.zeros(0, np.uint64)
        filesystem, root = open_fs(to)
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        with filesystem.open_output_stream(draft) as f:
            f.write(HEAD.pack(MAGIC, VERSION, BLOCK, self.tokens, len(self.docs), len(body)))
            for a in (at.astype("<u8"), np.array(self.docs, "<i8"), np.array(self.flags, np.uint8), np.array(self.sizes, "<u8")):
                f.write(a.tobytes())
            f.write(body)
        filesystem.move(draft, f"{root}/{name}")


def _write(batches: Iterator[pa.RecordBatch], to: str, kind: str, lengths: np.ndarray, roll: int) -> Iterator[pa.RecordBatch]:
    """Files of some roll ids; a file ends with a document."""
    from pyspark import TaskContext

    words, task = canonical(lengths), TaskContext.get().partitionId()
    done: list[tuple[int, int, int, str]] = []
    part = _Part(kind, lengths, words)

    def close() -> None:
        nonlocal part
        name = f"part-{task:06d}-{len(done):05d}.tidh"
        part.save(to, name)
        done.append((len(done), part.tokens, len(part.docs), name))
        part = _Part(kind, lengths, words)

    for b in batches:
        for d, x in zip(b.column(0).to_pylist(), b.column(1)):
            part.add(d, x.as_py())
            if part.tokens >= roll:
                close()
    if part.docs:
        close()
    cols = list(zip(*done)) or [()] * 4
    yield pa.record_batch([pa.array([task] * len(done), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["task", "part", "tokens", "docs", "name"])


class PartFile:
    """A part opened for reading. Ids are decoded for ranges, from the blocks that hold them and no others."""

    def __init__(self, file: pa.NativeFile, look: np.ndarray, limit: int):
        self.file, self.look, self.limit = file, look, limit
        magic, version, self.block, self.tokens, n_docs, self.n_payload = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id file")
        take = lambda kind, n: np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)
        self.offsets = take("<u8", -(-self.tokens // self.block)).astype(np.int64)
        docs, flags, sizes = take("<i8", n_docs), take(np.uint8, n_docs), take("<u8", n_docs)
        self.docs = [int(d) if f else None for d, f in zip(docs, flags)]
        self.ends = np.cumsum(sizes.astype(np.int64))
        self.body = file.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end of the part."""
        first, last = start // self.block, -(-end // self.block)
        if first >= last:
            return np.zeros(0, np.uint32)
        low = int(self.offsets[first]) >> 3
        high = (int(self.offsets[last]) >> 3) + 8 if last < len(self.offsets) else self.n_payload
        self.file.seek(self.body + low)
        data = self.file.read(min(high, self.n_payload) - low)
        n = min(last * self.block, self.tokens) - first * self.block
        out = decode(data, self.offsets[first:last] - 8 * low, n, self.look, self.limit, self.block)
        return out[start - first * self.block : end - first * self.block]

    def groups(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last but one, their ids) for runs of documents of some most ids."""
        k = 0
        while k < len(self.docs):
            start = int(self.ends[k - 1]) if k else 0
            last = max(k + 1, int(np.searchsorted(self.ends, start + most, "right")))
            yield k, last, self.ids(start, int(self.ends[last - 1]))
            k = last


def _read(batches: Iterator[pa.RecordBatch], to: str, limit: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    filesystem, root = open_fs(to)
    with filesystem.open_input_file(f"{root}/code.bin") as f:
        lengths = np.frombuffer(f.read(), np.uint8)
    look = decode_table(lengths, canonical(lengths), limit)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for b in batches:
        for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with filesystem.open_input_file(f"{root}/{name}") as f:
                part = PartFile(f, look, limit)
                for k, last, ids in part.groups():
                    end = part.ends[k:last]
                    start = np.r_[part.ends[k - 1] if k else 0, end[:-1]]
                    data = [ids[s:e].astype("<u4").tobytes() for s, e in zip((start - start[0]).tolist(), (end - start[0]).tolist())]
                    cols = [pa.array(part.docs[k:last], pa.int64()), pa.array(start + before), pa.array(end - start), pa.array([zlib.crc32(x) for x in data], pa.int64())]
                    yield pa.record_batch([*cols, pa.array(data, pa.binary())] if keep_ids else cols, [*names, "ids"] if keep_ids else names)


def write_ids(docs: DataFrame, to: str, path: str | None = None, end: int = 2, limit: int = 16, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL) -> list[tuple[str, int, int]]:
    """Writes the files; returns (name, tokens, documents) of each part, in order of doc_id."""
    spark = docs.sparkSession
    ship(spark)
    path = path or bpe.default_path()
    kind, size = enc_kind(path), bpe.vocabulary(path).size
    limit = max(limit, int(size - 1).bit_length())
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = checkpoint(rows.mapInArrow(functools.partial(_tokens, path=path, end=end), "doc_id long, ids binary"))
    tally = rows.select("ids").mapInArrow(functools.partial(_histogram, kind=kind, size=size), "id long, n long").groupBy("id").agg(F.sum("n")).collect()
    counts = np.zeros(size, np.int64)
    for i, n in tally:  # as many rows as the vocabulary has ids, at most
        counts[i] = n
    lengths = code_lengths(counts, limit)
    filesystem, root = open_fs(to)
    filesystem.create_dir(root)
    with filesystem.open_output_stream(f"{root}/code.bin") as f:
        f.write(lengths.tobytes())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    done = placed.mapInArrow(functools.partial(_write, to=to, kind=kind, lengths=lengths, roll=roll), "task int, part int, tokens long, docs long, name string").collect()
    return [(r["name"], r["tokens"], r["docs"]) for r in sorted(done, key=lambda r: (r["task"], r["part"]))]


def read_ids(spark, to: str, parts: list[tuple[str, int, int]], limit: int = 16, keep_ids: bool = False) -> DataFrame:
    """Reads the parts back, each with the number of ids before it."""
    ship(spark)
    starts = [int(x) for x in np.cumsum([0, *(t for _, t, _ in parts)])[:-1]]
    rows = spark.createDataFrame([(n, s) for (n, _, _), s in zip(parts, starts)], "name string, start long")
    rows = rows.repartition(max(1, len(parts)), "name") if parts else rows
    return rows.mapInArrow(functools.partial(_read, to=to, limit=limit, keep_ids=keep_ids), RESULT + (", ids binary" if keep_ids else ""))


def huffman_round_trip(docs: DataFrame, to: str | None = None, path: str | None = None, end: int = 2, limit: int = 16) -> DataFrame:
    """Writes all documents' ids below ``to`` (a new folder in the shared one by default) and returns what the files hold."""
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    limit = max(limit, int(bpe.vocabulary(path or bpe.default_path()).size - 1).bit_length())
    return read_ids(spark, to, write_ids(docs, to, path, end, limit), limit)
