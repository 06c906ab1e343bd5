"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id. Sorting all
suffixes of a corpus is avoided as a difference cover avoids it: only a sample of suffixes is sorted, such
that equal strings hold sample positions at equal offsets, and any other suffix is placed by the few bytes
before its sample position and that position's rank. The sample here is local to the content (the least
hash of GRAM bytes in each string's window, one position in about 14), so that two occurrences share one
offset at any distance and in any document, where a periodic cover would have to be far denser.

1. Each block of documents asks which of its sample hashes other blocks have too. Strings without such a
   hash occur nowhere else and are done with.
2. For the others it sends the bytes around each sample position (equal ones once, with their least
   document) to the bucket of the sample's hash. One bucket is sorted at a time: ranks of the sampled
   suffixes and of the reversed bytes before them, with the common prefixes of neighbours, name every
   string by (class of its bytes before the sample, class of its rank) and so settle ties of any length
   without comparing strings again; the least document of each name decides. Buckets bound the memory.
3. Blocks turn the answers into removed runs.

Matches never cross documents, and are judged on the input. Documents without an id count as later than
all others; equal ids remove nothing from each other, but lose what smaller ids hold. Null texts are
empty. Texts shorter than LENGTH lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from . import blocks
from .runtime import checkpoint, enter, release

LENGTH, GRAM = 50, 24
WIDE = LENGTH - GRAM + 1
CONTEXT = LENGTH + WIDE - 1
LATE = np.iinfo(np.int64).max
PART, CHUNK = 1 << 17, 1 << 16
#: Buckets a shuffle partition: one bucket is sorted at a time.
BUCKETS = 3
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number; zeros after the end."""
    x = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << np.uint64(8 * step)
    return x[: len(b)]


def _slide(x: np.ndarray, wide: int, least: bool) -> np.ndarray:
    """Least or greatest of each run of ``wide``; len(x) - wide + 1 values."""
    f, span = (np.minimum if least else np.maximum), 1
    while 2 * span <= wide:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (wide - span)], x[wide - span :]) if span < wide else x


def sample(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, strings) of the cover sample of concatenated documents.

    Bit o of strings says that the string which starts WIDE - 1 - o bytes before the position lies in the
    document and has this position as its sample.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    n = len(text)
    if n < LENGTH:
        return none
    e = _eights(text)
    m = n - GRAM + 1
    h = _mix(e[:m])
    for k in range(8, GRAM, 8):
        h = _mix(h + e[k : k + m])
    h |= np.uint64(1)
    least = _slide(h, WIDE, True)
    good = np.zeros(len(least) + 1, np.int32)
    fits = end - start >= LENGTH
    np.add.at(good, start[fits], 1)
    np.add.at(good, end[fits] - LENGTH + 1, -1)
    least[np.cumsum(good[:-1]) == 0] = 0
    padded = np.concatenate([np.zeros(WIDE - 1, np.uint64), least, np.zeros(WIDE - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, WIDE, False) == h)
    bits = np.zeros(len(at), np.uint32)
    mine = h[at]
    for o in range(WIDE):
        bits |= (padded[at + o] == mine).astype(np.uint32) << np.uint32(o)
    return at, mine, bits


class Part(NamedTuple):
    """The sample of some consecutive bytes: place in buffer, hash and strings of each position; documents from ``first`` on begin at ``begin``."""

    first: int
    begin: np.ndarray
    hash: np.ndarray
    bits: np.ndarray
    buffer: np.ndarray
    at: np.ndarray

    def docs(self, rows: np.ndarray) -> np.ndarray:
        return self.first + np.searchsorted(self.begin, self.at[rows], "right") - 1

    def contexts(self, rows: np.ndarray) -> np.ndarray:
        """CONTEXT bytes around the sample positions; zeros outside of the document."""
        return np.lib.stride_tricks.sliding_window_view(self.buffer, CONTEXT)[self.at[rows] - (WIDE - 1)]


class Sampled:
    """The sample of a block, in parts of some PART bytes. Long documents are cut: a part holds the strings that start in it.

    Parts of common blocks are kept, those of blocks with very long texts made again for each use, so that memory
    follows the distinct contexts of a block and not its positions.
    """

    def __init__(self, block: blocks.Block):
        enter("suffix")
        self.block = block
        self.order = np.array([LATE if d is None else d for d in block.docs], np.int64)
        self.kept: list[Part] | None = list(self.make()) if sum(map(len, block.texts)) <= 2 * blocks.BLOCK_BYTES else None

    def parts(self) -> Iterator[Part]:
        return iter(self.kept) if self.kept is not None else self.make()

    def make(self) -> Iterator[Part]:
        texts, k, before, after = self.block.texts, 0, bytes(WIDE - 1), bytes(CONTEXT)
        while k < len(texts):
            if len(texts[k]) > PART:
                whole = np.frombuffer(b"".join([before, texts[k], after]), np.uint8)
                starts = len(texts[k]) - LENGTH + 1
                for s in range(0, starts, PART):
                    e = min(s + PART, starts)
                    buffer = whole[s : e + LENGTH - 1 + WIDE - 1 + CONTEXT]
                    at, h, bits = sample(buffer, np.array([WIDE - 1]), np.array([WIDE - 1 + e - s + LENGTH - 1]))
                    yield Part(k, np.array([WIDE - 1 - s]), h, bits, buffer, at)
                k += 1
                continue
            held, size, pieces = k, 0, []
            while k < len(texts) and (k == held or size + len(texts[k]) <= PART):
                pieces += [before, texts[k], after]
                size += len(texts[k])
                k += 1
            sizes = np.array([len(t) for t in texts[held:k]])
            start = np.cumsum(sizes + WIDE - 1 + CONTEXT) - sizes - CONTEXT
            buffer = np.frombuffer(b"".join(pieces), np.uint8)
            at, h, bits = sample(buffer, start, start + sizes)
            yield Part(held, start, h, bits, buffer, at)

    def distinct(self, buckets: int):
        """Distinct hashes, each one's bucket, and whether it occurs twice here."""
        found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for group in _some(self.parts(), 16):
            each = [np.unique(p.hash, return_counts=True) for p in group]
            every = np.concatenate([found, *(h for h, _ in each)])
            found, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, *(n for _, n in each)]), len(found)).astype(np.int64)
        return found, _bucket(found, buckets), counts > 1

    def shared(self, buckets: int, got: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, and whether each occurs more than once in the corpus."""
        h, bucket, more = self.distinct(buckets)
        for b, at in _cut(bucket):
            more[at] |= np.unpackbits(np.frombuffer(got[0, b], np.uint8), count=len(at)).astype(bool)
        return h, more

    def asking(self, shared: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[Part, np.ndarray, np.ndarray]]:
        """Per part the rows whose hash is shared, and their names: two digests of strings and context."""
        h, more = shared
        for p in self.parts():
            rows = np.flatnonzero(more[np.searchsorted(h, p.hash)]) if len(h) else np.zeros(0, np.int64)
            name = np.zeros((2, len(rows)), np.uint64)
            for lo in range(0, len(rows), CHUNK):
                some = rows[lo : lo + CHUNK]
                wide = np.zeros((len(some), -(-CONTEXT // 8) * 8), np.uint8)
                wide[:, :CONTEXT] = p.contexts(some)
                one, two = p.bits[some].astype(np.uint64), ~p.bits[some].astype(np.uint64)
                for column in wide.view(np.uint64).T:
                    one, two = _mix(one + column), _mix(two ^ column) + _M1
                name[0, lo : lo + CHUNK], name[1, lo : lo + CHUNK] = one, two
            yield p, rows, name

    def questions(self, asking: Iterable) -> Questions:
        """The distinct contexts that are asked for, in order of their names."""
        q = Questions.none()
        for group in _some(iter(asking), 16):
            q = Questions.join([q, *(Questions.of(p, rows, name, self.order) for p, rows, name in group)])
        return q


class Questions(NamedTuple):
    name: np.ndarray
    least: np.ndarray
    hash: np.ndarray
    bits: np.ndarray
    context: np.ndarray

    @classmethod
    def none(cls) -> Questions:
        return cls(np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros((0, CONTEXT), np.uint8))

    @classmethod
    def of(cls, p: Part, rows: np.ndarray, name: np.ndarray, order: np.ndarray) -> Questions:
        first, least = _first(name, order[p.docs(rows)])
        at = rows[first]
        return cls(name[:, first], least, p.hash[at], p.bits[at], p.contexts(at))

    @classmethod
    def join(cls, parts: list[Questions]) -> Questions:
        name, least, h, bits, context = (np.concatenate(x, axis=-1 if k == 0 else 0) for k, x in enumerate(zip(*parts)))
        first, least = _first(name, least)
        return cls(name[:, first], least, h[first], bits[first], context[first])

    def find(self, name: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.name[0], name[0])
        while (other := np.flatnonzero(self.name[1, at] != name[1])).size:  # equal first digests: the next ones
            at[other] += 1
        return at


def _first(name: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct name, in order: one place, and the least value."""
    n = name.shape[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort((name[1], name[0]))
    new = np.flatnonzero(np.r_[True, (name[:, by[1:]] != name[:, by[:-1]]).any(0)])
    return by[new], np.minimum.reduceat(least[by], new)


def _some(items: Iterator, n: int) -> Iterator[list]:
    while group := list(itertools.islice(items, n)):
        yield group


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _cut(bucket: np.ndarray):
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0]) if len(by) else []
    for lo, hi in zip(edges, [*edges[1:], len(by)]):
        yield int(bucket[by[lo]]), by[lo:hi]


def ask_hashes(block: blocks.Block, buckets: int) -> dict[int, bytes]:
    h, bucket, _ = Sampled(block).distinct(buckets)
    return {b: h[at].tobytes() for b, at in _cut(bucket)}


def answer_hashes(asked: list[bytes]) -> list[bytes]:
    """A bit per hash: some other block sent it too."""
    parts = [np.frombuffer(a, np.uint64) for a in asked]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for p in parts:
        k = np.minimum(np.searchsorted(twice, p), max(len(twice) - 1, 0))
        out.append(np.packbits(twice[k] == p if len(twice) else np.zeros(len(p), bool)).tobytes())
    return out


def ask_contexts(block: blocks.Block, got: dict, buckets: int) -> pa.Table:
    s = Sampled(block)
    q = s.questions(s.asking(s.shared(buckets, got)))
    names, sent = [], []
    for b, rows in _cut(_bucket(q.hash, buckets)):
        names.append(b)
        sent.append(zstandard.ZstdCompressor(1).compress(np.array([len(rows)], "<i8").tobytes() + q.least[rows].tobytes() + q.bits[rows].tobytes() + q.context[rows].tobytes()))
    return pa.table({"block": pa.array([block.name] * len(names), pa.binary()), "bucket": pa.array(names, pa.int32()), "asked": pa.array(sent, pa.binary())})


def _ranks(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order, common prefix of each sorted row with the one before) of rows of bytes."""
    n, size = c.shape
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = c
    columns = wide.view(">u8").astype(np.uint64)
    by = np.lexsort(columns.T[::-1])
    near = np.zeros(n, np.int64)
    for lo in range(1, n, 1 << 16):
        a, b = c[by[lo : lo + (1 << 16)]], c[by[lo - 1 : lo - 1 + len(by[lo : lo + (1 << 16)])]]
        differs = a != b
        near[lo : lo + len(a)] = np.where(differs.any(1), differs.argmax(1), size)
    return by, near


def least_documents(c: np.ndarray, bits: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row the strings (bits) that some row with a smaller least document has too."""
    n = len(c)
    by_right, right = _ranks(c[:, WIDE - 1 :])
    by_left, left = _ranks(c[:, WIDE - 2 :: -1])
    out = np.zeros(n, np.uint32)
    name = np.zeros(n, np.int64)
    left_name = np.zeros(n, np.int64)
    for o in range(WIDE):
        before = WIDE - 1 - o  # bytes of the string before its sample position
        name[by_right] = np.cumsum(right < LENGTH - before)
        left_name[by_left] = np.cumsum(left < before) if before else 0
        rows = np.flatnonzero(bits >> np.uint32(o) & np.uint32(1))
        if len(rows) < 2:
            continue
        key = name[rows] << 32 | left_name[rows]
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(key[by]) != 0])
        lowest = np.repeat(np.minimum.reduceat(least[rows][by], start), np.diff(np.r_[start, len(by)]))
        out[rows[by]] |= (lowest < least[rows][by]).astype(np.uint32) << np.uint32(o)
    return out


def answer_contexts(asked: list[bytes]) -> list[bytes]:
    counts, least, bits, contexts = [], [], [], []
    for a in map(zstandard.ZstdDecompressor().decompress, asked):
        n = int(np.frombuffer(a, "<i8", 1)[0])
        counts.append(n)
        least.append(np.frombuffer(a, np.int64, n, 8))
        bits.append(np.frombuffer(a, np.uint32, n, 8 + 8 * n))
        contexts.append(np.frombuffer(a, np.uint8, n * CONTEXT, 8 + 12 * n).reshape(n, CONTEXT))
    found = least_documents(np.concatenate(contexts), np.concatenate(bits), np.concatenate(least))
    return [x.tobytes() for x in np.split(found, np.cumsum(counts)[:-1])]


def removed_runs(block: blocks.Block, got: dict, buckets: int) -> list[np.ndarray]:
    """Per document the removed runs, as rows of (start, end)."""
    s = Sampled(block)
    shared = s.shared(buckets, got)
    asking = s.asking(shared) if s.kept is None else list(s.asking(shared))
    q = s.questions(asking)
    told = np.zeros(len(q.least), np.uint32)
    for b, rows in _cut(_bucket(q.hash, buckets)):
        told[rows] = np.frombuffer(got[1, b], np.uint32)
    found: dict[int, list[np.ndarray]] = {}
    for p, rows, name in s.asking(shared) if s.kept is None else asking:
        if not len(rows):
            continue
        which = q.find(name)
        gone = np.where(s.order[p.docs(rows)] > q.least[which], p.bits[rows] | told[which], told[which])
        mark = np.zeros(len(p.buffer), bool)
        for o in range(WIDE):
            mark[p.at[rows[gone >> np.uint32(o) & np.uint32(1) == 1]] - (WIDE - 1 - o)] = True
        at = np.flatnonzero(mark)
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + LENGTH])  # documents lie farther apart in the buffer
        owner = np.searchsorted(p.begin, at[new], "right") - 1
        for d, start, end in zip(owner.tolist(), at[new].tolist(), (at[np.r_[new[1:], len(at)] - 1] + LENGTH).tolist()):
            found.setdefault(p.first + d, []).append((start - int(p.begin[d]), end - int(p.begin[d])))
    none = np.zeros((0, 2), np.int64)
    out = [none] * len(block.texts)
    for d, runs in found.items():
        joined: list[list[int]] = []
        for start, end in sorted(runs):
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        out[d] = np.array(joined, np.int64)
    return out


def kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    parts, at = [], 0
    for s, e in runs.tolist():
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


def whole_characters(text: bytes, runs: np.ndarray) -> np.ndarray:
    """The runs without the bytes of characters that lie only partly in them."""
    out = []
    for s, e in runs.tolist():
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return np.array(out, np.int64).reshape(-1, 2)


def _report(block: blocks.Block, got: dict, buckets: int) -> pa.Table:
    runs = removed_runs(block, got, buckets)
    kept = [kept_bytes(t, r) for t, r in zip(block.texts, runs)]
    size = [len(t) for t in block.texts]
    return pa.table({
        "doc_id": pa.array(block.docs, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array([n - len(k) for n, k in zip(size, kept)], pa.int64()),
        "n_spans": pa.array([len(r) for r in runs], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    })


def _clean(block: blocks.Block, got: dict, buckets: int, kind: StructType) -> pa.Table:
    runs = removed_runs(block, got, buckets)
    kept = [kept_bytes(t, whole_characters(t, r)).decode() for t, r in zip(block.texts, runs)]
    return pa.table({"extra": blocks.unpacked(block.extra, to_arrow_type(kind)), "text": pa.array(kept, pa.string())})


def _run(rows: DataFrame, finish, schema: str | StructType) -> DataFrame:
    buckets = BUCKETS * blocks.partitions(rows.sparkSession)
    first = checkpoint(blocks.answered(blocks.asked(rows, ask_hashes, buckets), answer_hashes))
    release(rows.sparkSession)
    contexts = blocks.met(blocks.dumped(rows), [first], functools.partial(ask_contexts, buckets=buckets), blocks.ASKED)
    second = checkpoint(blocks.answered(contexts, answer_contexts))
    release(rows.sparkSession)
    return blocks.met(blocks.dumped(rows), [first, second], functools.partial(finish, buckets=buckets), schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _run(blocks.source(docs, id_col, text_col), _report, SCHEMA)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated strings cut out of their texts, at whole characters; n_chars, where present, follows."""
    kind = blocks.carried(docs, text_col)
    kept = _run(blocks.source(docs, id_col, text_col, carry=True), functools.partial(_clean, kind=kind), StructType([StructField("extra", kind), StructField("text", StringType())]))
    columns = [F.col("text").alias(c) if c == text_col else F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"extra.`{c}`").alias(c) for c, t in docs.dtypes]
    return kept.select(*columns)
