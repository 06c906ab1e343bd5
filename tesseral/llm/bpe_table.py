"""BPE encoding and decoding through a table of distinct words.

Spark's tasks split texts into words and ask, block by block, for the ids of their distinct words;
each word goes to the partition that owns its hash, where it is encoded once however many blocks ask;
the ids come back and are joined by position. Decoding looks every id up in the id-to-piece table,
whose size is that of the vocabulary.

Nulls are empty texts; ids may be null or repeat (one row out per row in); very long texts are split
like others, and a word of any length is one question; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import blocks, bpe

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _words(block: blocks.Block, path: str) -> tuple[list[list], dict[str, int]]:
    """Per document its words (special strings as ints), and the distinct ones in order of appearance."""
    v = bpe.vocabulary(path)
    seen: dict[str, int] = {}
    rows = []
    for t in block.texts:
        row: list = []
        for k, part in enumerate(v.parts(t.decode())):
            if k % 2:
                row.append((v.special[part], ()))
                continue
            row += bpe.cuts(part)
        rows.append(row)
        for head, words in row:
            if isinstance(head, str):
                seen.update(dict.fromkeys(words))
                if head:
                    seen["\n" + head] = None
    return rows, seen


def _by_bucket(seen, buckets: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    crc = zlib.crc32
    for w in seen:
        out.setdefault(crc(w.encode()) % buckets, []).append(w)
    return out



def _pack(words: list[str]) -> bytes:
    """Words begin a text (marked by a line feed, which no other word begins with) or follow a space."""
    data = [w.encode() for w in words]
    return _squeeze(np.array([len(data), *map(len, data)], "<u4").tobytes() + b"".join(data))


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _unpack(data: bytes) -> list[bytes]:
    data = _expand(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    end = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64).tolist()
    body, at, out = data[4 + 4 * n :], 0, []
    for e in end:
        out.append(body[at:e])
        at = e
    return out


def ask(block: blocks.Block, buckets: int, path: str) -> dict[int, bytes]:
    _, seen = _words(block, path)
    return {b: _pack(sorted(w)) for b, w in _by_bucket(seen, buckets).items()}


def answer(questions: list[bytes], path: str) -> list[bytes]:
    """The ids of each question's words: counts, then ids, as unsigned 32-bit integers."""
    v, table, out = bpe.vocabulary(path), {}, []
    for q in questions:
        ids = []
        for w in _unpack(q):
            got = table.get(w)
            if got is None:
                text = w.decode()
                got = table[w] = np.array(v.word_ids(text[1:] if text[:1] == "\n" else " " + text), "<u4").tobytes()
            ids.append(got)
        out.append(_squeeze(np.array([len(x) // 4 for x in ids], "<u4").tobytes() + b"".join(ids)))
    return out


def _ids_of(words: list[str], data: bytes) -> dict[str, bytes]:
    n, data = len(words), _expand(data)
    end = (4 * np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64)).tolist()
    body, at, out = data[4 * n :], 0, {}
    for w, e in zip(words, end):
        out[w] = body[at:e]
        at = e
    return out


def encoded(block: blocks.Block, got: dict[tuple[int, int], bytes], path: str) -> list[bytes]:
    """Packed ids of each document of a block."""
    rows, seen = _words(block, path)
    ids: dict[str, bytes] = {}
    for b, words in _by_bucket(seen, _buckets(got)).items():
        ids |= _ids_of(sorted(words), got[0, b])
    out = []
    for row in rows:
        parts = []
        for head, words in row:
            if not isinstance(head, str):
                parts.append(np.array([head], "<u4").tobytes())
                continue
            if head:
                parts.append(ids["\n" + head])
            parts.append(b"".join(map(ids.__getitem__, words)))
        out.append(b"".join(parts))
    return out


def _buckets(got) -> int:
    return int(got["buckets"])


@functools.lru_cache(2)
def id_to_piece(path: str) -> tuple[list[bytes], list[str]]:
    v = bpe.vocabulary(path)
    return [v.pieces.get(i, b"") for i in range(v.size)], [str(i) for i in range(v.size)]


def decode(ids: list[int], path: str) -> bytes:
    pieces, _ = id_to_piece(path)
    return b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace").encode()


def _finish(block: blocks.Block, got: dict, path: str, buckets: int, keep: bool) -> pa.Table:
    _, names = id_to_piece(path)
    n, ids_sha, text_sha, kept, decoded = [], [], [], [], []
    for data in encoded(block, got | {"buckets": buckets}, path):
        ids = np.frombuffer(data, "<u4").tolist()
        text = decode(ids, path)
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
        text_sha.append(hashlib.sha256(text).hexdigest())
        if keep:
            kept.append(ids)
            decoded.append(text.decode())
    cols = {"doc_id": pa.array(block.docs, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
    if keep:
        cols |= {"ids": pa.array(kept, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
    return pa.table(cols)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encodes and decodes every text; keep adds the ids and the decoded text themselves."""
    path = path or bpe.default_path()
    rows = blocks.source(docs, id_col, text_col)
    buckets = blocks.partitions(docs.sparkSession)
    questions = blocks.asked(rows, functools.partial(ask, path=path))
    answers = blocks.answered(questions, functools.partial(answer, path=path))
    finish = functools.partial(_finish, path=path, buckets=buckets, keep=keep)
    return blocks.met(blocks.dumped(rows), [answers], finish, SCHEMA + (", ids array<int>, decoded string" if keep else ""))
