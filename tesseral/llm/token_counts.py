"""Token counts by prefix dynamic programming.

The encoding of a prefix of one BPE piece ends in exactly one token: the one whose pair with the last
token of the shorter prefix the merges leave as it is. So ``count[i] = count[i - len(token)] + 1`` gives
the exact count at every prefix, and ``last[i]`` its final token. Whether a pair stays follows from the
merges alone; nothing is encoded. Pieces are put together to words and texts, whose tables are stored as the
change of the count with each code point (``prefix_tables``). Questions about budgets and truncation, for any number
of limits and cuts, are answered from stored tables (``token_counts``, ``truncations``, ``counts_at``).

Every prefix has the count that it has as a text of its own, but for those that end inside a special string:
they count the string as a whole, so that no cut breaks it. Time is linear in the length of a text, whatever it
consists of: long pieces and long runs of white space as well.

Nulls count as empty texts (0 tokens); null, repeated and clashing ids pass through; a result column
replaces an input column of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator, Sequence
from operator import sub

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import bpe
from .runtime import FORGET, enter, ship, trim

KIND = "<i2"
TABLES = "doc_id long, n_bytes long, n_chars long, n_tokens long, changes binary"
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, prefix_chars long"
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
LONG_PIECE = 128
PAIRS = 500_000
MEMO_WORDS = 250_000


class PrefixCounter:
    def __init__(self, path: str):
        self.vocabulary = v = bpe.Vocabulary(path)
        self.parts_of, self.joined = v.merges()
        self.longest = max(map(len, v.ranks))
        #: every prefix of a token: its id, or -1
        self.trie: dict[bytes, int] = {}
        for b in v.ranks:
            for k in range(1, len(b)):
                self.trie.setdefault(b[:k], -1)
        self.trie |= v.ranks
        self.pairs: dict[int, bool] = {}
        self.held: tuple[bytes, list[int], list[int]] = b"", [0], [0]
        self.known = bpe.Memo(self._changes)
        self.later, self.first = bpe.word_memos(lambda w: self._of(self.piece(w.encode()), w), self.word, MEMO_WORDS)

    def stays(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens as they are, side by side: undoes their merges, latest first, and
        looks for an earlier one across the border."""
        parts, joined, limit = self.parts_of, self.joined, 1 << 62
        while True:
            merged = joined.get(left << 20 | right)
            if merged is not None and merged < limit:
                return False
            if left > right and left in parts:
                limit, left = left, parts[left][1]
            elif right in parts:
                limit, right = right + 1, parts[right][0]
            elif left in parts:
                limit, left = left, parts[left][1]
            else:
                return True

    def piece(self, b: bytes) -> list[int]:
        """Token counts of all prefixes of one pre-tokenized piece, at 0 to len(b) bytes."""
        n = len(b)
        if n > LONG_PIECE:
            return self._long_piece(b)
        count, last, get, known = [0] * (n + 1), [-1] * (n + 1), self.trie.get, self.pairs.get
        for end in range(1, n + 1):
            t = get(b[:end])
            if t is None:
                break
            if t >= 0:
                count[end], last[end] = 1, t
        for start in range(1, n):
            here, done = last[start] << 20, count[start] + 1
            for end in range(start + 1, n + 1):
                t = get(b[start:end])
                if t is None:
                    break
                if t >= 0 and last[end] < 0:
                    ok = known(here | t)
                    if self.pair(here | t) if ok is None else ok:
                        count[end], last[end] = done, t
        return count

    def pair(self, key: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()  # the same dict object: piece() holds its get
        ok = self.pairs[key] = self.stays(key >> 20, key & 0xFFFFF)
        return ok

    def _long_piece(self, b: bytes) -> list[int]:
        """The same in time linear in the length: tokens from a place on are found by bisection, and go from long to short.

        The table of the last long piece is taken up again where the new one begins with it.
        """
        n, longest, get, pairs = len(b), self.longest, self.trie.get, self.pairs
        old, count, last = self.held
        keep = len(old) if old and b.startswith(old) else 0
        count, last = count[: keep + 1] + [0] * (n - keep), last[: keep + 1] + [-1] * (n - keep)
        if not keep:
            last = [-1] * (n + 1)
        known: dict[bytes, list[tuple[int, int]]] = {}
        for start in range(max(0, keep - longest), n):
            low, high = 1, min(longest, n - start)
            while low < high:  # the longest run from here that begins a token
                mid = (low + high + 1) // 2
                if b[start : start + mid] in self.trie:
                    low = mid
                else:
                    high = mid - 1
            run = b[start : start + low]
            if (tokens := known.get(run)) is None:
                tokens = known[run] = [(k, t) for k in range(1, low + 1) if (t := get(run[:k], -1)) >= 0]
            here, done = last[start], count[start] + 1
            for size, t in tokens:
                end = start + size
                if last[end] < 0:
                    if start:
                        ok = pairs.get(key := here << 20 | t)
                        if not (self.pair(key) if ok is None else ok):
                            continue
                    count[end], last[end] = done, t
        self.held = b, count, last
        return count

    def pieces(self, word: str) -> list[str]:
        core = word[1:] if word[:1] == " " else word
        if core.isalpha() and max(core) < bpe.PLAIN_END:
            return [word]
        return _pattern().findall(word)

    @staticmethod
    def _of(count: list[int], text: str) -> bytes:
        """Changes of the count by code point, from counts by byte."""
        if len(count) - 1 != len(text):
            ends, at = [0], 0
            for c in text:
                at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                ends.append(at)
            count = [count[k] for k in ends]
        return array("h", map(sub, count[1:], count)).tobytes()

    def _changes(self, p: str) -> bytes:
        """Of one piece. What is left of a contraction is two pieces."""
        if p in CONTRACTIONS:
            at = [0, *(sum(self.piece(x.encode())[-1] for x in self.pieces(p[:j])) for j in range(1, len(p))), self.piece(p.encode())[-1]]
            return array("h", [y - x for x, y in zip(at, at[1:])]).tobytes()
        return self._of(self.piece(p.encode()), p)

    def word(self, word: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(word)))

    def changes(self, text: str, every: bool = True) -> np.ndarray:
        """Change of the token count with each code point. Without every, only their sum is sure."""
        out = []
        get = self.later.__getitem__
        for k, part in enumerate(self.vocabulary.parts(text)):
            if k % 2:
                out.append(array("h", [1] + [0] * (len(part) - 1)).tobytes())
                continue
            mine = []
            for head, words in bpe.cuts(part):
                if head:
                    mine.append(self.first[head])
                mine.append(b"".join(map(get, words)))
            data = b"".join(mine)
            out.append(self._runs(part, data) if every else data)
        return np.frombuffer(b"".join(out), np.int16)

    def _runs(self, part: str, data: bytes) -> bytes:
        """A prefix that ends in a run of white space has the run so far as one piece; a whole run before a word leaves its last character to that."""
        found = [m for m in _pattern_of_runs().finditer(part)]
        if not found:
            return data
        d = np.frombuffer(data, np.int16).copy()
        for m in found:
            s, e = m.span()
            run = self._changes(m[0]) if e - s > LONG_PIECE else self.known[m[0]]
            was = int(d[s:e].sum())
            d[s:e] = np.frombuffer(run, np.int16)
            d[e] += was - int(d[s:e].sum())
        return d.tobytes()

    def count(self, text: str) -> int:
        return int(self.changes(text, False).sum(dtype=np.int64))

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """(tokens of the text, code points of its longest prefix of at most limit tokens)."""
        d = self.changes(text)
        return int(d.sum(dtype=np.int64)), longest_prefix(d, limit)


def longest_prefix(changes: np.ndarray, limit: int) -> int:
    fits = np.flatnonzero(np.cumsum(changes, dtype=np.int64) <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


@functools.lru_cache(1)
def _pattern():
    import regex

    return regex.compile(bpe.GPT_PATTERN)


@functools.lru_cache(1)
def _pattern_of_runs():
    import regex

    return regex.compile(r"(?<!\s)\s{2,}+(?=\S)")


@functools.lru_cache(1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


FORGET.append(counter.cache_clear)


def _tables(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enter("prefixes")
    c, press = counter(path), zstandard.ZstdCompressor(1).compress
    for b in batches:
        n_bytes, n_chars, n_tokens, changes = [], [], [], []
        for x in b.column(1):
            text = x.as_py() or ""
            d = c.changes(text)
            n_bytes.append(len(text.encode()))
            n_chars.append(len(text))
            n_tokens.append(int(d.sum(dtype=np.int64)))
            changes.append(press(d.astype(KIND).tobytes()))
        yield pa.record_batch([b.column(0), *(pa.array(v, pa.int64()) for v in (n_bytes, n_chars, n_tokens)), pa.array(changes, pa.binary())], ["doc_id", "n_bytes", "n_chars", "n_tokens", "changes"])
    trim()


def stored(data: bytes) -> np.ndarray:
    """The changes of one row of prefix_tables; their running sum is the count of every prefix."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), KIND)


def prefix_tables(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, changes (compressed: by how much each code point changes the count of tokens).

    To be written or checkpointed once, and asked as often as wanted.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(functools.partial(_tables, path=path or bpe.default_path()), TABLES)


def _truncations(batches: Iterator[pa.RecordBatch], limits: list[int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, which, chars = [], [], []
        for d, n, size, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            counts = None
            for limit in limits:
                if n <= limit:
                    fits = size
                else:
                    if counts is None:
                        counts = np.cumsum(stored(x.as_py()), dtype=np.int64)
                    at = np.flatnonzero(counts <= limit)
                    fits = int(at[-1]) + 1 if len(at) else 0
                ids.append(d)
                which.append(limit)
                chars.append(fits)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(which, pa.int64()), pa.array(chars, pa.int64())], ["doc_id", "token_limit", "prefix_chars"])


def truncations(tables: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(doc_id, token_limit, prefix_chars): for each limit the code points of the longest prefix within it, from stored tables."""
    ship(tables.sparkSession)
    return tables.select("doc_id", "n_tokens", "n_chars", "changes").mapInArrow(functools.partial(_truncations, limits=list(limits)), "doc_id long, token_limit long, prefix_chars long")


def _counts_at(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x in b.column(1):
            counts = np.cumsum(stored(x.as_py()), dtype=np.int64)
            out.append(counts[every - 1 :: every].tolist())
        yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "counts"])


def counts_at(tables: DataFrame, every: int = 1) -> DataFrame:
    """(doc_id, counts): tokens of the prefixes of every, 2 every, ... code points, from stored tables."""
    ship(tables.sparkSession)
    return tables.select("doc_id", "changes").mapInArrow(functools.partial(_counts_at, every=every), "doc_id long, counts array<long>")


def _answers(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_tokens = b.column(3).to_pylist()
        prefix = [size if n <= limit else longest_prefix(stored(x.as_py()), limit) for n, size, x in zip(n_tokens, b.column(2).to_pylist(), b.column(4))]
        yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(prefix, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_chars"])


def counts_of(tables: DataFrame, limit: int = 1024) -> DataFrame:
    """token_counts from stored tables."""
    ship(tables.sparkSession)
    return tables.mapInArrow(functools.partial(_answers, limit=limit), COUNTS)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and prefix_chars (code points of the longest prefix within the limit)."""
    return counts_of(prefix_tables(docs, path, id_col, text_col), limit)
