"""Exact byte-level BPE by words.

A text is cut before every space that is followed by something other than white space. The
pre-tokenizer's pattern always has a boundary there, so pieces never cross such a cut and the ids of
a text are the ids of its words in order. Words repeat, so each worker remembers the ids of the words
it met last (a bounded memo that only saves time).
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np

from .runtime import FORGET

GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_WORDS = 120_000
MEMO_CHARS = 64
SEGMENT = 1 << 20
PLAIN_END = "\u0250"  # letters below are letters in every version of Unicode
SIGNS = ".,;:!?()[]{}<>|/\\\"#$%&*+-=@^_`~"
_LOOSE = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(1)
def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    k = 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + k)] = b
            k += 1
    return out


class Memo(dict):
    """A dict that makes missing values. When full it keeps one older generation, so common keys survive."""

    def __init__(self, make: Callable, cap: int = MEMO_WORDS):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMO_CHARS:
                return value
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def word_memos(plain: Callable[[str], object], other: Callable[[str], object], cap: int = MEMO_WORDS) -> tuple[Memo, Memo]:
    """Memos of values that add up over a word's pieces: for words after a space, and for those that begin a text.

    plain(word) makes the value of letters alone, with their space; other(word) that of any word. Letters
    with signs after them, or lines of such, are put together from their parts: the pre-tokenizer cuts there.
    """
    later: Memo
    first: Memo

    def make(space: str, mine: Callable[[], Memo]) -> Callable:
        def value(word: str):
            if word.isalpha() and max(word) < PLAIN_END:
                return plain(space + word)
            stem = word.rstrip(SIGNS)
            if stem and len(stem) < len(word) and stem.isalpha() and max(stem) < PLAIN_END:
                return mine()[stem] + first[word[len(stem) :]]
            if "\n" in word and (lines := word.split("\n")) == word.split() and len(word) <= 4 * MEMO_CHARS:
                out = mine()[lines[0]]
                for x in lines[1:]:
                    out = out + first["\n"] + first[x]
                return out
            return other(space + word)

        return value

    later = Memo(make(" ", lambda: later), cap)
    first = Memo(make("", lambda: first), cap // 2)
    return later, first


class Vocabulary:
    """A byte-level BPE read from a tokenizer file, with ids equal to the tokenizers library's."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        usable = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        if not usable or pre.get("add_prefix_space") or spec["normalizer"] or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        back = byte_chars()
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {b: i for i, b in self.pieces.items() if i not in self.special.values()}
        joined = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in joined]
        if order != sorted(order):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.ranks = ranks
        self.core = tiktoken.Encoding("words", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        self.size = max(self.pieces) + 1
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merges(self) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
        """The two parts of each merged token, and the token that a pair (left << 20 | right) becomes."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, parts, joined = model["vocab"], {}, {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            parts[ids[a + b]] = ids[a], ids[b]
            joined[ids[a] << 20 | ids[b]] = ids[a + b]
        return parts, joined

    def single(self, piece: bytes) -> list[int]:
        return self.core._core_bpe.encode_single_piece(piece)

    def word_ids(self, word: str) -> list[int]:
        """Ids of one cut part of a text; a plain word is one piece and skips the pattern."""
        core = word[1:] if word[:1] == " " else word
        if core.isalpha() and max(core) < PLAIN_END:
            return self.single(word.encode())
        return self.core.encode_ordinary(word)

    def parts(self, text: str) -> list[str]:
        """Alternately ordinary text and special strings."""
        if self._split is None or not any(s in text for s in self.special):
            return [text]
        return self._split.split(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(self.special[part])
                continue
            for head, words in cuts(part):
                out += self.word_ids(head) if head else []
                for w in words:
                    out += self.word_ids(" " + w)
        return out


def cuts(text: str) -> Iterator[tuple[str, list[str]]]:
    """Bounded runs of (a first word without its space, further words of which the space is left out)."""
    at = 0
    while len(text) - at > SEGMENT and (m := _CUT.search(text, at + SEGMENT)):
        yield _cut(text[at : m.start()])
        at = m.start()
    if at < len(text):
        yield _cut(text[at:] if at else text)


def _cut(text: str) -> tuple[str, list[str]]:
    words = _CUT.split(text) if _LOOSE.search(text) else text.split(" ")
    head = words[0]
    del words[0]
    return head, words


class PackedEncoder:
    """Texts to packed ids (unsigned, little-endian, 32 or 16 bits)."""

    def __init__(self, path: str, kind: str = "<u4", cap: int = MEMO_WORDS):
        self.vocabulary = v = Vocabulary(path)
        code, swap = {"<u4": "I", "<u2": "H"}[kind], sys.byteorder == "big"

        def pack(ids: list[int]) -> bytes:
            a = array(code, ids)
            if swap:
                a.byteswap()
            return a.tobytes()

        self.later, self.first = word_memos(lambda w: pack(v.single(w.encode())), lambda w: pack(v.word_ids(w)), cap)
        self.marks = {s: pack([i]) for s, i in v.special.items()}

    def encode(self, text: str) -> bytes:
        out = []
        get = self.later.__getitem__
        for k, part in enumerate(self.vocabulary.parts(text)):
            if k % 2:
                out.append(self.marks[part])
                continue
            for head, words in cuts(part):
                if head:
                    out.append(self.first[head])
                out.append(b"".join(map(get, words)))
        return out[0] if len(out) == 1 else b"".join(out)


@functools.lru_cache(2)
def packed_encoder(path: str, kind: str = "<u4", cap: int = MEMO_WORDS) -> PackedEncoder:
    return PackedEncoder(path, kind, cap)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


FORGET += [packed_encoder.cache_clear, vocabulary.cache_clear]
