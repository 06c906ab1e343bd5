"""Byte-pair encoding, counts, packing and files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesseral.llm import bpe, bpe_table, huffman, packing, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def rows(df, *names):
    return sorted(((*(r[n] for n in names),) for r in df.collect()), key=str)


PARTS = st.sampled_from([*"ab c  \n\t'sldrevtm1 2.!é漢　\x85\x1c ", "<|endoftext|>", "'ll", " the", "ation", "\U0001f600"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=20).map("".join))
def test_words_encode_as_texts_do(text):
    enc = bpe.packed_encoder(bpe.default_path())
    want = Tokenizer.from_file(bpe.default_path()) if not hasattr(test_words_encode_as_texts_do, "t") else test_words_encode_as_texts_do.t
    test_words_encode_as_texts_do.t = want
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_safely(library):
    text = ("word, and\nline " * 50 + "x" * 500 + "  ") * 150
    old, bpe.SEGMENT = bpe.SEGMENT, 1000
    try:
        assert np.frombuffer(bpe.PackedEncoder(bpe.default_path()).encode(text), "<u4").tolist() == ids(library, text)
    finally:
        bpe.SEGMENT = old


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*"ab c  \n\t'sldre1.!é漢", " the", " thereation"]), max_size=14).map("".join))
def test_every_prefix_has_its_exact_count(text):
    c = token_counts.counter(bpe.default_path())
    t = getattr(test_every_prefix_has_its_exact_count, "t", None) or Tokenizer.from_file(bpe.default_path())
    test_every_prefix_has_its_exact_count.t = t
    n = [len(t.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]
    for limit in (0, 1, 3, 6):
        assert c.measure(text, limit) == (n[-1], max(j for j in range(len(n)) if n[j] <= limit))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab c  \n\t'sldre1.!é漢", " the", "    ", "''", "'re", "\U0001f600"]), max_size=14).map("".join))
def test_changes_add_up_to_the_count_of_every_prefix(text):
    c = token_counts.counter(bpe.default_path())
    t = getattr(test_changes_add_up_to_the_count_of_every_prefix, "t", None) or Tokenizer.from_file(bpe.default_path())
    test_changes_add_up_to_the_count_of_every_prefix.t = t
    assert c.changes(text).cumsum().tolist() == [len(t.encode(text[: j + 1], add_special_tokens=False).ids) for j in range(len(text))]


def test_no_cut_breaks_a_special_string():
    c, text = token_counts.counter(bpe.default_path()), "a <|endoftext|> b"
    assert [c.measure(text, k)[1] for k in range(6)] == [0, 1, 2, 15, 17, 17]


@pytest.mark.parametrize("kind", ["spaces", "lines", "quotes", "script", "letters"])
def test_a_megabyte_in_one_word_takes_seconds(kind, library):
    import random
    import time

    n, r = 1_000_000, random.Random(5)
    make = {
        "spaces": lambda n: " " * n + "x", "lines": lambda n: "\n" * n, "quotes": lambda n: "'" * n, "letters": lambda n: "".join(r.choice("abcdefghij") for _ in range(n)),
        "script": lambda n: "".join(r.choice(["a", "var", "x1", "function(", ")", "{", "}", "=", "'", "12", ";", '"use"']) for _ in range(n // 3)),
    }[kind]
    c = token_counts.PrefixCounter(bpe.default_path())
    short = make(9_000)
    total, fits = c.measure(short, 1024)
    assert total == len(ids(library, short)) and len(ids(library, short[:fits])) <= 1024 < len(ids(library, short[: fits + 1])) + (fits == len(short)) * 1025
    began = time.process_time()
    assert c.measure(make(n), 1024)[0] > 1024
    assert time.process_time() - began < 15


def test_stored_tables_answer_any_limit(spark, docs, corpus, library, empty):
    tables = token_counts.prefix_tables(docs).cache()
    limits = [0, 1, 7, 100, 10**6]
    got = sorted(((*r,) for r in token_counts.truncations(tables, limits).collect()), key=str)
    c = token_counts.counter(bpe.default_path())
    assert got == sorted([(d, k, c.measure(t or "", k)[1]) for d, t, *_ in corpus for k in limits], key=str)
    at = {r[0]: r[1] for r in token_counts.counts_at(tables, 3).collect() if r[0] is not None}
    for d, t, *_ in corpus[:10]:
        assert at[d] == [len(ids(library, t[:j])) for j in range(3, len(t) + 1, 3)]
    assert token_counts.truncations(token_counts.prefix_tables(empty), limits).count() == 0
    tables.unpersist()


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_counts(request, corpus, library, which):
    got = rows(token_counts.token_counts(request.getfixturevalue(which), limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len((t or "").encode()), n := len(ids(library, t)), n > 100) for d, t, *_ in corpus]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_encode_decode(request, corpus, library, which):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = rows(bpe_table.encode_decode(request.getfixturevalue(which)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = [(d, len(i := ids(library, t)), sha(",".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for d, t, *_ in corpus]
    assert got == sorted(want, key=str)


def test_ids_and_texts_themselves(docs, corpus, library):
    got = rows(bpe_table.encode_decode(docs, keep=True), "doc_id", "ids", "decoded")
    assert got == sorted([(d, ids(library, t), t or "") for d, t, *_ in corpus], key=str)


def test_files(docs, corpus, library, empty, tmp_path):
    got = rows(huffman.huffman_round_trip(docs, f"file://{tmp_path}/ids"), "doc_id", "n_tokens", "ids_crc32")
    want = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t, *_ in corpus for i in [ids(library, t) + [2]]]
    assert got == sorted(want, key=str)
    back = huffman.huffman_round_trip(docs, f"file://{tmp_path}/again").orderBy("start").collect()
    at = 0
    for r in back:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in back if r["doc_id"] is not None]
    assert known == sorted(known)
    assert huffman.huffman_round_trip(empty, f"file://{tmp_path}/none").count() == 0


def test_parts_are_rolled_and_read_in_ranges(spark, docs, corpus, library, tmp_path):
    to = f"file://{tmp_path}/rolled"
    parts = huffman.write_ids(docs, to, roll=300)
    assert len(parts) > 10 and sum(n for _, n, _ in parts) == sum(len(ids(library, t)) + 1 for _, t, *_ in corpus)
    got = rows(huffman.read_ids(spark, to, parts, keep_ids=True), "doc_id", "ids")
    assert got == sorted([(d, np.array(ids(library, t) + [2], "<u4").tobytes()) for d, t, *_ in corpus], key=str)
    lengths = np.fromfile(f"{tmp_path}/rolled/code.bin", np.uint8)
    look = huffman.decode_table(lengths, huffman.canonical(lengths), 16)
    name = max(parts, key=lambda p: p[1])[0]
    with huffman.open_fs(f"{to}/{name}")[0].open_input_file(f"{tmp_path}/rolled/{name}") as f:
        part = huffman.PartFile(f, look, 16)
        whole = part.ids(0, part.tokens)
        for s, e in [(0, 1), (511, 513), (512, 1024), (700, part.tokens), (part.tokens - 1, part.tokens), (5, 5)]:
            assert (part.ids(s, e) == whole[s:e]).all()
        assert sum(len(x) for _, _, x in part.groups(1000)) == part.tokens and len(list(part.groups(1000))) > 1


@pytest.mark.parametrize("limit", [9, 12, 16])
@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 20_000])
def test_code_round_trip(n, limit):
    x = (np.random.default_rng(n).zipf(1.4, n) % 500).astype(np.uint32)
    counts = np.bincount(x, minlength=500)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and ((lengths > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -int(k) for k in lengths if k) == 1
    words = huffman.canonical(lengths)
    at, payload = huffman.encode(x, lengths, words)
    assert (huffman.decode(payload, at, n, huffman.decode_table(lengths, words, limit), limit) == x).all()


def test_code_is_optimal_without_a_limit_that_binds():
    import heapq

    counts = np.array([50, 20, 10, 10, 5, 3, 1, 1])
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((huffman.code_lengths(counts, 16) * counts).sum()) == total


def sound(records, capacity, want_tokens):
    """Pieces cover their documents, and sequences are full from 0 without gaps."""
    seqs = {}
    for r in records:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert sum(r["length"] for r in records) == want_tokens
    return len(seqs)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_packing(request, corpus, library, which):
    capacity = 256
    got = packing.best_fit_pack(request.getfixturevalue(which), capacity=capacity).collect()
    tokens = [ids(library, t) + [0] for _, t, *_ in corpus]
    n = sound(got, capacity, sum(map(len, tokens)))
    assert n <= -(-sum(map(len, tokens)) // capacity) + 1
    want = []
    for (d, *_), i in zip(corpus, tokens):
        first = len(i) % capacity or capacity if len(i) > capacity else len(i)
        edges = [0, *range(first, len(i) + 1, capacity)] if len(i) > capacity else [0, len(i)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(i[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan_is_best_fit_decreasing(histogram):
    slots, n = packing.plan(histogram, 40)
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                rooms.append(40 - length)
            else:
                rooms[rooms.index(fit)] = fit - length
    assert n == len(rooms)
    placed = {}
    for length, count in histogram.items():
        own = slots[slots[:, 0] == length]
        for r in range(count):
            s = own[np.searchsorted(own[:, 1], r, "right") - 1]
            k = r - s[1]
            placed.setdefault(int(s[2] + k // s[3]), []).append((int(s[4] + k % s[3] * length), length))
    assert len(placed) == n
    for parts in placed.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 40


def test_empty_tables(empty):
    assert token_counts.token_counts(empty).count() == 0
    assert bpe_table.encode_decode(empty).count() == 0
    assert packing.best_fit_pack(empty).columns[-2:] == ["sequence_id", "offset"] and packing.best_fit_pack(empty).count() == 0
