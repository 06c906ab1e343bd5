"""Near-duplicates, repeated strings, links of vectors: against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tesseral.llm import blocks, components, embed_dedup, simhash, suffix


def brute_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    s = [] if not w else [b" ".join(w)] if len(w) < width else [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, links):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_simhash(request, corpus, which):
    f = [brute_fingerprint(t) for _, t, *_ in corpus]
    g = groups(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    least = {k: min((d for (d, *_), x in zip(corpus, g) if x == k and d is not None), default=None) for k in set(g)}
    want = [(d, f"{x:016x}", least[k], d == least[k] or least[k] is None) for (d, *_), x, k in zip(corpus, f, g)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"], r["kept"]) for r in simhash.simhash_dedup(request.getfixturevalue(which)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_in_chunks():
    text = " ".join(random.Random(1).choice(["aa", "b", "cc", "d"]) + str(k % 97) for k in range(3000))
    old, simhash.CHUNK = simhash.CHUNK, 64
    try:
        assert simhash.fingerprints([text.encode(), b"", b"a b"]) == [brute_fingerprint(text), 0, brute_fingerprint("a b")]
    finally:
        simhash.CHUNK = old


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_are_all_found_once(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base) | {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in base for _ in range(12)} | {r.getrandbits(16) for _ in range(400)} | {0, 1, 3, (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [frozenset((a % (1 << 64), b % (1 << 64))) for a, b in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()]
    fps = sorted(fps)
    want = {frozenset((x, y)) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= radius}
    assert set(got) == want and len(got) == len(want)


def test_pivots_never_discard_a_link():
    r, p = np.random.default_rng(3), simhash.pivots()
    x = r.integers(0, 1 << 64, 500, np.uint64)
    y = x ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    d = lambda v: np.bitwise_count(v[:, None] ^ p).astype(int)
    assert np.abs(d(x) - d(y)).max() <= 2


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def test_representatives(spark, docs, clashing, corpus, empty):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["text"] for r in kept.collect()})
    assert simhash.keep_representatives(clashing).columns == clashing.columns
    assert simhash.keep_representatives(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_similar_documents_leave_one(spark):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(120, 400))]
        texts.append(words)
        for _ in range(k % 4):
            copy = list(words)
            for _ in range(r.randint(1, len(words) // 60)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(copy)
    r.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    kept = {x["doc_id"] for x in simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = [shingles(t) for _, t in rows]
    j = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a in range(len(s)) for b in range(a)}
    near = [p for p, x in j.items() if x >= 0.8]
    assert len(near) > 50 and sum(a in kept and b in kept for a, b in near) <= len(near) // 50
    alone = [k for k in range(len(s)) if max(x for p, x in j.items() if k in p) < 0.5]
    assert len(alone) > 10 and set(alone) <= kept
    # one of every group stays, and of a group of clear copies only the least id
    g = groups(len(s), near)
    for k in set(g):
        assert any(x == k and i in kept for i, x in enumerate(g))


def test_every_similar_pair_is_a_candidate_whatever_the_number(spark, monkeypatch):
    """No key width that grows with the rows: pairs at the threshold itself meet, also where common shingles come last."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    r = np.random.default_rng(5)
    common = r.integers(0, 1 << 64, 60, np.uint64)
    sets = []
    for k in range(150):
        n = int(r.integers(1, 90))
        x = np.r_[r.integers(0, 1 << 64, n, np.uint64), common[: int(r.integers(0, 60))]]
        sets.append(np.unique(x))
        for _ in range(3):
            out = int(r.integers(0, len(x) // 5 + 1))
            sets.append(np.unique(np.r_[r.permutation(x)[out:], r.integers(0, 1 << 64, int(r.integers(0, max(1, len(x) // 5 - out + 1))), np.uint64)]))
    sets = list({x.tobytes(): x for x in sets if len(x)}.values())
    rows = [(k, x.tobytes()) for k, x in enumerate(sets)]
    each = spark.createDataFrame(rows, "key long, hashes binary")
    got = {(a, b) for a, b in simhash.candidates(each).collect()}
    held = [set(x.tolist()) for x in sets]
    want = {(a, b) for b in range(len(held)) for a in range(b) if len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.8}
    assert len(simhash.common_shingles(each)[0]) > 20 and len(want) > 200 and want <= got


def test_dense_groups_are_verified_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 3)
    r = np.random.default_rng(9)
    base, sets = r.integers(0, 1 << 64, 60, np.uint64), []
    for k in range(40):
        x = base.copy()
        x[r.integers(0, 60, 1 + k % 6)] = r.integers(0, 1 << 64, 1 + k % 6, np.uint64)
        sets.append(np.unique(x))
    each = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "key long, hashes binary")
    pairs = [(a, b) for b in range(40) for a in range(b)]
    got = {tuple(x) for x in simhash.verified(spark.createDataFrame(pairs, "a long, b long"), each).collect()}
    held = [set(x.tolist()) for x in sets]
    want = {(a, b) for a, b in pairs if len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.8}
    assert got == want and 5 < len(want) < len(pairs)


def test_links_of_crowds_do_not_grow_with_their_square(spark, monkeypatch):
    """Many near copies of two texts, some of them too far from all others: their groups are right and whole, their links are not listed in the square of their number."""
    monkeypatch.setattr(simhash, "PART_SETS", 100, raising=False)
    monkeypatch.setattr(simhash, "PART_MEMBERS", 100 << 9, raising=False)
    r = np.random.default_rng(4)
    sets = []
    for size in (120, 150):
        base = r.integers(0, 1 << 64, size, np.uint64)
        for k in range(400):
            x = base.copy()
            n = int(r.integers(0, size // 5 + 1))
            x[r.permutation(size)[:n]] = r.integers(0, 1 << 64, n, np.uint64)
            sets.append(np.unique(x[: size - k % 3]))
    sets += [np.unique(np.r_[x[1:], r.integers(0, 1 << 64, 1, np.uint64)]) for x in (r.integers(0, 1 << 64, 30, np.uint64) for _ in range(20)) for _ in range(2)]
    often = np.unique(np.concatenate(sets), return_counts=True)
    common = [x[often[1] > 3] for x in often]
    rows = [(k, len(x), simhash.prefix(x, *common, 0.8).tobytes(), x.tobytes(), *np.array(simhash.profile(x), np.uint64).view(np.int64).tolist()) for k, x in enumerate(sets)]
    each = spark.createDataFrame(rows, "key long, size int, prefix binary, hashes binary, " + ", ".join(f"{w} long" for w in simhash.WIDE))
    got = [tuple(x) for x in simhash.similar_links(each.drop("hashes"), lambda keys: each.join(keys, "key").select("key", "hashes")).collect()]
    held = [set(x.tolist()) for x in sets]
    want = {(a, b) for b in range(len(held)) for a in range(b) if len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.8}
    assert set(got) <= want and groups(len(sets), got) == groups(len(sets), want)
    assert len(set(groups(len(sets), want)[:800])) > 50 and len(want) > 10_000 and len(got) < 8 * len(sets)


def test_members_in_common(monkeypatch):
    r = np.random.default_rng(8)
    monkeypatch.setattr(simhash, "DENSE", 3)
    monkeypatch.setattr(simhash, "LISTED", 40)
    for rare in (0, 2, 200, 10**9):
        monkeypatch.setattr(simhash, "RARE", rare)
        x, y = ([np.flatnonzero(r.random(50) < p).astype(np.uint64) for p in r.random(n)] for n in (17, 30))
        both = simhash.in_common(x, y)
        assert both.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
        i, j = simhash.forest(both >= 12)
        cells = [(a, 17 + b) for a, b in zip(*np.nonzero(both >= 12))]
        assert (both[i, j] >= 12).all() and groups(47, [(a, 17 + b) for a, b in zip(i, j)]) == groups(47, cells)
        assert len(i) == 47 - len(set(groups(47, cells)))


@pytest.mark.parametrize("few", [0, 200_000])
def test_only_pairs_at_the_threshold_are_linked(spark, monkeypatch, few):
    """Pairs planted at 0.80 to 0.82 all go, pairs planted at 0.70 to 0.79 all stay."""
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(17)
    texts, wanted = [], []
    for k in range(160):
        n, low, high = r.randint(80, 400), *((0.8, 0.82) if k % 2 else (0.7, 0.7999))
        word = lambda k=k: f"w{k}x{r.getrandbits(40)}"
        one = [word() for _ in range(n)]
        both = [c for c in range(5, n) if low <= (c - 4) / (2 * (n - 4) - (c - 4)) < high]
        keep = r.choice(both)
        texts += [one, one[:keep] + [word() for _ in range(n - keep)]]
        wanted += [2 * k] if k % 2 else [2 * k, 2 * k + 1]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    s = [shingles(t) for _, t in rows]
    assert all((len(s[k] & s[k + 1]) / len(s[k] | s[k + 1]) >= 0.8) == (k // 2 % 2 == 1) for k in range(0, len(s), 2))
    kept = [x["doc_id"] for x in simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == wanted


def test_texts_under_one_id_are_judged_apart(spark):
    r = random.Random(23)
    a, b, c, d = (" ".join(f"w{r.getrandbits(40)}" for _ in range(100)) for _ in range(4))
    rows = [(1, a), (7, a + " more"), (7, b), (7, c), (7, c), (9, d), (9, d + " more")]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    least = min(d, d + " more", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert sorted(map(tuple, kept)) == sorted([(1, a), (7, b), (7, c), (9, least)])


def test_components(spark):
    r = random.Random(4)
    links = [(k, k + 1) for k in range(100, 190)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)] + [(5, 5)] + [(7, k) for k in range(2000, 2100)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()))
    g = groups(2200, links)
    assert got == {k: g[k] for pair in links for k in pair if pair[0] != pair[1]}


def brute_suffix(rows, length=50):
    late = 1 << 62
    first, out = {}, []
    texts = [(late if d is None else d, d, (t or "").encode()) for d, t, *_ in rows]
    for o, _, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, late), o)
    for o, d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < o:
                gone[i : i + length] = True
        kept = bytes(b for b, x in zip(t, gone) if not x)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
@pytest.mark.parametrize("block", [600, 6 << 20])
def test_suffix(request, corpus, which, block, monkeypatch):
    monkeypatch.setattr(blocks.blocks_of, "__defaults__", (block,))
    got = suffix.suffix_dedup(request.getfixturevalue(which))
    assert sorted(((*r,) for r in got.collect()), key=str) == brute_suffix(corpus)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=300), min_size=1, max_size=8), st.integers(0, 3))
def test_suffix_of_repetitive_texts(texts, cut):
    rows = [(k // 2 if cut == 1 else k, t + "c" * cut) for k, t in enumerate(texts)]
    got = []
    parts = [blocks.Block([d for d, _ in rows[i::2]], [t.encode() for _, t in rows[i::2]]) for i in range(2) if rows[i::2]]
    ask = [suffix.ask_hashes(b, 3) for b in parts]
    answers = [{} for _ in parts]
    for bucket in range(3):
        who = [k for k, a in enumerate(ask) if bucket in a]
        if who:
            for k, x in zip(who, suffix.answer_hashes([ask[k][bucket] for k in who])):
                answers[k][0, bucket] = x
    sent = [suffix.ask_contexts(b, a, 3).to_pylist() for b, a in zip(parts, answers)]
    for bucket in range(3):
        who = [(k, r["asked"]) for k, s in enumerate(sent) for r in s if r["bucket"] == bucket]
        if who:
            for (k, _), x in zip(who, suffix.answer_contexts([q for _, q in who])):
                answers[k][1, bucket] = x
    for b, a in zip(parts, answers):
        got += [tuple(r.values()) for r in suffix._report(b, a, 3).to_pylist()]
    assert sorted(got, key=str) == brute_suffix(rows)


LONG = """
import resource
from tesseral.llm import blocks, suffix
text, got, b = b"a" * 5_000_000, {}, 4
one = blocks.Block([2, 1], [text, text[:300_000]])
for k, asked in suffix.ask_hashes(one, b).items():
    got[0, k] = suffix.answer_hashes([asked])[0]
t = suffix.ask_contexts(one, got, b)
for k, asked in zip(t["bucket"].to_pylist(), t["asked"].to_pylist()):
    got[1, k] = suffix.answer_contexts([asked])[0]
runs = suffix.removed_runs(one, got, b)
print([r.tolist() for r in runs], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_memory_does_not_follow_repetitive_texts():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, check=True).stdout
    runs, mb = out.rsplit(" ", 1)
    assert runs == "[[[0, 5000000]], []]" and int(mb) < 600


def test_texts_without_repeats(docs, clashing, corpus, empty):
    out = suffix.without_repeats(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    want = {d: n for d, n, *_ in ((x[0], x[1] - x[2]) for x in brute_suffix(corpus)) if d is not None and d != 5}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        if r["doc_id"] in want:
            assert 0 <= len(r["text"].encode()) - want[r["doc_id"]] <= 50
    assert suffix.without_repeats(clashing).columns == clashing.columns and suffix.without_repeats(empty).count() == 0
    assert suffix.suffix_dedup(empty).count() == 0


def test_other_columns_come_back_as_they_were(spark):
    docs = spark.sql("""
        select id doc_id, concat('text ', id, ' is its own') text, timestamp_micros(1700000000123456 + id) at, timestamp_ntz'2024-02-03 04:05:06.123456' local,
            if(id = 2, null, map(cast(id as int), 'x', 700, null)) byint, array(named_struct('t', timestamp_micros(id), 'b', x'00ff')) nested,
            double('NaN') nan, cast(id / 3 as decimal(30, 12)) exact, date'2024-02-03' day, cast(null as string) none, array(null, 1) holes, interval '1 02:03:04.000005' day to second took
        from range(40)""")
    out = suffix.without_repeats(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def brute_links(rows, threshold):
    v = [None if x is None or any(y is None or not math.isfinite(y) for y in x) or not any(x) else np.array(x, np.float32).astype(float) for _, x in rows]
    cos = lambda a, b: a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and cos(v[i], v[j]) >= threshold]
    n = [0] * len(v)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    g = groups(len(v), pairs)
    least = {k: min((d for (d, _), x in zip(rows, g) if x == k and d is not None), default=None) for k in set(g)}
    return sorted([(d, n[i], least[g[i]], d == least[g[i]] or least[g[i]] is None) for i, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("split", [8, 2048])
def test_embeddings(spark, split, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SPLIT", split)
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 24))
    vectors = [c + r.normal(size=24) * 0.05 for c in centres for _ in range(6)] + [centres[0] + r.normal(size=24) * 0.02 for _ in range(60)]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, [2 * x for x in rows[7][1]]), (903, None), (904, [0.0] * 24), (905, [math.nan] * 24), (906, [None] + [1.0] * 23), (907, []), (908, [1.0, 2.0]), (909, [2.0, 4.0]), (None, rows[0][1]), (5, rows[5][1]), (910, [math.inf] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((*x,) for x in embed_dedup.embedding_dedup(df).collect()), key=str)
    assert got == brute_links(rows, 0.95)
    assert embed_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    r, n = np.random.default_rng(6), 3000
    x = r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=(n, 64))
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.9501 * x + math.sqrt(1 - 0.9501**2) * z
    k, tables = embed_dedup.shape_for(1_000_000, 64)
    a, b = embed_dedup.hashes(x, k, tables), embed_dedup.hashes(y, k, tables)
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert met.mean() > 0.995


@pytest.mark.parametrize("dim", [24, 64, 384, 1024])
@pytest.mark.parametrize("n", [10**3, 10**6, 10**9])
def test_recall_holds_for_any_number_of_vectors_and_any_dimension(n, dim):
    """The shape is that for n vectors; pairs at the threshold itself meet in it."""
    r, pairs = np.random.default_rng([n, dim]), 400 if dim < 100 else 120
    x = r.normal(size=(pairs, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=(pairs, dim))
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.9501 * x + math.sqrt(1 - 0.9501**2) * z
    k, tables = embed_dedup.shape_for(n, dim)
    same, near = embed_dedup.meeting_chances(dim, 0.95)
    assert (1 - same**k - k * same ** (k - 1) * near) ** tables <= 1e-4
    a, b = embed_dedup.hashes(x, k, tables), embed_dedup.hashes(y, k, tables)
    assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() > 0.99
