"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets a table row of its Hamming distances to reference fingerprints
(pivots). By the triangle inequality two fingerprints at most ``RADIUS`` bits apart differ by at most
that in every coordinate, so pairs whose maximum coordinate difference is greater are discarded and only
the survivors' bits are compared. Distances to random pivots crowd around 32 and cannot route pairs to
tasks by themselves; for that, fingerprints are grouped by the 28 ways to leave two of their eight bytes
out: at most two differing bits lie in at most two bytes, so each pair meets in such a group, and as
members of a group are distinct and differ in two bytes only, no group exceeds 65,536 whatever the data.

Equal texts and equal fingerprints are merged first, so groups of copies cost one row. Null texts have no
words (fingerprint zero). Null ids: the row is linked like any other, but names no component; component_id
is null where nobody in it has an id. Repeated rows come back once each. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import checkpoint, enter, partitions, release, ship, trim

RADIUS, WIDTH, SEED = 2, 3, 42
N_PIVOTS = 24
PAIRS = list(combinations(range(8), 2))
CHUNK = 1 << 16


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, n, np.uint64)


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    import xxhash

    words, h = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [h(line, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    begin = end - size
    return [h(line[s:e], SEED) for s, e in zip(begin[: len(words) - width + 1].tolist(), (end[width - 1 :] - 1).tolist())]


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(texts: list[bytes], width: int = WIDTH) -> list[int]:
    """Majority bits of each text's shingle hashes; long texts are summed up in chunks."""
    out, held, owner = [0] * len(texts), [], []

    def settle() -> None:
        if not held:
            return
        counts = [len(x) for x in held]
        bits = _bits(np.array([h for x in held for h in x], np.uint64))
        sums = np.add.reduceat(bits, np.r_[0, np.cumsum(counts)[:-1]], axis=0, dtype=np.int32)
        packed = np.packbits(2 * sums > np.array(counts)[:, None], axis=1, bitorder="little").view("<u8").ravel()
        for k, f in zip(owner, packed.tolist()):
            out[k] = f
        held.clear()
        owner.clear()

    n = 0
    for k, t in enumerate(texts):
        hs = shingle_hashes(t, width)
        if len(hs) > CHUNK:
            sums = np.zeros(64, np.int64)
            for at in range(0, len(hs), CHUNK):
                sums += _bits(np.array(hs[at : at + CHUNK], np.uint64)).sum(0, dtype=np.int64)
            out[k] = int(np.packbits(2 * sums > len(hs), bitorder="little").view("<u8")[0])
        elif hs:
            held.append(hs)
            owner.append(k)
            n += len(hs)
            if n > CHUNK:
                settle()
                n = 0
    settle()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for x in b.column(b.num_columns - 1):
            t = x.as_buffer()
            texts.append(t.to_pybytes() if t is not None else b"")
        f = np.array(fingerprints(texts, width), np.uint64).view(np.int64)
        yield pa.record_batch([*b.columns[:-1], pa.array(f)], [*b.schema.names[:-1], "fp"])


def links_in(c: np.ndarray, key: np.ndarray, near: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within groups; rows sorted by group and distance to the first pivot."""
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    first = np.array([1 if i == 0 else i for i in range(8)])
    a_out, b_out = [], []
    active, step = np.arange(len(fp)), 1
    while True:
        active = active[active + step < len(fp)]
        other = active + step
        active = active[(key[active] == key[other]) & (c[active] == c[other]) & (near[other] - near[active] <= radius)]
        if not len(active):
            break
        other = active + step
        close = np.abs(table[active] - table[other]).max(1) <= radius
        i, j = active[close], other[close]
        x = fp[i] ^ fp[j]
        ok = np.bitwise_count(x) <= radius
        i, j, x = i[ok], j[ok], x[ok]
        if len(i):
            differs = x.view(np.uint8).reshape(-1, 8) != 0
            low, high = differs.argmax(1), 7 - differs[:, ::-1].argmax(1)
            one = low == high
            lo, hi = np.where(one, np.minimum(low, 0), low), np.where(one, first[high], high)
            mine = c[i] == lo * 8 + hi  # a pair meets in several groups: it is reported in one
            a_out.append(fp[i[mine]])
            b_out.append(fp[j[mine]])
        step += 1
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a_out]), np.concatenate([none, *b_out])


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    held = None
    def found(rows):
        a, b = links_in(*rows, radius)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False).astype(t) if t is not None else batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k, t in ((0, np.int16), (1, np.int64), (2, np.int16), (3, None))]
        rows = now if held is None else [np.concatenate([h, n]) for h, n in zip(held, now)]
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(np.argmax(same))  # the last group may go on in the next batch
        if cut:
            yield found([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
    if held is not None and len(held[0]):
        yield found(held)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): each pair of the distinct fingerprints in ``fp`` that are at most radius (0 to 2) bits apart, once."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("groups that leave two bytes out find pairs of up to two bits")
    ship(distinct.sparkSession)
    first = int(pivots().view(np.int64)[0])
    ways = []
    for i, j in PAIRS:
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) ^ np.uint64(0xFF << 8 * i) ^ np.uint64(0xFF << 8 * j)
        ways.append(F.struct(F.lit(8 * i + j).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(int(mask.view(np.int64)))).alias("key")))
    rows = distinct.select("fp", F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))).cast("short").alias("near"), F.explode(F.array(*ways)).alias("w"))
    rows = rows.select("w.c", "w.key", "near", "fp").repartition(partitions(distinct.sparkSession), "c", "key").sortWithinPartitions("c", "key", "near")
    return rows.mapInArrow(lambda it: _links(it, radius), "a long, b long")


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for rows of (doc_id, fp)."""
    each = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(fingerprint_links(each.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    linked = label.join(each, "fp")
    names = linked.groupBy("component").agg(F.min("least").alias("of_component"))
    linked = linked.join(names, "component").select("fp", F.lit(True).alias("is_linked"), "of_component")
    return each.join(linked, "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("of_component")).otherwise(F.col("least")).alias("component_id"))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return checkpoint(rows.mapInArrow(lambda it: _fingerprint(it, width), "doc_id long, fp long"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, kept (the component's least doc_id; all rows where none has an id)."""
    rows = fingerprinted(docs, id_col, text_col, width)
    out = rows.join(classes(rows, radius), "fp")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept"))


# Groups of similar documents, for filtering: wider shingles, and pairs much farther apart than RADIUS

WORDS, SIMILAR = 5, 0.8
STREAMS = 4
_STREAM = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: One document in SAMPLE is counted to find common shingles; those seen COMMON times there come last, MOST of them at most.
SAMPLE, COMMON, MOST = 16, 4, 200_000
ROWS = 200_000
#: Names up to this many go to all executors (some 50 MB); more are joined by shuffling.
FEW = 200_000
#: Sets that one group of the verification holds at once.
HELD = 256
#: A token in more prefixes than this makes a crowd: its pairs are not listed, its sets are compared in tiles.
CROWD = 128
#: What one part of a crowd holds: sets at most, and members of sets (the last set may exceed it). A tile is two parts.
PART_SETS, PART_MEMBERS = 1024, 1 << 19
#: Members that more than one pair of sets in so many shares are counted by multiplying matrices, DENSE of them at once; others pair by pair, LISTED at once.
RARE, DENSE, LISTED = 200, 2048, 1 << 21


def bits_apart(similarity: float, deviations: float = 8) -> int:
    """Differing bits of STREAMS fingerprints that two sets of this Jaccard similarity stay below: the mean and several standard deviations."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * STREAMS
    return int(angle * n + deviations * math.sqrt(n * angle * (1 - angle)))


def profile(hashes: np.ndarray) -> list[int]:
    """STREAMS fingerprints of a set of shingle hashes."""
    if not len(hashes):
        return [0] * STREAMS
    out = []
    for k, salt in enumerate(_STREAM):
        x = hashes
        if k:
            x = (x ^ (x >> np.uint64(31))) * salt
            x ^= x >> np.uint64(29)
        sums = np.zeros(64, np.int64)
        for at in range(0, len(x), CHUNK):
            sums += _bits(x[at : at + CHUNK]).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * sums > len(x), bitorder="little").view("<u8")[0]))
    return out


def _set(x, width: int) -> tuple[np.ndarray, int]:
    """The set of a text's shingle hashes, sorted, and its name (a digest)."""
    t = x.as_buffer()
    h = np.unique(np.array(shingle_hashes(t.to_pybytes() if t is not None else b"", width), np.uint64))
    return h, int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    enter("simhash")
    for b in batches:
        sets = [_set(x, width) for x in b.column(0)]
        yield pa.record_batch([pa.array([k for _, k in sets], pa.int64()), pa.array([h.tobytes() for h, _ in sets], pa.binary())], ["key", "hashes"])
    trim()


def _profiles(batches: Iterator[pa.RecordBatch], width: int, similarity: float, common: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text the name of its set, the set's size, its prefix and fingerprints: all that finding candidates takes."""
    enter("simhash")
    for b in batches:
        names, sizes, first, prints = [], [], [], []
        for x in b.column(2):
            h, name = _set(x, width)
            names.append(name)
            sizes.append(len(h))
            first.append(prefix(h, common, times, similarity).tobytes())
            prints.append(profile(h))
        f = np.array(prints, np.uint64).reshape(-1, STREAMS).view(np.int64)
        yield pa.record_batch([*b.columns[:2], pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(first, pa.binary()), *(pa.array(f[:, k]) for k in range(STREAMS))], [*b.schema.names[:2], "key", "size", "prefix", *WIDE])
    trim()


WIDE = [f"wide{k}" for k in range(STREAMS)]


def _each_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array(np.frombuffer(b"".join(x.as_py() for x in b.column(0)), np.int64))], ["token"])


def common_shingles(each: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that most sets hold, by a sample of them. They only decide an order: what they miss costs time, not pairs."""
    return most_common(each.where(F.pmod("key", F.lit(SAMPLE)) == 0).select("hashes"))


def most_common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sets.mapInArrow(_each_hash, "token long")
    counts = checkpoint(rows.groupBy("token").count().where(F.col("count") >= COMMON))
    least, held = COMMON, 0
    for c, n in counts.groupBy("count").agg(F.count("*")).orderBy(F.desc("count")).toLocalIterator():
        held += n
        if held > MOST:
            least = c + 1
            break
    got = counts.where(F.col("count") >= least).collect()  # at most MOST
    tokens, times = np.array([r[0] for r in got], np.int64).view(np.uint64), np.array([r[1] for r in got], np.int64)
    order = np.argsort(tokens)
    return tokens[order], times[order]


def prefix(h: np.ndarray, common: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set in the order of all sets (rare ones first), as many as any set this similar must share one of."""
    n = len(h)
    size = n - math.ceil(similarity * n - 1e-9) + 1
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        weight = np.where(common[at] == h, times[at], 0)
        if weight.any():
            h = h[np.argsort(weight, kind="stable")]
    return h[:size]


def _prefixed(batches: Iterator[pa.RecordBatch], common: np.ndarray, times: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(1)]
        first = [prefix(h, common, times, similarity).tobytes() for h in sets]
        yield pa.record_batch([b.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array(first, pa.binary())], ["key", "size", "prefix"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, place, key): place is the set's size and, in the low half, where in its order the token stands."""
    for b in batches:
        if not b.num_rows:
            continue
        tokens, places, counts = [], [], []
        for n, x in zip(b.column(1).to_pylist(), b.column(2)):
            p = np.frombuffer(x.as_py(), np.int64)
            tokens.append(p)
            places.append(np.int64(n) << np.int64(32) | np.arange(len(p), dtype=np.int64))
            counts.append(len(p))
        yield pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places)), pa.array(np.repeat(b.column(0).to_numpy(), counts))], ["token", "place", "key"])


def _once(pairs: np.ndarray) -> np.ndarray:
    """The distinct columns of (2, n), sorted."""
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    return pairs[:, np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(0)][: pairs.shape[1]]]


def sharing(token: np.ndarray, place: np.ndarray, key: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of keys (2, n) that share a token and whose sizes and places leave room for the similarity; rows sorted by token and place."""
    size, rest = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
    out, held, active, step = [np.zeros((2, 0), np.int64)], 0, np.arange(len(token)), 1
    while True:
        active = active[active + step < len(token)]
        other = active + step
        go_on = (token[active] == token[other]) & (size[active] >= similarity * size[other] - 1e-9)
        active, other = active[go_on], other[go_on]
        if not len(active):
            break
        room = np.minimum(rest[active], rest[other]) >= similarity / (1 + similarity) * (size[active] + size[other]) - 1e-9
        a, b = key[active[room]], key[other[room]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        held += len(a)
        if held > max(1 << 20, out[0].shape[1]):
            out = [_once(np.concatenate(out, axis=1))]
            held = 0
        step += 1
    return _once(np.concatenate(out, axis=1))


MET = "a long, b long, token long, n int"


def _similar(batches: Iterator[pa.RecordBatch], similarity: float, crowd: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with n = 0; of tokens in more than ``crowd`` prefixes (n) a row for each set instead: its key and its size."""
    held, size = [], 0

    def joined():
        return [np.concatenate(x) for x in zip(*held)]

    def found(rows):
        token, place, key = rows
        n = np.diff(np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]).astype(np.int32)
        n = np.repeat(n, n)
        many = n > (len(n) if crowd is None else crowd)
        a, b = sharing(token[~many], place[~many], key[~many], similarity)
        columns = [np.r_[a, key[many]], np.r_[b, place[many] >> 32], np.r_[np.zeros_like(a), token[many]], np.r_[np.zeros(len(a), np.int32), n[many]]]
        return pa.record_batch([pa.array(c) for c in columns], ["a", "b", "token", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy() for k in range(3)])
        size += batch.num_rows
        if size < ROWS or held[0][0][0] == held[-1][0][-1]:
            continue
        rows = joined()
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last token may go on in the next batch
        yield found([r[:cut] for r in rows])
        held, size = [[r[cut:] for r in rows]], len(rows[0]) - cut
    if held:
        yield found(joined())
    trim()


def candidates(each: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(a, b): pairs of the distinct ``key`` among which is every pair of sets ``hashes`` that is this similar, whatever their number.

    Two sets of Jaccard similarity s share one of the first n - ceil(s n) + 1 members of either, in any
    order that is the same for all (prefix filtering). The order takes common shingles last, so that groups stay small.
    """
    common, times = common_shingles(each)
    return meeting(each.select("key", "hashes").mapInArrow(functools.partial(_prefixed, common=common, times=times, similarity=similarity), "key long, size int, prefix binary"), similarity)


def meeting(each: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(a, b): pairs of ``key`` whose ``prefix`` share a member, at places that leave room for the similarity."""
    return _met(each, similarity, None).select("a", "b").distinct()


def _met(each: DataFrame, similarity: float, crowd: int | None) -> DataFrame:
    rows = each.select("key", "size", "prefix").mapInArrow(_tokens, "token long, place long, key long")
    rows = rows.repartition(partitions(each.sparkSession), "token").sortWithinPartitions("token", "place")
    return rows.mapInArrow(functools.partial(_similar, similarity=similarity, crowd=crowd), MET)


def tiles(members: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """Rows for _verify, of (key, size, token, n): all sets that share a token meet in a tile, unless their sizes are too far apart.

    Each set belongs to its most frequent token, whose sets are cut into parts by size. Two parts make a tile
    where some token has sets in both; a tile's name is a hash, and two of one name would be one larger tile.
    """
    home = members.groupBy("key").agg(F.max(F.struct("n", "token")).getField("token").alias("home"), F.first("size").alias("size"))
    before = Window.partitionBy("home").orderBy("size", "key").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.greatest(F.col("size"), F.lit(PART_MEMBERS // PART_SETS))).over(before), F.lit(0))
    parts = checkpoint(home.select("key", F.struct("home", F.floor(taken / PART_MEMBERS).alias("k")).alias("part")))
    at = checkpoint(members.join(parts, "key").groupBy("token", "part").agg(F.min("size").alias("lo"), F.max("size").alias("hi")))
    one, other = (at.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("part", "lo", "hi")]) for k in (1, 2))
    fit = (F.col("hi1") >= similarity * F.col("lo2") - 1e-6) & (F.col("hi2") >= similarity * F.col("lo1") - 1e-6)
    both = checkpoint(one.join(other, "token").where((F.col("part1") <= F.col("part2")) & fit).select("part1", "part2").distinct())
    sides = both.withColumn("role", F.lit(0)).withColumn("part", F.col("part1"))
    sides = sides.unionByName(both.where("part1 <> part2").withColumn("role", F.lit(1)).withColumn("part", F.col("part2")))
    return sides.join(parts, "part").select(F.xxhash64("part1", "part2").alias("m"), F.lit(-1).alias("s"), "role", "key", F.lit(None).cast("array<long>").alias("others"))


def in_common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)): the number of members that each set of x has in common with each of y."""
    shape = len(x), len(y)
    of_x, of_y = (np.repeat(np.arange(len(z)), [len(h) for h in z]) for z in (x, y))
    names, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    at_x, at_y = at[: len(of_x)], at[len(of_x) :]
    in_x, in_y = (np.bincount(a, minlength=len(names)) for a in (at_x, at_y))
    dense, out = in_x * in_y * RARE > len(x) * len(y), np.zeros(shape, np.int32)
    often = np.flatnonzero(dense)
    for s in range(0, len(often), DENSE):
        some = often[s : s + DENSE]
        column, held = np.full(len(names), -1), []
        column[some] = np.arange(len(some))
        for a, of, n in ((at_x, of_x, len(x)), (at_y, of_y, len(y))):
            ok = column[a] >= 0
            held.append(np.zeros((n, len(some)), np.float32))
            held[-1][of[ok], column[a[ok]]] = 1
        out += (held[0] @ held[1].T).astype(np.int32)
    ok = ~dense[at_x] & (in_y[at_x] > 0)
    at_x, of_x, of_y = at_x[ok], of_x[ok], of_y[np.argsort(at_y, kind="stable")]
    first, times, s = np.cumsum(in_y) - in_y, in_y[at_x], 0
    done = np.cumsum(times)
    while s < len(at_x):
        e = max(s + 1, int(np.searchsorted(done, (done[s - 1] if s else 0) + LISTED, "right")))
        n = times[s:e]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat = np.repeat(of_x[s:e], n) * shape[1] + of_y[np.repeat(first[at_x[s:e]], n) + step]
        out += np.bincount(flat, minlength=shape[0] * shape[1]).reshape(shape).astype(np.int32)
        s = e
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of true cells, as few as join all rows and columns that the true cells join."""
    rows, columns = linked.any(1), linked.any(0)  # not reached so far
    r_out, c_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in np.flatnonzero(rows):
        edge = np.array([root])[rows[root : root + 1]]
        rows[root] = False
        while len(edge):
            free = np.flatnonzero(columns)
            near = linked[np.ix_(edge, free)]
            hit = near.any(0)
            new = free[hit]
            if not len(new):
                break
            r_out.append(edge[near[:, hit].argmax(0)])
            c_out.append(new)
            columns[new] = False
            free = np.flatnonzero(rows)
            near = linked[np.ix_(free, new)]
            hit = near.any(1)
            edge = free[hit]
            r_out.append(edge)
            c_out.append(new[near[hit].argmax(1)])
            rows[edge] = False
    return np.concatenate(r_out), np.concatenate(c_out)


def tile_links(sides: tuple[list, list], similarity: float) -> tuple[list[int], list[int]]:
    """Links between the sets (key, members) of one side and the other, or among those of the first alone; as few as join what all of them join."""
    if not sides[0]:
        return [], []
    one, other = sides[0], sides[1] or sides[0]
    both = in_common([h for _, h in one], [h for _, h in other]).astype(np.int64)
    m, n = (np.array([len(h) for _, h in x]) for x in (one, other))
    i, j = forest(both / (m[:, None] + n[None, :] - both) >= similarity)
    pairs = [(one[k][0], other[e][0]) for k, e in zip(i.tolist(), j.tolist())]
    pairs = [p for p in pairs if p[0] != p[1]]
    return [min(p) for p in pairs], [max(p) for p in pairs]


def close(pairs: DataFrame, each: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """The pairs whose fingerprints are not far below the similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(each.select(F.col("key").alias(side), *[F.col(w).alias(f"{side}_{w}") for w in WIDE]), side)
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WIDE), F.lit(0))
    return pairs.where(apart <= bits_apart(similarity)).select("a", "b")


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows by group: first the sets that the group holds, then sets to compare with some of them; where s < 0, the two sides of a tile."""
    group, held, sides = None, {}, ([], [])
    for batch in batches:
        a, b = [], []
        for m, s, role, key, others, x in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
            if (m, s) != group:
                more = tile_links(sides, similarity)
                a += more[0]
                b += more[1]
                group, held, sides = (m, s), {}, ([], [])
            h = np.frombuffer(x.as_py(), np.uint64)
            if s < 0:
                sides[role].append((key, h))
                continue
            if others is None:
                held[key] = h
                continue
            for k in others:
                o = held[k]
                both = len(np.intersect1d(h, o, assume_unique=True))
                if both / (len(h) + len(o) - both) >= similarity:
                    a.append(k)
                    b.append(key)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    a, b = tile_links(sides, similarity)
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    trim()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILAR, crowds: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose sets (key, hashes) have this Jaccard similarity; of crowds, which are tiles(), links that join what all of theirs join.

    Pairs are grouped by the least neighbour of ``a``, which members of a dense group share, so a set travels once
    to its group however many pairs it is in. Groups with many ``a`` are cut into parts that hold HELD sets each.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    rows = pairs.join(near, "a")
    parts = rows.groupBy("m").agg(F.count_distinct("a").alias("n"))
    rows = rows.join(parts, "m").withColumn("s", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / HELD)).cast("int"))
    rows = checkpoint(rows.select("m", "s", "a", "b"))
    left = rows.select("m", "s", F.lit(0).alias("role"), F.col("a").alias("key"), F.lit(None).cast("array<long>").alias("others")).distinct()
    right = rows.groupBy("m", "s", "b").agg(F.collect_list("a").alias("others")).select("m", "s", F.lit(1).alias("role"), F.col("b").alias("key"), "others")
    met = left.unionByName(right)
    met = (met if crowds is None else met.unionByName(crowds)).join(sets, "key").select("m", "s", "role", "key", "others", "hashes")
    met = met.repartition(partitions(pairs.sparkSession), "m", "s").sortWithinPartitions("m", "s", "role")
    return met.mapInArrow(functools.partial(_verify, similarity=similarity), "a long, b long")


def similar_links(each: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float = SIMILAR) -> DataFrame:
    """(a, b): links of the distinct sets ``key`` whose Jaccard similarity is at least this, and no others.

    Fingerprints only discard candidates that are far below; the sets themselves decide. ``sets`` gives (key, hashes) for a table of keys.
    Where more than CROWD sets share a member of their prefixes, neither their pairs nor all of their links are listed, but
    all pairs are compared, and enough links come back to join what all links join.
    """
    met = checkpoint(_met(each, similarity, CROWD))
    pairs = checkpoint(close(met.where("n = 0").select("a", "b").distinct(), each, similarity))
    members = met.where("n > 0").select(F.col("a").alias("key"), F.col("b").alias("size"), "token", "n")
    keys, crowds = pairs.select(F.explode(F.array("a", "b")).alias("key")), None
    if not members.isEmpty():
        keys, crowds = keys.unionByName(members.select("key")), tiles(members, similarity)
    release(each.sparkSession)
    return verified(pairs, sets(keys.distinct()), similarity, crowds)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, similarity: float = SIMILAR) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs: the least id's.

    Documents are linked whose sets of shingles have at least this Jaccard similarity; links make groups.
    A document is an id and a text: rows that share both are one, different texts under one id are judged
    apart, and among those of a group's least id the least digest stays. Rows without an id stand for their
    group only where nobody in it has an id. Texts without words are alike.

    Shuffled are prefixes and fingerprints of all texts, and the sets of those that have a candidate; texts stay where they are as
    long as no more than FEW of them go.
    """
    ship(docs.sparkSession)
    digest = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    name = F.concat(F.coalesce(F.concat(F.lit("="), docs[id_col].cast("string")), F.lit("")), F.lit("-"), digest)
    rows = docs.select(name.alias("__llm_name"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    common, times = most_common(some.mapInArrow(functools.partial(_sets, width=width), "key long, hashes binary").select("hashes"))
    f = functools.partial(_profiles, width=width, similarity=similarity, common=common, times=times)
    found = rows.mapInArrow(f, "__llm_name string, doc_id long, key long, size int, prefix binary, " + ", ".join(f"{w} long" for w in WIDE))
    found = checkpoint(found)
    each = found.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "__llm_name")).alias("least"), *[F.first(c).alias(c) for c in ("size", "prefix", *WIDE)])
    each = checkpoint(each)
    release(docs.sparkSession)

    def sets(keys: DataFrame) -> DataFrame:
        names = checkpoint(each.select("key", "least").join(keys, "key").select(F.col("least.__llm_name").alias("__llm_name")))
        texts = rows.join(_small(names), "__llm_name", "left_semi").select("text")
        return texts.mapInArrow(functools.partial(_sets, width=width), "key long, hashes binary").dropDuplicates(["key"])

    links = checkpoint(similar_links(each, sets, similarity))
    release(docs.sparkSession)
    label = components(links, "a", "b").withColumnRenamed("node", "key")
    group = each.select("key", "least").join(label, "key", "left").withColumn("group", F.coalesce("component", "key"))
    first = group.groupBy("group").agg(F.min("least").getField("__llm_name").alias("kept"))
    return _without(docs, name, found.select("key", "__llm_name"), checkpoint(group.join(first, "group").select("key", "kept")))


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.count() <= FEW else names


def _without(docs: DataFrame, name: Column, named: DataFrame, kept: DataFrame) -> DataFrame:
    """docs less the documents that are not their group's ``kept``, and one row of each document that is repeated."""
    named = named.groupBy("key", "__llm_name").agg(F.count("*").alias("n")).join(kept, "key")
    named = checkpoint(named.where((F.col("__llm_name") != F.col("kept")) | (F.col("n") > 1)).select("__llm_name", (F.col("__llm_name") == F.col("kept")).alias("stays")))
    docs_named, gone = docs.withColumn("__llm_name", name), named.count()
    out = docs_named.join(F.broadcast(named) if gone <= FEW else named, "__llm_name", "left_anti")
    again = named.where("stays").select("__llm_name")
    if n := again.count():
        again = docs_named.join(F.broadcast(again) if n <= FEW else again, "__llm_name", "left_semi")
        out = out.unionByName(again.dropDuplicates(["__llm_name"]))
    return out.drop("__llm_name")
