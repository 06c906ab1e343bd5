"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A table's hash of a vector is, for each of K pseudo-random rotations (three rounds of sign flips and the
fast Hadamard transform), the index and sign of the largest coordinate. Each vector stands in the bucket
of its hash and also looks into the buckets that come of taking the second largest coordinate in one
rotation (multiprobe). Vectors that meet are compared by cosine in double precision. K grows with the
logarithm of the number of vectors, so buckets stay small; the number of tables follows from K and the
wanted recall at the threshold itself (closer pairs are found more surely).

Equal vectors are merged first and counted. A pair counts in the first table in which it meets, which
both vectors' hashes tell; so links are counted without listing pairs, and for components each bucket
reports a spanning forest. Buckets above SPLIT rows are cut into chunks and every pair of chunks is one
group, so a dense bucket is spread over tasks and no group exceeds about two chunks.

Null, zero and non-finite vectors, and those with null components, link with nothing. Vectors of different
lengths never link. Null vec_ids are counted as others; a component without any id has a null id, and
its rows are kept. Repeated vec_ids are separate vectors. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import checkpoint, partitions, ship

SPLIT = 2048
FEW_DENSE = 50_000
SPREAD = 8


@functools.lru_cache(64)
def meeting_chances(dim: int, cosine: float, pairs: int = 20_000) -> tuple[float, float]:
    """For one rotation of vectors at this cosine: chance that the largest coordinates agree, and that one's largest is only the other's second.

    Rotated vectors are as good as random ones, so pairs of correlated normal vectors of the padded length tell; the same
    numbers each time. Both are taken three standard deviations low.
    """
    size = 1 << max(0, dim - 1).bit_length()
    r, same, near = np.random.default_rng([5, size]), 0, 0
    for lo in range(0, pairs, 2000):
        x, z = r.standard_normal((2, 2000, size))
        y = cosine * x + math.sqrt(1 - cosine**2) * z
        best, second = [], []
        for v in (x, y):
            a, at = np.abs(v), np.arange(2000)
            i = a.argmax(1)
            best.append(2 * i + (v[at, i] < 0))
            a[at, i] = -1
            i = a.argmax(1)
            second.append(2 * i + (v[at, i] < 0))
        equal = best[0] == best[1]
        same += int(equal.sum())
        near += int((~equal & ((best[0] == second[1]) | (best[1] == second[0]))).sum())
    low = lambda n: max(0.0, n / pairs - 3 * math.sqrt(n / pairs * (1 - n / pairs) / pairs))
    return low(same), low(near)


def shape_for(n: int, dim: int, miss: float = 1e-4, cosine: float = 0.95) -> tuple[int, int]:
    """(rotations per table, tables) for n vectors: buckets of some SPREAD random vectors, and so many tables that a pair at the cosine is missed with at most this chance."""
    size = 1 << max(0, dim - 1).bit_length()
    k = max(1, math.ceil(math.log(max(n, 2) / SPREAD) / math.log(2 * size)))
    k = min(k, int(62 / math.log2(2 * size)))  # codes are 63-bit numbers: beyond some 10^18 vectors
    same, near = meeting_chances(dim, cosine)
    found = same**k + k * same ** (k - 1) * near
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - found))) if found < 1 else 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform along the last axis, whose length is a power of two."""
    n = x.shape[-1]
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(n)


def hashes(v: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(rows, tables, 1 + k) bucket codes: the main one, then those of the probes."""
    rows, dim = v.shape
    size = 1 << max(0, dim - 1).bit_length()
    x = np.zeros((rows, size))
    x[:, :dim] = v
    out = np.zeros((rows, tables, 1 + k), np.int64)
    at = np.arange(rows)
    for t in range(tables):
        best, second = [], []
        for j in range(k):
            y = x
            for sign in np.random.default_rng([97, t, j, size]).choice([-1.0, 1.0], (3, size)):
                y = hadamard(y * sign)
            a = np.abs(y)
            i = a.argmax(1)
            best.append(2 * i + (y[at, i] < 0))
            a[at, i] = -1
            i = a.argmax(1)
            second.append(2 * i + (y[at, i] < 0))
        for p in range(1 + k):
            code = np.zeros(rows, np.int64)
            for j in range(k):
                code = code * (2 * size) + (second[j] if p == j + 1 else best[j])
            out[:, t, p] = code
    return out


def _read(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Valid vectors packed, with a digest; null for the others."""
    for b in batches:
        vec, name = [], []
        for x in b.column(1):
            values = x.as_py()
            v = None
            if values and None not in values:
                a = np.array(values, kind) + np.zeros(1, kind)  # makes -0.0 equal to 0.0
                if np.isfinite(a).all() and a.any():
                    v = a.tobytes()
            vec.append(v)
            name.append(None if v is None else hashlib.blake2b(v, digest_size=16).digest())
        yield pa.record_batch([b.column(0), pa.array(name, pa.binary()), pa.array(vec, pa.binary())], ["vec_id", "name", "vec"])


def _place(batches: Iterator[pa.RecordBatch], k: int, tables: int, kind: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.array([len(x.as_py()) for x in b.column(2)]) // np.dtype(kind).itemsize
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            for lo in range(0, len(at), 1024):
                part = at[lo : lo + 1024]
                rows = b.take(pa.array(part))
                v = np.frombuffer(b"".join(x.as_py() for x in rows.column(2)), kind).reshape(len(part), dim)
                codes = hashes(v, k, tables)
                n, per = len(part), tables * (1 + k)
                take = np.repeat(np.arange(n), per)
                table = np.tile(np.repeat(np.arange(tables), 1 + k), n)
                main = np.tile(np.arange(1 + k) == 0, n * tables)
                place = table.astype(np.int64) << 16 | min(int(dim), 65535)
                again = rows.take(pa.array(take))
                yield pa.record_batch([pa.array(place), pa.array(codes.reshape(-1)), pa.array(main), again.column(0), again.column(1), again.column(2)], ["place", "code", "main", "id", "n", "vec"])


def _group(side: np.ndarray, split: bool, main: np.ndarray, ids: np.ndarray, vec: np.ndarray, threshold: float):
    """Linked pairs that meet here first, as positions: main with main or with a prober, never two probers."""
    unit = vec / np.sqrt(np.einsum("ij,ij->i", vec, vec))[:, None]
    left, right = [], []
    for lo in range(0, len(ids), 1024):
        close = unit[lo : lo + 1024] @ unit.T >= threshold
        i, j = np.nonzero(close)
        i += lo
        keep = (ids[i] < ids[j]) & (main[i] | main[j])
        if split:
            keep &= side[i] != side[j]
        left.append(i[keep])
        right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


def _meet(batches: Iterator[pa.RecordBatch], k: int, threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Per group: (id, null, weight linked to it) and the edges (id, other, 0) of a spanning forest."""
    out_a, out_b, out_n = [], [], []

    def flush():
        a, b, n = (np.concatenate(x) for x in (out_a, out_b, out_n))
        out_a.clear(), out_b.clear(), out_n.clear()
        return pa.record_batch([pa.array(a), pa.array(b, mask=b < 0), pa.array(n)], ["a", "b", "n"])

    def pairs(i, j, ids, weight):
        out_a.extend([ids[i], ids[j]])
        out_b.extend([np.full(len(i), -1), np.full(len(i), -1)])
        out_n.extend([weight[j], weight[i]])

    def forest(i, j, ids):
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        node = np.unique(np.concatenate([i, j]))
        node = node[label[node] != node]
        out_a.append(ids[node])
        out_b.append(ids[label[node]])
        out_n.append(np.zeros(len(node), np.int64))

    def done(rows):
        place, code, lo, hi, side, main, ids, weight, raw = rows
        change = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (code[1:] != code[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        ends = np.r_[change[1:], len(place)]
        for s, e in zip(change[ends - change > 1].tolist(), ends[ends - change > 1].tolist()):
            if not main[s:e].any():
                continue
            vec = np.frombuffer(b"".join(raw[s:e]), kind).reshape(e - s, -1).astype(float)
            i, j = _group(side[s:e], lo[s] != hi[s], main[s:e], ids[s:e], vec, threshold)
            if not len(i):
                continue
            used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            t = int(place[s]) >> 16
            here = ids[s:e]
            a, b = back[: len(i)], back[len(i) :]
            first = np.ones(len(i), bool)
            codes = hashes(vec[used], k, t + 1)
            for p in range(0, len(a), 1 << 14):
                at = slice(p, p + (1 << 14))
                x, y = codes[a[at]], codes[b[at]]
                in_left, in_right = (x[:, :, :1] == y).any(2), (y[:, :, :1] == x).any(2)
                # in this table it may meet in both vectors' own buckets: the lesser id's counts
                mine = ~(in_left[:, t] & in_right[:, t]) | main[s:e][i[at]]
                first[at] = mine & ~(in_left[:, :t] | in_right[:, :t]).any(1)
            i, j = i[first], j[first]
            if len(i):
                pairs(i, j, here, weight[s:e])
                forest(i, j, here)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(c).to_numpy(zero_copy_only=False) for c in range(8)] + [np.array(b.column(8).to_pylist(), object)]
        rows = now if held is None else [np.concatenate([h, n]) for h, n in zip(held, now)]
        same = np.ones(len(rows[0]), bool)
        for c in range(4):
            same &= rows[c] == rows[c][-1]
        cut = int(np.argmax(same))
        if cut:
            done([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
        if sum(map(len, out_a)) > 10_000:
            yield flush()
    if held is not None:
        done(held)
    if out_a:
        yield flush()


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    rows = checkpoint(rows.mapInArrow(lambda it: _read(it, kind), "vec_id long, name binary, vec binary"))
    classes = rows.where("name is not null").groupBy("name").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = checkpoint(classes.withColumn("id", F.monotonically_increasing_id()))
    n, dim = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    k, tables = shape_for(n, (dim or 8) // int(kind[-1]), cosine=threshold)
    placed = classes.select("id", "n", "vec").mapInArrow(lambda it: _place(it, k, tables, kind), "place long, code long, main boolean, id long, n long, vec binary")
    dense = placed.groupBy("place", "code").count().where(F.col("count") > SPLIT).select("place", "code", F.expr(f"cast((count + {SPLIT - 1}) div {SPLIT} as int)").alias("chunks"))
    dense = checkpoint(dense)
    many = dense.count()
    if many:
        # a row per bucket above SPLIT; as long as they are few, the vectors need not be shuffled to meet them
        placed = placed.join(F.broadcast(dense) if many <= FEW_DENSE else dense, ["place", "code"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    else:
        placed = placed.withColumn("chunks", F.lit(1))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("id"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("place", "code", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "main", "id", "n", "vec")
    placed = placed.repartition(partitions(spark), "place", "code", "lo", "hi").sortWithinPartitions("place", "code", "lo", "hi")
    met = checkpoint(placed.mapInArrow(lambda it: _meet(it, k, threshold, kind), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    weight = met.where("b is null").select(F.col("a").alias("id"), F.col("n").alias("linked"))
    label = components(met.where("b is not null"), "a", "b").withColumnRenamed("node", "id")
    of = label.join(classes.select("id", "least"), "id")
    names = of.groupBy("component").agg(F.min("least").alias("of_component"))
    of = of.join(names, "component").select("id", "of_component", F.lit(True).alias("has"))
    each = classes.select("name", "id", "least", "n").join(weight, "id", "left").join(of, "id", "left")
    each = each.select("name", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("has"), F.col("of_component")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("valid"))
    out = rows.select("vec_id", "name").join(each, "name", "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
