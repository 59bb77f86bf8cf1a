"""Operator 10: near-duplicate embeddings by cross-polytope hashing with multiprobe and exact verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, mix, stage, table, tidy
from .components import components

COSINE = 0.98
#: Hash tables, rotations joined in one key, and further buckets that a vector also enters in each table.
TABLES = 8
JOINED = 3
PROBES = 3
#: Vectors in one block; two blocks are compared as one group.
BLOCK = 512
#: Groups of fewer rows are compared pair by pair, all groups of a batch at once.
SMALL = 24
SEED = 20261126


def _signs(tables: int, joined: int, size: int) -> np.ndarray:
    """Random signs of the three diagonal matrices of each rotation."""
    n = tables * joined * 3 * size
    return np.where(mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(SEED)) & np.uint64(1), 1.0, -1.0).reshape(tables, joined, 3, size)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


def bucket_keys(x: np.ndarray, tables: int = TABLES, joined: int = JOINED, probes: int = PROBES) -> np.ndarray:
    """For each unit vector and table, its own bucket and its next best ones: (vectors, tables, 1 + probes).

    A rotation is three rounds of random signs and a fast Hadamard transform; the
    vertex of the cross-polytope nearest to the rotated vector is its largest
    coordinate with the sign. A further bucket replaces one vertex of the key by
    the second or third nearest, those first that lose the least.
    """
    rows, dim = x.shape
    size = max(8, 1 << (dim - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :dim] = x
    signs = _signs(tables, joined, size)
    out = np.empty((rows, tables, 1 + probes), dtype=np.int64)
    each = np.arange(rows)
    for t in range(tables):
        best, other, loss = [], [], []
        for j in range(joined):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, j, r])
            length = np.abs(y)
            top = np.argpartition(length, size - 3, axis=1)[:, size - 3 :]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(length, top, 1), axis=1, kind="stable"), 1)
            vertex = [2 * top[:, k] + (y[each, top[:, k]] < 0) for k in range(3)]
            best.append(vertex[0])
            for k in (1, 2):
                other.append((j, vertex[k]))
                loss.append(length[each, top[:, 0]] - length[each, top[:, k]])
        order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")
        for p in range(1 + probes):
            key = np.full(rows, t + 1, dtype=np.uint64)
            for j in range(joined):
                v = best[j].copy()
                for c, (at, vertex) in enumerate(other):
                    if p and at == j:
                        v = np.where(order[:, p - 1] == c, vertex, v)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64))
            out[:, t, p] = key.view(np.int64)
    return out


def unit_vectors(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one, and which rows those are; shorter rows are padded by zeros."""
    good = [i for i, r in enumerate(rows) if r and all(v is not None for v in r)]
    width = max((len(rows[i]) for i in good), default=0)
    x = np.zeros((len(good), width))
    for k, i in enumerate(good):
        x[k, : len(rows[i])] = rows[i]
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0.0)
        fine = np.isfinite(top) & (top > 0)
        x = x[fine] / top[fine, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x, np.array(good, dtype=np.int64)[fine]


def _from_bytes(column) -> np.ndarray:
    """Vectors of an Arrow binary column, padded by zeros to the longest."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), width // 8)
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype="<f8").reshape(len(rows), width // 8)


def with_units(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit: the unit vector as bytes; null where the row links with nothing."""
    import pyarrow as pa

    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))

    def units(batches):
        for b in batches:
            x, rows = unit_vectors(b.column(2).to_pylist())
            unit: list = [None] * b.num_rows
            for k, i in enumerate(rows.tolist()):
                unit[i] = x[k].tobytes() if b.column(1)[i].is_valid else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(unit, pa.binary())], names=["vec_id", "label", "unit"])

    return src.mapInArrow(tidy(units), "vec_id long, label string, unit binary")


def _compare(ids, table_of, key, mine, apart, size, x, keys, threshold):
    """Links of one large group: per row the count that belongs to this bucket, and the smallest id joined here."""
    linked = np.empty((len(ids), len(ids)), dtype=bool)
    for a in range(0, len(ids), 256):
        linked[a : a + 256] = x[a : a + 256] @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if apart:
        linked &= mine[:, None] != mine[None, :]
    lead = ids.copy()
    while True:
        new = np.minimum(lead, np.where(linked, lead[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == lead).all():
            break
        lead = new
    count = linked
    for t in range(table_of):  # an earlier table has counted what shares a bucket there
        if not count.any():
            break
        for p in range(keys.shape[2]):
            for q in range(keys.shape[2]):
                count &= keys[:, t, p][:, None] != keys[None, :, t, q]
    for p in range(keys.shape[2]):  # and so has the smaller of two buckets shared in this table
        for q in range(keys.shape[2]):
            a, b = keys[:, table_of, p], keys[:, table_of, q]
            if (a < key).any() and count.any():
                count &= (a[:, None] != b[None, :]) | (a >= key)[:, None]
    return (count * size[None, :]).sum(axis=1), lead


def links(classes: DataFrame, threshold: float = COSINE, block: int = BLOCK, tables: int = TABLES, joined: int = JOINED, probes: int = PROBES) -> DataFrame:
    """Rows (id, n, lead): id has n links that no other row of id counts, and is joined with lead.

    Classes of one label that share a bucket are compared by exact cosine in
    double precision. A bucket of more than `block` classes is cut by a hash of
    the id, and each two blocks are a group of their own, so that no group holds
    more than about two blocks. A pair that shares several buckets is counted in
    the first of them only; no pair is written.
    """
    import pyarrow as pa

    def hashed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = bucket_keys(_from_bytes(b.column(2)), tables, joined, probes)
            n, each = b.num_rows, tables * (1 + probes)
            order = np.repeat(np.arange(n), each)
            # a vector enters a bucket once, though two probes may agree
            flat = keys.reshape(n, each)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order)), b.column(1).take(pa.array(order)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)), pa.array(flat.ravel())], names=["id", "label", "t", "key"])

    rows = stage(classes.select("id", "label", "unit").mapInArrow(tidy(hashed), "id long, label string, t int, key long").distinct(), "buckets")
    full = stage(rows.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "full")
    member = rows.join(full, ["label", "t", "key"]).withColumn("blocks", F.ceil(F.col("members") / block).cast("long")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    member = member.select("id", "label", "t", "key", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    met = member.join(classes.select("id", "unit", "size"), "id").select("id", "label", "t", "key", "mine", "low", "high", "size", "unit")
    met = met.repartition("label", "t", "key", "low", "high").sortWithinPartitions("label", "t", "key", "low", "high", "id")

    def batch_links(batch):
        ids, t, key, mine, low, high, size = (batch.column(k).to_numpy() for k in (0, 2, 3, 4, 5, 6, 7))
        label = batch.column(1).dictionary_encode().indices.to_numpy()
        x = _from_bytes(batch.column(8))
        keys = bucket_keys(x, tables, joined, probes)
        new = np.ones(len(ids), dtype=bool)
        for c in (label, t, key, low, high):
            new[1:] &= True
        new[1:] = (label[1:] != label[:-1]) | (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        start = np.flatnonzero(new)
        length = np.diff(start, append=len(ids))
        out = [[], [], []]
        for s, n in zip(start[length >= SMALL].tolist(), length[length >= SMALL].tolist()):
            p = slice(s, s + n)
            count, lead = _compare(ids[p], int(t[s]), key[s], mine[p], low[s] != high[s], size[p], x[p], keys[p], threshold)
            for o, v in zip(out, (ids[p], count, lead)):
                o.append(v)
        group = np.cumsum(new)
        small = np.repeat(length < SMALL, length)
        for d in range(1, SMALL):
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(ids) > d else np.zeros(0, dtype=np.int64)
            if not len(i):
                break
            j = i + d
            i = i[((x[i] * x[j]).sum(axis=1) >= threshold) & ((low[i] == high[i]) | (mine[i] != mine[j]))]
            j = i + d
            shared = (keys[i][:, :, :, None] == keys[j][:, :, None, :]).any(axis=3)  # pairs, tables, own probes
            first = shared.any(axis=2).argmax(axis=1)
            here = np.where(shared[np.arange(len(i)), first], keys[i, first], np.iinfo(np.int64).max).min(axis=1) if len(i) else np.zeros(0)
            mark = (first == t[i]) & (here == key[i])
            i, j = i[mark], j[mark]
            for o, v in zip(out, (np.concatenate((ids[i], ids[j])), np.concatenate((size[j], size[i])), np.concatenate((ids[i], ids[i])))):
                o.append(v)
        found = [np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out]
        some = (found[1] > 0) | (found[0] != found[2])
        return pa.RecordBatch.from_arrays([pa.array(v[some].astype(np.int64)) for v in found], names=["id", "n", "lead"])

    def compared(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in (1, 2, 3, 5, 6)]
            cut = batch.num_rows
            columns = [batch.column(k) for k in (1, 2, 3, 5, 6)]
            while cut and [c[cut - 1].as_py() for c in columns] == last:
                cut -= 1
            held = batch.slice(cut)
            if cut:
                yield batch_links(batch.slice(0, cut))
        if held is not None:
            yield batch_links(held)

    return met.mapInArrow(tidy(compared), "id long, n long, lead long")


def near_vectors(vectors: DataFrame, threshold: float = COSINE, **hashing: int) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared only where labels are equal and not null. Null vectors,
    empty ones, those with null or non-finite components and those of norm 0 link
    with nothing: n_links 0, a component of their own. A null vec_id gets a null
    component and kept false. Equal vectors are one class with a size; they link
    with each other, also repeated rows of one vec_id. Other columns are dropped.
    """
    rows = stage(with_units(vectors), "units")
    can = F.col("unit").isNotNull() & F.col("vec_id").isNotNull()
    classes = stage(rows.filter(can).groupBy("label", "unit").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")), "classes")
    # a class id is the smallest vec_id of its rows; were one vec_id to name several vectors, it would join them
    found = stage(links(classes.groupBy("id", "label", "unit").agg(F.sum("size").alias("size")), threshold, **hashing), "links")
    joined = components(found.select(F.col("id").alias("a"), F.col("lead").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "id", "left").join(joined, "id", "left")
    known = stage(known.select("label", "unit", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "known")
    out = rows.filter(can).join(known, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors() over all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
