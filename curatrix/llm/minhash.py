"""Operator 1: near-duplicate documents by MinHash bands, sequential Bayesian verification and an exact check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, drop, mix, stage, table, tidy, without, word_hashes
from .components import components

#: Words in a shingle and the similarity, in hundredths, of the pipeline and of general use.
SHINGLE = 5
SIMILARITY = 80
#: One bit of each of so many hash functions makes the sketch; bands of all of them are bucket keys, at most MOST functions.
HASHES = 256
MOST = 288
#: A pair is pruned when the posterior probability that it is similar enough falls below this.
MISS = 1e-6
#: Bits of a sketch that are compared at once.
BATCH = 64
#: Bits of the map of wanted ids that workers get; of a fixed size, it only saves work.
WANTED_BITS = 1 << 24
AT_ONCE = 1 << 19
#: Groups of at most so many representatives are compared as joined rows, larger ones in blocks of BLOCK rows or BLOCK_BYTES of sets.
SMALL = 64
BLOCK = 512
BLOCK_BYTES = 32 << 20
_A = (mix(np.arange(1, MOST + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = mix(np.arange(1, MOST + 1, dtype=np.uint64) + np.uint64(1 << 20)).astype(np.uint32)
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, one without words none."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        rolled = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            rolled = mix(rolled * _C1 + hashes[k : k + n])
        out = []
        for end, count in zip(ends.tolist(), counts.tolist()):
            if count >= size:
                out.append(np.unique(rolled[end - count : end - size + 1]))
            elif count:
                one = np.full(1, count, dtype=np.uint64)
                for k in range(count):
                    one = mix(one * _C1 + hashes[end - count + k])
                out.append(one)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def layout(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that a pair at the similarity all misses with probability miss at most."""
    for rows in range(MOST, 0, -1):
        share = similarity**rows
        bands = 1 if share >= 1 else int(np.ceil(np.log(miss) / np.log1p(-share)))
        if bands * rows <= MOST:
            return bands, rows
    return MOST, 1


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """The smallest value of each hash function over each set that isn't empty: (sets, hashes)."""
    flat = np.concatenate(sets)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), hashes), dtype=np.uint32)
    for k in range(hashes):
        y = (x ^ _B[k]) * _A[k]
        y ^= y >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(y * np.uint32(0x85EBCA6B), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mix(keys * _C2 + parts[:, :, r])
    return keys.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit of each minimum, packed into 64-bit words."""
    bits = ((signature[:, :HASHES] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def bounds(similarity: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the most bits that may differ while P(J >= similarity | bits) is still at least miss.

    Bits agree with probability (1 + J) / 2; the prior of J is uniform on [0, 1].
    """
    j = (np.arange(20_000) + 0.5) / 20_000
    agree = np.log((1 + j) / 2), np.log((1 - j) / 2)
    most = []
    for seen in range(batch, hashes + 1, batch):
        differ = 0
        for d in range(seen + 1):
            w = (seen - d) * agree[0] + d * agree[1]
            w = np.exp(w - w.max())
            if w[j >= similarity].sum() / w.sum() >= miss:
                differ = d
            else:
                break
        most.append(differ)
    return most


def similar(a: str, b: str, similarity: int, miss: float = MISS) -> Column:
    """Whether rows with prefixes a and b may be similar: set sizes allow it, and no batch of sketch bits rules it out."""
    low, high = F.least(F.col(a + "n"), F.col(b + "n")), F.greatest(F.col(a + "n"), F.col(b + "n"))
    ok = 100 * low >= similarity * high
    differ: Column = F.lit(0)
    for k, most in enumerate(bounds(similarity / 100, miss)):
        differ = differ + F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}")))
        ok = ok & (differ <= most)
    return ok


def signed(docs: DataFrame, size: int, similarity: int = SIMILARITY, miss: float = MISS) -> DataFrame:
    """doc_id, n (set size), d1, d2 (a digest of the set), s0.. (the sketch), bands. Without words n is 0 and the rest null."""
    import pyarrow as pa

    words = HASHES // BATCH
    count, length = layout(similarity / 100, miss)

    def rows(batches):
        for batch in chunks(batches, AT_ONCE):
            sets = shingle_sets(as_bytes(batch.column(1)), size)
            some = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
            if len(some):
                signature = signatures([sets[k] for k in some], max(HASHES, count * length))
                with np.errstate(over="ignore"):
                    d1 = np.array([mix(sets[k]).sum(dtype=np.uint64) for k in some], dtype=np.uint64).view(np.int64)
                    d2 = np.array([mix(sets[k] * _C3).sum(dtype=np.uint64) for k in some], dtype=np.uint64).view(np.int64)
                sketch, bands = sketches(signature), band_keys(signature, count, length)
            else:
                d1 = d2 = np.zeros(0, dtype=np.int64)
                sketch, bands = np.zeros((0, words), dtype=np.int64), np.zeros((0, count), dtype=np.int64)
            back = np.full(len(sets), -1, dtype=np.int64)
            back[some] = np.arange(len(some))
            take = pa.array(back, mask=back < 0)
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c).take(take) for c in (d1, d2, *np.ascontiguousarray(sketch.T)))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, lists.take(take)], names=["doc_id", "n", "d1", "d2", *(f"s{k}" for k in range(words)), "bands"])

    sketch = ", ".join(f"s{k} long" for k in range(words))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), f"doc_id long, n long, d1 long, d2 long, {sketch}, bands array<long>")


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, set) for the ids (column id): the sorted shingle hashes as bytes, made anew from the texts.

    A map of fixed size tells workers which ids are wanted, so other texts are
    neither hashed nor shuffled; what it lets through by chance joins with nothing.
    """
    import pyarrow as pa

    at = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS))
    bits = ids.select("id").distinct().select(F.floor(at / 64).cast("int").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("k"))
    words = bits.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits")).collect()  # at most WANTED_BITS / 64 rows
    wanted = np.zeros(WANTED_BITS // 64, dtype=np.int64)
    for r in words:
        wanted[r["w"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches):
        bitmap = shared.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            some = pa.array((bitmap[place >> 6] >> (place & 63)) & 1 == 1)
            for part in chunks([batch.filter(some)], AT_ONCE):
                found = [s.astype("<u8").tobytes() for s in shingle_sets(as_bytes(part.column(1)), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["doc_id", "set"])

    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL").withColumn("at", at)
    made = source.mapInArrow(tidy(sets), "doc_id long, set binary")
    # of repeated rows of one id, one is enough
    return stage(made.groupBy("doc_id").agg(F.max("set").alias("set")) if _repeats(docs) else made, "sets")


def verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets are similar enough."""
    import pyarrow as pa

    made = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, size)

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(made.toDF("a", "x"), "a").join(made.toDF("b", "y"), "b").select("a", "b", "x", "y")
    out = stage(joined.mapInArrow(tidy(check), "a long, b long"), "verified")
    drop(made, pairs)
    return out


def block_edges(rows: DataFrame, similarity: int, miss: float) -> DataFrame:
    """Edges (a, b) across components within each group (g, i, j): rows of its left block against those of its right one.

    rows: g, i, j, left, rep, c, n, the sketch and the set. No pair is written:
    for each left row, one linked right row of each other component.
    """
    import pyarrow as pa

    sketch = [f"s{k}" for k in range(HASHES // BATCH)]
    most = bounds(similarity / 100, miss)

    def compare(key, table_):
        left = table_.column("left").to_numpy()
        rep, c, n = (table_.column(k).to_numpy() for k in ("rep", "c", "n"))
        bits = np.stack([table_.column(k).to_numpy() for k in sketch], axis=1).view(np.uint64)
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        ok = c[l][:, None] != c[r][None, :]
        ok &= 100 * np.minimum(n[l][:, None], n[r][None, :]) >= similarity * np.maximum(n[l][:, None], n[r][None, :])
        differ = np.zeros(ok.shape, dtype=np.int64)
        for k, bound in enumerate(most):  # one batch of bits after the other, for as long as a pair is left
            if not ok.any():
                break
            differ += np.bitwise_count(bits[l, k][:, None] ^ bits[r, k][None, :])
            ok &= differ <= bound
        l, r, ok = l[ok.any(axis=1)], r[ok.any(axis=0)], ok[ok.any(axis=1)][:, ok.any(axis=0)]
        a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(l):
            sets = table_.column("set")
            chosen = [np.frombuffer(sets[int(k)].as_buffer(), "<u8") for k in np.concatenate((l, r))]
            owner = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
            unique, at = np.unique(np.concatenate(chosen), return_inverse=True)
            often = np.bincount(at) > 1
            place = np.cumsum(often) - 1
            own, at = owner[often[at]], place[at[often[at]]]
            order = np.argsort(at, kind="stable")
            own, at = own[order], at[order]
            common = np.zeros(ok.shape, dtype=np.float64)
            width = 4096
            for start in range(0, int(often.sum()), width):
                p, q = np.searchsorted(at, [start, start + width])
                x = np.zeros((len(chosen), width), dtype=np.float32)
                x[own[p:q], at[p:q] - start] = 1
                common += x[: len(l)] @ x[len(l) :].T
            ok &= 100 * common >= similarity * (n[l][:, None] + n[r][None, :] - common)
            i, j = np.nonzero(ok)
            _, first = np.unique(np.stack((i, c[r[j]]), axis=1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, dtype=np.int64))
            a, b = rep[l[i[first]]], rep[r[j[first]]]
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long")


def _repeats(docs: DataFrame) -> bool:
    """Whether some id has several rows."""
    return docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def near_documents(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, miss: float = MISS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and cut at ASCII white space; documents are linked
    if 100 * |intersection| >= similarity * |union| of their shingle sets. Null,
    empty and wordless texts have no shingles and link with nothing. A null
    doc_id gets a null component and is kept (nothing tells it from another).
    Repeated rows of one id share its component. Other columns are dropped.

    Documents with equal sets are one class, represented by the smallest id.
    Representatives meet in bands of their signature. First each is compared with
    the smallest of its bucket; what is linked is one component then. Only pairs
    of different components are compared further: small groups as joined rows,
    large ones in blocks, which write no pairs. Every pair passes the sequential
    test on its sketches and then the exact check on full sets.
    """
    sketch = [f"s{k}" for k in range(HASHES // BATCH)]
    sigs = stage(signed(docs, size, similarity, miss), "signatures")
    some = sigs.filter("n > 0 AND doc_id IS NOT NULL")
    best = F.min(F.struct("doc_id", *sketch, "bands")).alias("r")
    reps = stage(some.groupBy("d1", "d2", "n").agg(best).select("d1", "d2", "n", F.col("r.doc_id").alias("rep"), *[f"r.{s}" for s in sketch], "r.bands"), "representatives")
    slim = reps.select("rep", "n", *sketch)
    rows = reps.select("rep", F.explode_outer("bands").alias("bucket"))
    full = stage(rows.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket", "lead"), "full")
    met = stage(rows.join(full, "bucket").select("bucket", "rep", "lead"), "met")
    drop(full)

    def sided(prefix: str, key: str) -> DataFrame:
        return slim.select(F.col("rep").alias(key), F.col("n").alias(prefix + "n"), *[F.col(s).alias(prefix + s) for s in sketch])

    stars = met.filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    stars = stars.join(sided("a_", "a"), "a").join(sided("b_", "b"), "b").filter(similar("a_", "b_", similarity, miss)).select("a", "b")
    edges = verified(stage(stars, "stars"), docs, size, similarity)
    # What may still be linked meets in a bucket; buckets whose leads are one component by now are one group.
    labels = components(edges)
    lead_c = labels.select(F.col("id").alias("lead"), F.col("component").alias("lead_c"))
    placed = met.join(lead_c, "lead", "left").select("rep", F.coalesce("lead_c", "lead").alias("g")).distinct()
    placed = stage(placed.join(labels, placed["rep"] == labels["id"], "left").select("g", "rep", F.coalesce("component", "rep").alias("c")), "placed")
    drop(met)
    groups = placed.join(reps.select("rep", "n"), "rep").groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("bytes"))
    groups = groups.groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda count: F.greatest(F.ceil(count / BLOCK), F.ceil(8 * F.col("bytes") * count / F.col("k") / BLOCK_BYTES)).cast("long")
    groups = stage(groups.select("g", "main", (F.col("k") > SMALL).alias("large"), blocks(F.col("k") - F.col("most")).alias("ni"), blocks(F.col("k")).alias("nj")), "groups")
    wide = stage(placed.join(groups, "g").join(slim, "rep"), "wide")
    drop(placed, groups)
    # Small groups: all pairs of different components, one row each that passes the sketches.
    few = wide.filter("NOT large")
    mine = few.filter("c <> main").select("g", F.col("rep").alias("a"), F.col("c").alias("a_c"), F.col("n").alias("a_n"), *[F.col(s).alias("a_" + s) for s in sketch])
    theirs = few.select("g", F.col("rep").alias("b"), F.col("c").alias("b_c"), (F.col("c") == F.col("main")).alias("b_main"), F.col("n").alias("b_n"), *[F.col(s).alias("b_" + s) for s in sketch])
    across = (F.col("a_c") != F.col("b_c")) & (F.col("b_main") | (F.col("a") < F.col("b"))) & similar("a_", "b_", similarity, miss)
    near = stage(mine.join(theirs, "g").filter(across).select("a", "b").distinct(), "near")
    parts = [edges, verified(near, docs, size, similarity)]
    # Large groups: what isn't of the main component, in blocks, against blocks of all.
    many = stage(wide.filter("large"), "many")
    if many.limit(1).count():
        made = sets_of(many.select(F.col("rep").alias("id")), docs, size)
        full_rows = many.join(made, many["rep"] == made["doc_id"]).select("g", "rep", "c", "main", "n", *sketch, "set", "ni", "nj")
        spread = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
        own = lambda k: F.pmod(F.xxhash64("rep"), F.col(k))
        left = full_rows.filter("c <> main").withColumn("i", own("ni")).withColumn("j", F.explode(spread("nj"))).withColumn("left", F.lit(True))
        right = full_rows.withColumn("j", own("nj")).withColumn("i", F.explode(spread("ni"))).withColumn("left", F.lit(False))
        columns = ["g", "i", "j", "left", "rep", "c", "n", *sketch, "set"]
        parts.append(stage(block_edges(left.select(*columns).unionByName(right.select(*columns)), similarity, miss), "blocks"))
        drop(made)
    drop(wide, many)
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    labels = components(edges)
    known = stage(reps.join(labels, reps["rep"] == labels["id"], "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id")), "known")
    joined = some.select("doc_id", "n", "d1", "d2").join(known, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sigs.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs whose document stays: one of each group of near duplicates, with all columns.

    Rows without an id stay, as do all rows of an id that stays.
    """
    gone = near_documents(docs, size, similarity).filter("NOT kept").select("doc_id")
    return without(docs, [F.col("doc_id").cast("long")], gone)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_documents() over all documents: three words a shingle, similarity 0.85."""
    return near_documents(table(spark, sf_dir, "documents"), size=3, similarity=85)
