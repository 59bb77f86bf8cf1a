"""Nearest neighbours over bit hashes by Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import staged

#: Hashes of one block of a bucket.
BLOCK = 1 << 14


def distance(a: list[Column], b: list[Column]) -> Column:
    """Bits that differ over all words."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def similarity(d: Column, bits: int) -> Column:
    return 1 - d / F.lit(float(bits))


def sign_bits(vector: Column, size: int, first: int = 1) -> Column:
    """The signs of `size` (at most 63) components, from the first-th on, as one number."""
    return F.aggregate(F.slice(vector, first, size), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))


def nearest_within(queries: DataFrame, base: DataFrame, words: list[str], most: int, bands: int, width: int = 64) -> DataFrame:
    """For each query (qid) the nearest base row (bid, smallest id on ties) at most `most` bits away.

    The low `width` bits of each word are cut into more than `most` bands: two
    hashes that differ in at most `most` bits agree in all but `most` of them, so
    every choice of bands - most bands is an exact join key, and no pair without
    a shared key is made. More bands make longer and more keys. Rows with the
    same hash are compared once. Rows without a hash are near nothing.
    """
    if bands <= most:
        raise ValueError("needs more bands than bits that may differ")
    total = width * len(words)
    cuts = [total * k // bands for k in range(bands + 1)]

    def keyed(df: DataFrame, prefix: str) -> DataFrame:
        bits = F.concat(*[F.right(F.lpad(F.bin(F.col(prefix + w)), 64, "0"), F.lit(width)) for w in words])
        band = [F.substring(bits, cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in range(bands)]
        keys = [F.concat(F.lit(f"{n}:"), *[band[k] for k in chosen]) for n, chosen in enumerate(combinations(range(bands), bands - most))]
        return df.withColumn("_band", F.explode(F.array(*keys)))

    q = queries.select(*[F.col(w).alias("q_" + w) for w in words]).dropna().distinct()
    b = base.groupBy(*[F.col(w).alias("b_" + w) for w in words]).agg(F.min("bid").alias("b_bid")).dropna()
    d = distance([F.col("q_" + w) for w in words], [F.col("b_" + w) for w in words])
    near = keyed(q, "q_").join(keyed(b, "b_"), "_band").withColumn("d", d).filter(F.col("d") <= most)
    best = near.groupBy(*["q_" + w for w in words]).agg(F.min(F.struct("d", "b_bid")).alias("m"))
    same = [F.col(w) == F.col("q_" + w) for w in words]
    return queries.select("qid", *words).join(best, same, "left").select("qid", F.col("m.b_bid").alias("bid"), F.col("m.d").alias("distance"))


def _closest(words: int):
    """Of queries and base rows of one pair of blocks: the nearest base row of each query, the smallest id on ties."""
    def closest(queries: pa.Table, base: pa.Table) -> pa.Table:
        held = ["qx", "qy", *[f"q{k}" for k in range(words)]]
        if not len(queries) or not len(base):
            return queries.select(held).slice(0, 0).append_column("d", pa.array([], pa.int64())).append_column("bid", pa.array([], pa.int64()))
        base = base.sort_by("bid")
        ours = [queries.column(f"q{k}").to_numpy() for k in range(words)]
        theirs = [base.column(f"b{k}").to_numpy() for k in range(words)]
        near, least = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        step = max(1, (1 << 20) // len(base))  # about a million pairs at once
        for at in range(0, len(queries), step):
            rows = slice(at, at + step)
            apart = sum(np.bitwise_count((q[rows, None] ^ b[None, :]).view(np.uint64)).astype(np.uint16) for q, b in zip(ours, theirs))
            near[rows] = apart.argmin(axis=1)  # the first of equals, so the smallest id
            least[rows] = apart[np.arange(len(apart)), near[rows]]
        return queries.select(held).append_column("d", pa.array(least)).append_column("bid", base.column("bid").take(pa.array(near)))

    return closest


def nearest_in_bucket(queries: DataFrame, base: DataFrame, words: list[str], bits: int, block: int = BLOCK) -> DataFrame:
    """The nearest base row (smallest id on ties) of the query's bucket (bx, by); of the eight buckets around it only where its own is empty; nulls if those are too.

    Within a bucket every hash of the queries meets every hash of the base, each
    once however many rows have it. That is quadratic in a bucket's different
    hashes, so a bucket is dealt into blocks of about `block` queries and as many
    base rows by hash, each two blocks meet apart, and no pair is a row.
    """
    at = ["bx", "by", *words]
    distinct = staged(base.groupBy(*at).agg(F.min(F.col("bid").cast("long")).alias("bid")).dropna(subset=at), "hashes")
    own = base.select("bx", "by").distinct().withColumn("_own", F.lit(True))
    q = queries.select(*at).dropna().distinct().join(own, ["bx", "by"], "left")
    around = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    here = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")))
    spread = q.withColumn("_o", F.explode(F.when(F.col("_own"), here).otherwise(around)))
    spread = staged(spread.select(F.col("bx").alias("qx"), F.col("by").alias("qy"), *[F.col(w).cast("long").alias(f"q{k}") for k, w in enumerate(words)], (F.col("bx") + F.col("_o.dx")).cast("long").alias("jx"), (F.col("by") + F.col("_o.dy")).cast("long").alias("jy")), "queries")
    others = distinct.select(F.col("bx").cast("long").alias("kx"), F.col("by").cast("long").alias("ky"), *[F.col(w).cast("long").alias(f"b{k}") for k, w in enumerate(words)], "bid")
    # buckets of either side with their blocks; a bucket is a row
    sizes = lambda df, x, y, n: df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.ceil(F.count(F.lit(1)) / block).alias(n))
    dealt = staged(sizes(spread, "jx", "jy", "q_blocks").join(sizes(others, "kx", "ky", "b_blocks"), ["x", "y"]), "buckets")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q_at = [F.col(f"q{k}") for k in range(len(words))]
    left = spread.join(dealt, (F.col("jx") == F.col("x")) & (F.col("jy") == F.col("y"))).withColumn("i", F.pmod(F.xxhash64("qx", "qy", *q_at), "q_blocks")).withColumn("j", every("b_blocks"))
    left = left.select("jx", "jy", "i", "j", "qx", "qy", *q_at)
    b_blocks = dealt.select(F.col("x").alias("bucket_x"), F.col("y").alias("bucket_y"), F.col("q_blocks").alias("q_n"), F.col("b_blocks").alias("b_n"))
    right = others.join(b_blocks, (F.col("kx") == F.col("bucket_x")) & (F.col("ky") == F.col("bucket_y"))).withColumn("k", every("q_n")).withColumn("l", F.pmod(F.xxhash64("bid"), "b_n"))
    right = right.select("kx", "ky", "k", "l", *[f"b{k}" for k in range(len(words))], "bid")
    schema = T.StructType([*[spread.schema[c] for c in ["qx", "qy", *[f"q{k}" for k in range(len(words))]]], T.StructField("d", T.LongType()), T.StructField("bid", T.LongType())])
    met = left.groupBy("jx", "jy", "i", "j").cogroup(right.groupBy("kx", "ky", "k", "l")).applyInArrow(_closest(len(words)), schema)
    held = ["qx", "qy", *[f"q{k}" for k in range(len(words))]]
    best = met.groupBy(*held).agg(F.min(F.struct("d", "bid")).alias("m"))
    out = queries.select("qid", *at).join(best, [F.col(c) == F.col(h) for c, h in zip(at, held)], "left")
    return out.select("qid", F.col("m.bid").alias("bid"), similarity(F.col("m.d"), bits).alias("similarity"))
