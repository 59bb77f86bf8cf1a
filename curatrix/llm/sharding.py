"""Operator 6: shards by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, table

#: Bytes of text in a shard at most.
LIMIT = 8 << 20
#: Bits of the hash that the directory may use.
BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The buckets (depth, prefix, bytes, n) that rows (h, size) end in: those that fit, below ancestors that don't.

    Sizes are summed once by the longest prefix in use, a few more bits than the
    number of shards asks for, and the sums of all shorter prefixes come from
    those sums. Only if some bucket of that depth is still too large and holds
    different hashes do deeper bits follow, for its rows alone. What is too large
    with one hash only, or at the last bit, stays one bucket.
    """
    total = rows.agg(F.sum("size").alias("s")).collect()[0]["s"] or 0
    done = None
    base, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 5)
    while True:
        fine = stage(rows.groupBy(prefix(F.col("h"), depth).alias("p")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")), "fine")
        levels = fine.select(F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"), "p", "bytes", "n", "lo", "hi")
        levels = levels.withColumn("p", F.expr(f"shiftright(p, {depth} - depth)"))
        sums = stage(levels.groupBy("depth", "p").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "levels")
        ends = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
        parent = sums.filter(~ends).select((F.col("depth") + 1).alias("d"), F.col("p").alias("q"))
        at_top = sums.filter((F.col("depth") == base) & ends) if base == 0 else sums.limit(0)
        below = sums.filter((F.col("depth") > base) & ends).join(parent, (F.col("depth") == F.col("d")) & (F.shiftright("p", 1) == F.col("q"))).drop("d", "q")
        leaves = at_top.unionByName(below)
        done = leaves if done is None else done.unionByName(leaves)
        left = stage(sums.filter((F.col("depth") == depth) & ~ends).select("p", "bytes", "n", "lo", "hi"), "left")
        if not left.limit(1).count():
            break
        if depth == BITS:
            done = done.unionByName(left.select(F.lit(depth).alias("depth"), "p", "bytes", "n", "lo", "hi"))
            break
        rows = rows.join(left.select(F.col("p").alias("q")), prefix(F.col("h"), depth) == F.col("q"), "left_semi")
        base, depth = depth, min(BITS, depth + 8)
    return stage(done.select("depth", F.col("p").alias("prefix"), "bytes", "n"), "directory")


def chained(over: DataFrame, limit: int) -> DataFrame:
    """Adds chain to the rows of buckets that are too large and can't split.

    Each part of the input adds up its own rows, shifted by the sums of the parts
    before it, so one key is no single task's work and its shards are filled from
    part to part. The parts are written first: their numbers then stay, whatever
    executor is lost. Rows larger than half a shard are links of their own.
    """
    half = max(1, limit // 2)
    over = stage(over.withColumn("part", F.spark_partition_id()), "over")
    small = F.when(F.col("size") <= half, F.col("size")).otherwise(0)
    sums = over.groupBy("depth", "prefix", "part").agg(F.sum(small).alias("own"))  # a row a part of such a bucket
    earlier = W.partitionBy("depth", "prefix").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0))).drop("own")
    order = W.partitionBy("depth", "prefix", "part").orderBy("size", "doc_id")
    upto = F.sum(small).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = over.withColumn("upto", upto).withColumn("nth", F.row_number().over(order)).join(before, ["depth", "prefix", "part"])
    link = F.floor(F.greatest(F.lit(0), F.col("before") + F.col("upto") - 1) / half).cast("string")
    alone = F.concat(F.lit("r"), F.col("part").cast("string"), F.lit("-"), F.col("nth").cast("string"))
    return rows.withColumn("chain", F.when(F.col("size") > half, alone).otherwise(link)).drop("part", "upto", "nth", "before")


def shards(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, depth, prefix, chain, shard.

    n_bytes is the size of the text in UTF-8 (null: 0). The shard's name is the
    bits of its prefix, and after a dot the link of its overflow chain, 0 but for
    buckets of a single key that are too large: their rows are chained in parts
    that hold at most limit bytes, or one row that is larger by itself. A null
    key is the empty string's bucket. Repeated rows are sharded as rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"), key_hash(F.col(key)).alias("h"))
    rows = stage(rows, "sizes")
    tree = directory(rows.select("h", "size"), limit)
    deepest = {r["depth"]: r["most"] for r in tree.groupBy("depth").agg(F.max("bytes").alias("most")).collect()}  # at most 61 numbers
    parts = []
    for d in sorted(deepest):
        own = tree.filter(F.col("depth") == d).select("depth", "prefix", "bytes")
        if d:
            parts.append(rows.join(own, prefix(F.col("h"), d) == F.col("prefix")))
        else:  # one shard holds all
            parts.append(rows.select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(own.collect()[0]["bytes"]).cast("long").alias("bytes")))
    placed = parts[0] if parts else rows.limit(0).select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("bytes"))
    for p in parts[1:]:
        placed = placed.unionByName(p)
    fits = placed.filter(F.col("bytes") <= limit).withColumn("chain", F.lit("0"))
    if any(most > limit for most in deepest.values()):
        fits = fits.unionByName(chained(placed.filter(F.col("bytes") > limit), limit))
    name = F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise(F.lit(""))
    return fits.select("doc_id", F.col("size").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "prefix", "chain", F.concat(name, F.lit("."), F.col("chain")).alias("shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards() of all documents by their id."""
    return shards(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "depth", "prefix", "chain", "shard")
