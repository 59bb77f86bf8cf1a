"""Operator 13: exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stage, table

#: Bits of the run's number that one round takes away: so many runs, 2^4, are merged at once.
FAN_BITS = 4
#: Bits of the digest that cut a merged run into slots beyond those that its round asks for, so that slots spread evenly.
SPREAD_BITS = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # where a character is a byte, all are ASCII and the quicker function does the same
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def merged(entries: DataFrame, run: Column, slot: Column) -> DataFrame:
    """One level: the entries of each run and slot, which come together as one sorted stretch, with equal digests as one.

    Entries are the same only if the whole SHA-256 is; the largest identifier is
    retained and the counts are added up.
    """
    cells = entries.withColumn("run", run).withColumn("slot", slot)
    # grouping by more than the columns it is dealt by needs no further exchange
    dealt = cells.repartition("run", "slot").sortWithinPartitions("run", "slot", "sha")
    return dealt.groupBy("run", "slot", "sha").agg(F.max("best").alias("best"), F.sum("n").alias("n")).drop("slot")


def rounds(bottom: DataFrame, runs: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(sha, best, n) of every text: the entries (run, sha, best, n) of the sorted runs, merged round by round into one.

    A round merges 2^fan_bits neighbouring runs. As in a binomial exchange the
    merged run is cut by as many more bits of the digest, so the number of
    stretches, and with it each task's share, stays as it is; and no stretch gets
    more entries of one text than it merges runs.
    """
    head = F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long")
    top, bits = bottom, 0
    while runs > 1:
        bits += fan_bits
        runs = -(-runs // (1 << fan_bits))
        top = merged(top, F.shiftright("run", fan_bits), F.shiftright(head, 32 - min(32, bits + SPREAD_BITS)))
    return top.select("sha", "best", "n")


def exact_dedup(docs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; further columns of docs are dropped.

    Texts are equal when their SHA-256 is, after lower-casing A-Z only; a null
    text is the empty one. The row with the largest doc_id of equal texts stays;
    a null doc_id counts as the smallest, and of rows with the same doc_id and
    text one stays, the last in the written table. An empty table gives none.

    Texts are read once and only digests move. A run is a part of the written
    digests; its entries are made one for each text before they are exchanged, so
    any number of copies is one entry of a run. Back go the merged entries to the
    runs' entries (a text has one in each run) and those to the run's rows, so
    that neither join meets more rows of a key than there are runs, or rows in a run.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha"))
    rows = stage(rows.withColumn("run", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id()), "digests")
    runs = (rows.agg(F.max("run").alias("m")).collect()[0]["m"] or 0) + 1
    bottom = stage(rows.groupBy("run", "sha").agg(F.max(F.struct("doc_id", "at")).alias("best"), F.count(F.lit(1)).alias("n")), "runs")
    top = rounds(bottom, runs, fan_bits)
    known = bottom.select("run", "sha").join(top, "sha")
    known = stage(known.select("run", "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"), F.col("n").alias("group_size")), "known")
    drop(bottom)
    out = rows.join(known, ["run", "sha"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup() of all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))
