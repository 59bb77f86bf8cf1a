"""Operator 4: quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

SPACE = r"[\x20\x09-\x0D]"
#: Fewest and most buckets of the hashed words and word pairs, powers of two. They grow with the trusted documents,
#: BUCKETS_A_DOCUMENT for each: with too few, rare words share buckets with clean ones, and with too many the
#: one count that smooths each bucket outweighs what was counted.
BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 20
BUCKETS_A_DOCUMENT = 40
#: A document is kept if its log-likelihood ratio, in nats a feature, is at least this.
THRESHOLD = -0.1
#: Neutral features that are added to each text's own, so that a few odd words don't condemn a short text.
NEUTRAL = 20
#: Windows of so many words count as repeated passages.
WINDOW = 5


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _words, the words of the text (null: none), _hashes, their 64-bit hashes, and _pairs, those of each word and its successor (the last one's is the end)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(text, SPACE + "+"), "")).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return df.withColumn("_pairs", F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1))))


def bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def _id_bits(ids: DataFrame) -> DataFrame:
    """_word, _bits: the ids of a table of longs (_id) as bits, 64 a row, written so that Spark knows the table's size.

    Ids close to each other make it small enough to be sent to all tasks; where they
    lie too far apart for that, Spark joins it by shuffles.
    """
    bit = F.expr("shiftleft(1L, CAST(_id & 63 AS INT))")
    return stage(ids.groupBy(F.shiftright("_id", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "trusted")


def log_ratios(docs: DataFrame, labels: DataFrame | None, buckets: int | None = None) -> np.ndarray:
    """log p_target(bucket) / p_raw(bucket) for each bucket.

    The raw multinomial counts every document, the target multinomial every trusted
    one, labelled quality 1. Both are smoothed by one count a bucket. Without any
    trusted document all ratios are 0.
    """
    found = 0
    base = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    target = F.lit(None).cast("int")
    if labels is not None:
        good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct()
        found = good.count()
        base = base.join(_id_bits(good), F.shiftright("_doc", 6) == F.col("_word"), "left")
        target = F.when(F.getbit("_bits", F.expr("CAST(_doc & 63 AS INT)")) == 1, 1)
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, BUCKETS_A_DOCUMENT * found - 1).bit_length()))
    base = base.select("text", target.alias("_target"))
    # explode_outer, as from explode the optimizer infers a filter and copies the whole expression into it
    counted = with_words(base).select("_target", F.explode_outer(F.concat("_hashes", "_pairs")).alias("h")).filter("h IS NOT NULL").groupBy(bucket(F.col("h"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.count("_target").alias("target")).toArrow()  # at most one row a bucket
    raw, target = np.ones(buckets), np.ones(buckets)
    at = counted.column("b").to_numpy()
    raw[at] += counted.column("raw").to_numpy()
    target[at] += counted.column("target").to_numpy()
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.round(np.log(target / target.sum()) - np.log(raw / raw.sum()), 3)


def _one_row(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    import pyarrow as pa

    row = pa.ListArray.from_arrays(pa.array([0, len(ratios)], pa.int32()), pa.array(ratios, pa.float64()))
    return docs.sparkSession.createDataFrame(pa.table({"ratios": row}))


def with_verdict(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Adds to every row n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    Null and empty texts have no words and fail. llr is the mean over the words
    and word pairs of the whole text and NEUTRAL zeros (null without any). Rows stand alone:
    repeated rows get the same verdict, and no shuffle is needed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = with_words(docs)
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # a window of five words is two pairs and a word
    five = F.transform("_pairs", lambda p, i: F.xxhash64(p, F.get("_pairs", i + 2), F.get("_hashes", i + 4)))
    df = df.withColumn("_win", F.slice(five, F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))))
    # Few texts repeat a window; only those sort their windows with their places.
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    df = df.withColumn("_placed", F.when(repeats, F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get("_placed", k - 1)["h"], F.get("_placed", k + 1)["h"]
        return (before.isNotNull() & (before == x["h"])) | (after.isNotNull() & (after == x["h"]))

    df = df.withColumn("_at", F.array_sort(F.transform(F.filter("_placed", twice), lambda x: x["i"])))
    covers = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # The ratios are a table of one row, read once as a subquery, as a literal would stand in every plan's text. A subquery
    # may not be written inside a lambda; the optimizer puts it there, as the column is used once, so no row holds a copy.
    df = df.withColumn("_ratios", _one_row(docs, ratios).scalar())
    total = F.aggregate(F.concat("_hashes", "_pairs"), F.lit(0.0), lambda a, h: a + F.get("_ratios", bucket(h, len(ratios))))
    df = df.withColumn("llr", F.when(F.size("_hashes") > 0, total / (2 * F.size("_hashes") + NEUTRAL))).drop("_ratios")
    df = df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
    return df.drop("_words", "_hashes", "_pairs", "_lines", "_win", "_placed", "_at")


def _clear(docs: DataFrame) -> DataFrame:
    """Only the id and the text, so that no column of the input can clash with a computed one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quality_rules(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its figures and verdict; see with_verdict. Other columns are dropped.

    The figures are written into the shared folder and read again: the optimizer
    pushes a filter on a figure below the projections and copies their nested
    expressions into one another, so what is filtered must be a table.
    """
    docs = _clear(docs)
    return stage(with_verdict(docs, log_ratios(docs, labels), threshold).drop("text"), "figures")


def keep(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Each row is judged for itself: repeated rows alike, rows without an id or a
    text too (a null text has no words and goes).
    """
    ratios = log_ratios(_clear(docs), labels)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = with_verdict(docs.select(whole.alias("_row"), F.col("text").cast("string").alias("text")), ratios, threshold)
    # The filter reads an id of the row as well, so that it can't be pushed down and copied into every projection below.
    judged = judged.select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    return judged.filter("kept AND _n >= 0").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules() over all documents."""
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
