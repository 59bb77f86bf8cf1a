"""Reconciliation of listings, tables and annotations by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch


def keys_of(df: DataFrame, key: Column) -> DataFrame:
    """Distinct keys that aren't null."""
    return df.select(key.alias("key")).filter("key IS NOT NULL").distinct()


def presence_matrix(sources: dict[str, DataFrame]) -> DataFrame:
    """key and a flag for each source (frames with a column key), and all_present. One aggregate of tagged keys instead of full outer joins."""
    tagged = None
    for name, df in sources.items():
        one = df.select("key").filter("key IS NOT NULL").withColumn("_source", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    flags = [F.max((F.col("_source") == n).cast("int")).cast("boolean").alias(f"in_{n}") for n in sources]
    out = tagged.groupBy("key").agg(*flags)
    every = F.lit(True)
    for n in sources:
        every = every & F.col(f"in_{n}")
    return out.withColumn("all_present", every)


def verify(driver: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Every row of the driver (duplicates stay) with a flag for each source that has its key."""
    out = driver
    for n, df in sources.items():
        own = df.select(F.col("key").alias("_k")).distinct().withColumn(f"in_{n}", F.lit(True))
        out = out.join(own, out["key"] == own["_k"], "left").drop("_k").withColumn(f"in_{n}", F.coalesce(f"in_{n}", F.lit(False)))
    every = F.lit(True)
    for n in sources:
        every = every & F.col(f"in_{n}")
    return out.withColumn("all_present", every)


def compare_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """key and status: matched, missing (left only) or extra (right only)."""
    m = presence_matrix({"l": left, "r": right})
    return m.select("key", F.when(F.col("in_l") & F.col("in_r"), "matched").when(F.col("in_l"), "missing").otherwise("extra").alias("status"))


def split_matches(left: DataFrame, right: DataFrame, derived: Column) -> DataFrame:
    """Rows of left (column key) with matched and, where matched, the derived path; duplicates stay."""
    own = right.select(F.col("key").alias("_k")).distinct()
    return left.join(own, left["key"] == own["_k"], "left").withColumn("matched", F.col("_k").isNotNull()).withColumn("path", F.when(F.col("matched"), derived)).drop("_k")


def first_match(left: DataFrame, right: DataFrame, value: str, order: str) -> DataFrame:
    """Left rows with the first right value of their key and how often the key occurs on the right; null if none."""
    own = right.filter("key IS NOT NULL").groupBy(F.col("key").alias("_k")).agg(F.min_by(value, F.struct(order, value)).alias(value), F.count(F.lit(1)).alias("occurs"))
    return left.join(own, left["key"] == own["_k"], "left").drop("_k").withColumn("duplicates", F.coalesce(F.col("occurs") - 1, F.lit(0))).drop("occurs")


def not_found(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of either side that the other one lacks: side, key."""
    a = left.join(right, "key", "left_anti").select(F.lit("left").alias("side"), "key")
    return a.unionByName(right.join(left, "key", "left_anti").select(F.lit("right").alias("side"), "key"))


def one_to_one(source: DataFrame, table: DataFrame) -> DataFrame:
    """Source keys with the reason why they don't match exactly one row, null where they do; keys of the table alone aren't reported."""
    s = source.groupBy("key").agg(F.count(F.lit(1)).alias("n_source"))
    t = table.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("n_table"))
    reason = F.when(F.col("n_source") > 1, "duplicate_in_source").when(F.col("n_table").isNull(), "no_row").when(F.col("n_table") > 1, "several_rows")
    return s.join(t, s["key"] == t["_k"], "left").select("key", "n_source", F.coalesce("n_table", F.lit(0)).alias("n_table"), reason.alias("reason"))


def resolve_assets(wanted: DataFrame, index: DataFrame, preference: list[str]) -> DataFrame:
    """The index path (columns name, stem, ext, path) of each wanted name: the same name, else the same stem by extension order."""
    rank = F.lit(len(preference))
    for k, e in reversed(list(enumerate(preference))):
        rank = F.when(F.lower("ext") == e, k).otherwise(rank)
    exact = index.groupBy(F.col("name").alias("_n")).agg(F.max("path").alias("_exact"))
    by_stem = index.withColumn("_r", rank).groupBy(F.col("stem").alias("_s")).agg(F.min_by("path", F.struct("_r", "path")).alias("_near"))
    out = wanted.join(exact, wanted["name"] == exact["_n"], "left").join(by_stem, wanted["stem"] == by_stem["_s"], "left")
    return out.withColumn("path", F.coalesce("_exact", "_near")).drop("_n", "_s", "_exact", "_near")


def without_prior(df: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Rows whose key no prior sample has; null keys stay."""
    return df.join(prior.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_each(df: DataFrame, values: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row of df with every row of values (one column, distinct).

    values is broadcast only up to `most` rows, counted first; more are dealt into
    blocks that hold about so many, and each row of df meets one block a join key.
    """
    n = values.count()
    if n <= most:
        return df.join(F.broadcast(values))
    blocks = -(-n // most)
    dealt = values.withColumn("_block", F.pmod(F.xxhash64(*values.columns), F.lit(blocks)).cast("int"))
    return df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_block").drop("_block")


def lookup(df: DataFrame, table: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Every row of df with the columns that table has for its key, one row for each at most; nulls where it has none.

    A key that more than one in `share` rows have is broadcast with its row: there are
    fewer than `share` of them, however large the tables. All others are joined by a
    shuffle, where none is hot. Rows with a null key stay and match nothing.
    """
    known = df.filter(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    least = known.count() / share
    hot = scratch.staged(counts.filter(F.col("_rows") > least).join(table, key, "left").drop("_rows").withColumn("_hot", F.lit(True)), "hot")
    marked = known.join(F.broadcast(hot.select(key, "_hot")), key, "left")
    often = marked.filter("_hot").drop("_hot").join(F.broadcast(hot.drop("_hot")), key, "left")
    seldom = marked.filter("_hot IS NULL").drop("_hot").join(table, key, "left")
    return often.unionByName(seldom).unionByName(df.filter(F.col(key).isNull()), allowMissingColumns=True)


def aligned(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question (ann, pos) with each model's answer, the turn 2 * pos + 1 of the same annotation; empty where there is none.

    questions: ann, pos, question. answers: model, ann, turn, value.
    """
    a = answers.select("model", F.col("ann").alias("_a"), F.col("turn").alias("_t"), "value")
    models = answers.select("model").distinct()
    grid = with_each(questions, models)
    hit = (grid["ann"] == a["_a"]) & ((2 * grid["pos"] + 1) == a["_t"]) & (grid["model"] == a["model"])
    return grid.join(a, hit, "left").select(grid["ann"], grid["pos"], grid["model"], "question", F.coalesce("value", F.lit("")).alias("answer"))


def count_reconciliation(parts: dict[str, DataFrame], first: str) -> DataFrame:
    """Counts of each part (frames with a column group) by group of the first part, 0 where missing, and whether they agree."""
    out = parts[first].groupBy("group").agg(F.count(F.lit(1)).alias(f"n_{first}"))
    for n, df in parts.items():
        if n != first:
            own = df.groupBy(F.col("group").alias("_g")).agg(F.count(F.lit(1)).alias(f"n_{n}"))
            out = out.join(own, out["group"] == own["_g"], "left").drop("_g").withColumn(f"n_{n}", F.coalesce(f"n_{n}", F.lit(0)))
    same = F.lit(True)
    for n in parts:
        same = same & (F.col(f"n_{n}") == F.col(f"n_{first}"))
    return out.withColumn("agree", same)


def resolve_suffix(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The known name that equals the wanted one, else the only one that ends with `_` and it; error says why there is none.

    Every suffix of a known name is a key, so the match is an equi-join.
    """
    from ..functions.strings import suffixes

    keys = known.select("name", F.explode(suffixes(F.col("name"))).alias("_s")).filter("_s <> name").groupBy("_s").agg(F.min("name").alias("_only"), F.count_distinct("name").alias("_n"))
    exact = known.select(F.col("name").alias("_e")).distinct()
    out = wanted.join(exact, wanted["tag"] == exact["_e"], "left").join(keys, wanted["tag"] == keys["_s"], "left")
    name = F.coalesce("_e", F.when(F.col("_n") == 1, F.col("_only")))
    return out.select("tag", name.alias("name"), F.when(name.isNull(), F.when(F.col("_n") > 1, "ambiguous").otherwise("missing")).alias("error"))


def ranked_siblings(files: DataFrame, others: DataFrame, folders: list[str]) -> DataFrame:
    """For each file (stem) the sibling path of the same stem in the best-ranked folder; others: stem, folder, path."""
    rank = F.lit(len(folders))
    for k, f in reversed(list(enumerate(folders))):
        rank = F.when(F.col("folder") == f, k).otherwise(rank)
    own = others.withColumn("_r", rank).groupBy(F.col("stem").alias("_s")).agg(F.min_by("path", F.struct("_r", "path")).alias("sibling"))
    return files.join(own, files["stem"] == own["_s"], "left").drop("_s")


def cardinality(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """total, matched and missing rows of df by the key's presence in other."""
    own = other.select(F.col(key).alias("_k")).filter("_k IS NOT NULL").distinct()
    j = df.join(own, df[key] == own["_k"], "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("_k").alias("matched"), F.count_if(F.col("_k").isNull()).alias("missing"))


def report(df: DataFrame, order: list[str], n: int = 10) -> tuple[DataFrame, DataFrame]:
    """How many rows there are, and the first n of them."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("truncated", F.col("total") > n), df.orderBy(*order).limit(n)


def numbered(df: DataFrame, partition: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Places from 0 within each partition."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1)
