"""Dedup, sampling and allocation, all by ordinals and hashes, never by an engine's own random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import staged


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. One aggregate that combines before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    cols = [c for c in order if c not in keys] + rest
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*df.columns)


def seeded(columns: list[str], seed: int) -> Column:
    """A repeatable pseudo-random key of a row."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed))).cast("binary"))


def running_total(df: DataFrame, order: list[str], amount: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of amount (a whole number) over all rows up to and with each one, so that no task sorts everything.

    Ranges of the order are summed apart and shifted by the sums before them. The
    ranges are written first: their bounds come from a sample that each plan over
    them would draw anew, and sums of other ranges would shift rows wrongly.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = staged(df.withColumn("_amount", amount.cast("long")).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = ranged.groupBy("_part").agg(F.sum("_amount").alias("_sum"))  # a row a partition
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    local = ranged.withColumn("_local", F.sum("_amount").over(upto))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before", "_amount")


def global_rank(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds rank, from 1, over the whole frame."""
    return running_total(df, order, F.lit(1), "rank", parts)


def place_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the place, from 1, in each group (rows without a group are one) and _size, the group's rows; a large group is ranked by many tasks."""
    ranked = global_rank(df, [group, *[c for c in order if c != group]])
    own = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("rank").alias("_base"), F.count(F.lit(1)).alias("_size"))
    return ranked.join(own, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("rank") - F.col("_base") + 1).drop("rank", "_base", "_g")


def full_level(sizes: DataFrame, target: int) -> tuple[int, int]:
    """The highest place that all groups (a row each with _size) can fill within target rows, and the rows then left.

    Each round is one aggregate that tries 64 levels between the bounds known.
    """
    low, high = 0, target + 1  # low fits, high doesn't or is beyond need
    used = 0
    while high - low > 1:
        tries = sorted({low + max(1, (high - low) * k // 65) for k in range(1, 65)} - {high})
        sums = sizes.agg(*[F.sum(F.least("_size", F.lit(t))).alias(f"l{t}") for t in tries]).first()
        fit = [t for t in tries if (sums[f"l{t}"] or 0) <= target]
        beyond = [t for t in tries if (sums[f"l{t}"] or 0) > target]
        if fit:
            low, used = fit[-1], sums[f"l{fit[-1]}"] or 0
        if beyond:
            high = beyond[0]
    return low, target - used


def equitable(df: DataFrame, group: str, order: list[str], group_order: str, target: int) -> DataFrame:
    """Flags target rows, spread over the groups as evenly as their sizes allow.

    The round-robin rule (an equal base for each group, then one more in turn
    where a group has spare rows) takes the first `target` rows by place in the
    group and then by the group's first appearance: all rows up to the level that
    fits, and of the next place those of the first groups. Neither a group nor
    the target is one task's work.
    """
    placed = place_within(df, group, order, "_place")
    groups = staged(placed.groupBy(F.col(group).alias("_g")).agg(F.min(group_order).alias("_first"), F.first("_size").alias("_size")), "groups")
    level, left = full_level(groups.select("_size"), target)
    spare = global_rank(groups.filter(F.col("_size") > level).select("_g", "_first"), ["_first", "_g"]).select(F.col("_g").alias("_s"), F.col("rank").alias("_turn"))
    out = placed.join(spare, F.col(group).eqNullSafe(F.col("_s")), "left")
    taken = (F.col("_place") <= level) | ((F.col("_place") == level + 1) & (F.col("_turn") <= left))
    return out.withColumn("selected", F.coalesce(taken, F.lit(False))).drop("_place", "_size", "_s", "_turn")


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), by hash order."""
    return df.withColumn("_h", seeded(key, seed)).orderBy("_h", *key).limit(n).drop("_h")


def shuffled_within(df: DataFrame, group: str, key: list[str], seed: int = 0) -> DataFrame:
    """Adds place, from 1, in a repeatable random order within each group."""
    return place_within(df.withColumn("_h", seeded([group, *key], seed)), group, ["_h", *key], "place").drop("_h", "_size")


def schedule_counts(n: int, weights: dict[str, float], slack: str | None = None) -> dict[str, int]:
    """Whole numbers that follow the weights and sum to n; what rounding leaves goes to the heaviest in turn, or to the feature named slack, which then has no share of its own."""
    counts = {k: int(round(w * n)) for k, w in weights.items()}
    order = sorted(weights, key=lambda k: -weights[k])
    if slack is not None:
        counts[slack] = max(0, n - sum(c for k, c in counts.items() if k != slack))
    diff = n - sum(counts.values()) if slack is None else 0
    for k in range(abs(diff)):
        counts[order[k % len(order)]] += 1 if diff > 0 else -1
    out, left = {}, n
    for k, c in counts.items():
        out[k] = min(max(0, c), left)
        left -= out[k]
    first = next(iter(out))
    out[first] += left
    return out


def scheduled(df: DataFrame, weights: dict[str, float], key: list[str], seed: int = 0, slack: str | None = None) -> DataFrame:
    """Gives every row a feature so that the shares follow the weights; see schedule_counts."""
    n = df.count()
    ranked = global_rank(df.withColumn("_h", seeded(key, seed)), ["_h", *key]).drop("_h")
    feature, upto = F.lit(None).cast("string"), n
    for name, c in reversed(list(schedule_counts(n, weights, slack).items())):
        feature = F.when(F.col("rank") <= upto, F.lit(name)).otherwise(feature)
        upto -= c
    return ranked.withColumn("feature", feature).drop("rank")


def with_replacement(pool: DataFrame, key: str, k: int, draws: int, seed: int = 0) -> DataFrame:
    """k distinct pool rows by hash order, or all where there are fewer, and for each draw one of them; no draws of an empty pool."""
    chosen = pool.select(key).distinct().orderBy(seeded([key], seed), key).limit(k)
    numbered = chosen.withColumn("_n", F.row_number().over(W.orderBy(seeded([key], seed), key)) - 1)
    hashed = F.conv(F.substring(seeded(["id"], seed), 1, 15), 16, 10).cast("long")
    picks = pool.sparkSession.range(draws).withColumn("_n", F.pmod(hashed, F.lit(max(1, numbered.count()))).cast("int"))
    return picks.join(F.broadcast(numbered), "_n").select(F.col("id").alias("draw"), key)


def alternating(df: DataFrame, accepted: Column, order: list[str], strategies: list[str], n: int) -> DataFrame:
    """The first n accepted rows, with the strategies in turn."""
    ok = df.filter(accepted).orderBy(*order).limit(n)
    rn = F.row_number().over(W.orderBy(*order)) - 1
    return ok.withColumn("strategy", F.get(F.array(*[F.lit(s) for s in strategies]), F.pmod(rn, F.lit(len(strategies)))))
