"""Sliding windows of flags with voting rules, from run-length states that merge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: The rules by which a window's flags vote. Their exact meaning is our own choice.
RULES = ("one", "two", "majority", "all", "two-consecutive", "three-consecutive")
#: Rows of which one state is made at once, as a power of two.
CHUNK_BITS = 12
_STATE = ("n", "yes", "first", "last", "best")


def _state(n: Column, yes: Column, first: Column, last: Column, best: Column) -> Column:
    return F.struct(*[c.cast("long").alias(k) for k, c in zip(_STATE, (n, yes, first, last, best))])


def merged(a: Column, b: Column) -> Column:
    """The run-length state of flags a followed by flags b.

    A state is the number of flags, of true ones, and the length of the run of true
    ones at its start, at its end, and of the longest. Merging is associative, the
    empty state is neutral, so states are made of parts and put together in order.
    """
    return _state(
        a["n"] + b["n"],
        a["yes"] + b["yes"],
        F.when(a["first"] < a["n"], a["first"]).otherwise(a["n"] + b["first"]),
        F.when(b["last"] < b["n"], b["last"]).otherwise(b["n"] + a["last"]),
        F.greatest(a["best"], b["best"], a["last"] + b["first"]),
    )


def all_merged(states: Column) -> Column:
    """The state of an array of states in order."""
    none = _state(*[F.lit(0)] * 5)
    return F.aggregate(states, none, merged)


def of_flags(flags: Column) -> Column:
    """The state of an array of flags in order; a null flag counts as false."""

    def one(x):
        x = F.coalesce(x, F.lit(False)).cast("long")
        return _state(F.lit(1), x, x, x, x)

    return all_merged(F.transform(flags, one))


def vote(state: Column, rule: str) -> Column:
    """Whether the flags of a state meet a rule."""
    return {
        "one": state["yes"] >= 1,
        "two": state["yes"] >= 2,
        "majority": 2 * state["yes"] > state["n"],
        "all": (state["yes"] == state["n"]) & (state["n"] > 0),
        "two-consecutive": state["best"] >= 2,
        "three-consecutive": state["best"] >= 3,
    }[rule]


def _in_order(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, state: the states of a key's rows merged in their order; each key's rows are bounded by the caller."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(held, lambda x: x["v"]).alias("vs"))


def slices(rows: DataFrame, place: Column, flag: Column, order: list[str], chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(slice, state): the run-length state of each slice's flags, taken by `order`.

    Rows are dealt by ranges of that order and written, so a slice may hold any
    number of them: each stretch of at most 2^chunk_bits rows becomes one state,
    and a slice's states, one for each stretch, are merged in their order.
    """
    named = rows.select(place.cast("long").alias("slice"), flag.alias("flag"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]).withColumn("_place", F.monotonically_increasing_id())
    by = ["slice", *[f"_o{k}" for k in range(len(order))], "_place"]
    dealt = scratch.staged(named.repartitionByRange(*by).sortWithinPartitions(*by).select("slice", "flag", F.monotonically_increasing_id().alias("at")), "flags")
    chunks = _in_order(dealt.withColumn("chunk", F.shiftright("at", chunk_bits)), ["slice", "chunk"], "at", "flag")
    chunks = chunks.select("slice", "chunk", of_flags(F.col("vs")).alias("state"))
    return _in_order(chunks, ["slice"], "chunk", "state").select("slice", all_merged(F.col("vs")).alias("state"))


def starts_over(place: Column, size: Column, step: Column) -> Column:
    """The starts, multiples of step, of the windows of `size` slices that hold a slice; step may be larger than size."""
    first, last = F.ceil((place - size + 1) / step), F.floor(place / step)
    return F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), lambda k: (k * step).cast("long"))


def sliding_states(parts: DataFrame, size: int, step: int = 1) -> DataFrame:
    """(start, state) of each window of `size` slices, one every `step` of them, that holds any row.

    A slice is computed once and only its state, five numbers, is repeated.
    """
    over = parts.select(F.explode(starts_over(F.col("slice"), F.lit(size), F.lit(step))).alias("start"), "slice", "state")
    return _in_order(over, ["start"], "slice", "state").select("start", all_merged(F.col("vs")).alias("state"))


def sliding_votes(rows: DataFrame, seconds: Column, flag: Column, order: list[str], size: int, step: int, rules: tuple[str, ...] = RULES) -> DataFrame:
    """For each window of `size` seconds, one every `step`, its start in seconds and a column for each rule.

    A slice is as long as the largest number of seconds that divides both. Rows
    with a null time are in no window; null flags are false.
    """
    unit = math.gcd(size, step)
    parts = slices(rows.filter(seconds.isNotNull()), F.floor(seconds / unit), flag, order)
    found = sliding_states(parts, size // unit, step // unit)
    return found.select((F.col("start") * unit).alias("start"), *[vote(F.col("state"), r).alias(r.replace("-", "_")) for r in rules])


def f_score(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """The F score of a flag against another; null where neither is ever true."""
    tp, fp, fn = F.count_if(F.col(predicted) & F.col(truth)), F.count_if(F.col(predicted) & ~F.col(truth)), F.count_if(~F.col(predicted) & F.col(truth))
    return df.agg(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f_score"))


def allowed(rule: Column, size: Column) -> Column:
    """Windows of one slice vote by one only, those of two not by three-consecutive."""
    return F.when(size == 1, rule == "one").when(size == 2, rule != "three-consecutive").otherwise(F.lit(True))


def swept(rows: DataFrame, seconds: Column, predicted: Column, truth: Column, order: list[str], sizes: list[int]) -> DataFrame:
    """(predicted_rule, truth_rule, size, step, f_score) of every window length, step up to it and two rules, but the pruned ones.

    The rows are cut into slices of one second once; all windows come from their
    states. Rows with a null time are in no window; null flags are false.
    """
    both = F.struct(predicted.alias("p"), truth.alias("t"))
    seen = rows.filter(seconds.isNotNull()).select(F.floor(seconds).cast("long").alias("sec"), both.alias("b"), *order)
    base = None
    for kind in ("p", "t"):
        part = slices(seen, F.col("sec"), F.col("b")[kind], order).withColumnRenamed("state", kind)
        base = part if base is None else base.join(part, "slice")
    grid = F.array(*[F.struct(F.lit(size).cast("long").alias("size"), F.lit(step).cast("long").alias("step")) for size in sizes for step in range(1, size + 1)])
    over = base.select("slice", "p", "t", F.explode(grid).alias("g")).select("slice", "p", "t", "g.size", "g.step")
    over = over.withColumn("start", F.explode(starts_over(F.col("slice"), F.col("size"), F.col("step"))))
    held = F.array_sort(F.collect_list(F.struct("slice", "p", "t")))
    windows = over.groupBy("size", "step", "start").agg(held.alias("vs"))
    windows = windows.select("size", "step", *[all_merged(F.col("vs")[k]).alias(k) for k in ("p", "t")])
    rules = lambda state: F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), vote(F.col(state), r).alias("v")) for r in RULES]), lambda x: allowed(x["rule"], F.col("size")))
    voted = windows.select("size", "step", F.explode(rules("p")).alias("a"), "t").select("size", "step", "a", F.explode(rules("t")).alias("b"))
    a, b = F.col("a.v"), F.col("b.v")
    tp, wrong = F.count_if(a & b), F.count_if(a != b)
    return voted.groupBy(F.col("a.rule").alias("predicted_rule"), F.col("b.rule").alias("truth_rule"), "size", "step").agg(F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).alias("f_score"))
