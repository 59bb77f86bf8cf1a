"""Nested conversations, answers of several models, and their arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import answer_key
from .reconcile import with_each

HUMAN, MODEL = "human", "gpt"


def nest(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its turns in order as structs (from, value)."""
    who = F.when(F.col(role) == "user", HUMAN).when(F.col(role) == "assistant", MODEL).otherwise(F.col(role))
    turn = F.struct(F.col(order).alias("o"), who.alias("from"), F.col(text).alias("value"))
    ordered = F.array_sort(F.collect_list(turn))
    return turns.groupBy(F.col(key).alias("id")).agg(F.transform(ordered, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


def unnest(nested: DataFrame) -> DataFrame:
    return nested.select("id", F.posexplode("conversations").alias("turn", "t")).select("id", "turn", F.col("t.from").alias("from"), F.col("t.value").alias("value"))


def pruned(column: str, fields: list[str]) -> Column:
    """Only the named fields of each turn."""
    return F.transform(column, lambda t: F.struct(*[t[f].alias(f) for f in fields]))


def human_turns(column: str = "conversations") -> Column:
    return F.filter(column, lambda t: t["from"] == HUMAN)


def first_human(column: str = "conversations") -> Column:
    """The first human turn's text; null without one."""
    return F.get(human_turns(column), 0)["value"]


def map_first_human(column: str, change) -> Column:
    """The turns with the first human one's text changed."""
    place = F.array_position(F.transform(column, lambda t: t["from"]), HUMAN) - 1
    return F.transform(column, lambda t, i: F.struct(t["from"].alias("from"), F.when(i == place, change(t["value"])).otherwise(t["value"]).alias("value")))


def arbitrate(df: DataFrame, judge: str, answers: str, models: str, fallback: int = 2) -> DataFrame:
    """chosen: the models whose answer equals the judge's, else the fallback one; agreeing: how many answers equal it; final: the chosen answer.

    Raises where there are too few candidates for the fallback.
    """
    pairs = F.arrays_zip(F.col(answers).alias("a"), F.col(models).alias("m"))
    same = F.filter(pairs, lambda x: answer_key(x["a"]) == answer_key(F.col(judge)))
    enough = F.when(F.size(answers) > fallback, F.get(models, fallback)).otherwise(F.raise_error(F.lit("too few candidates for the fallback")))
    out = df.withColumn("_same", same).withColumn("agreeing", F.size("_same"))
    chosen = F.when(F.size("_same") > 0, F.transform("_same", lambda x: x["m"])).otherwise(F.array(enough))
    final = F.when(F.size("_same") > 0, F.get("_same", 0)["a"]).otherwise(F.get(answers, fallback))
    return out.withColumn("chosen", chosen).withColumn("final", final).drop("_same")


def chosen_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("chosen").alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def interleave(question: Column, answer: Column) -> Column:
    """Question and answer turns in one list."""
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    return F.array(turn(HUMAN, question), turn(MODEL, answer))


def interleave_all(questions: Column, answers: Column) -> Column:
    return F.flatten(F.zip_with(questions, answers, lambda q, a: interleave(q, a)))


def first_available(candidates: list[DataFrame]) -> DataFrame:
    """The first source that has rows, by priority."""
    for df in candidates:
        if df.limit(1).count():
            return df
    return candidates[-1]


def answer_shares(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """Shares of yes, no and other answers by group, in percent."""
    from ..functions.strings import yes_no_other

    v = yes_no_other(value)
    pct = lambda k: F.round(100 * F.avg((F.col("_v") == k).cast("double")), 4).alias(f"{k}_prop")
    return df.withColumn("_v", v).groupBy(*groups).agg(pct("yes"), pct("no"), pct("other"), F.count(F.lit(1)).alias("total"))


def answer_shares_grid(df: DataFrame, group: str, file: str, value: Column) -> DataFrame:
    """answer_shares for every pair of a group and a file, zeros where there are no answers."""
    shares = answer_shares(df, [group, file], value)
    files = df.select(file).distinct()
    grid = with_each(df.select(group).distinct(), files)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("yes_prop", "no_prop", "other_prop", "total")]
    return grid.join(shares, [group, file], "left").select(group, file, *zero)
