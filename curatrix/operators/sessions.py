"""Sessions of files: names that share a `_` suffix, found over a whole table of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .reconcile import lookup

MARK = "_"


def tail(name: str, k: str) -> Column:
    """The last k tokens of a name, the whole name where it has no more."""
    return F.expr(f"substring_index({name}, '{MARK}', -{k})")


def spread(names: DataFrame) -> DataFrame:
    """name, k, suffix: every suffix of every name, one row at a time."""
    every = names.select("name", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    return every.withColumn("suffix", tail("name", "k"))


def shared(names: DataFrame) -> DataFrame:
    """k, suffix: for each set of two names or more that some suffix has in common, the longest such suffix.

    The names under a suffix are among those under a shorter one, so suffixes with the
    same least name and the same count of names have the same names.
    """
    sets = spread(names).groupBy("k", "suffix").agg(F.count(F.lit(1)).alias("m"), F.min("name").alias("first")).filter("m >= 2")
    return sets.groupBy("first", "m").agg(F.max(F.struct("k", "suffix")).alias("s")).select("s.*")


def taken(names: DataFrame) -> DataFrame:
    """suffix: those that open a session.

    Longest first, a suffix opens one where two names or more are still free; it takes
    them all. So at most one name of a suffix stays free for the next shorter one, and
    suffixes of one length share no name: a length is one aggregate over the names
    that arrive with it and the free ones. Only lengths at which a set of names first
    shares a suffix are visited; the driver gets these numbers and no name.
    """
    spark = names.sparkSession
    lengths = sorted((r["k"] for r in shared(names).select("k").distinct().collect()), reverse=True)
    opened, free, above = [], None, None
    for k in lengths:
        arriving = names.filter(F.col("n") >= k).select("name") if above is None else names.filter(F.col("n").between(k, above - 1)).select("name")
        here = arriving if free is None else arriving.unionByName(free)
        met = scratch.staged(here.groupBy(tail("name", str(k)).alias("suffix")).agg(F.count(F.lit(1)).alias("m"), F.min("name").alias("name")), "sessions")
        opened.append(met.filter("m >= 2").select("suffix"))
        free, above = met.filter("m = 1").select("name"), k
    out = spark.createDataFrame([], "suffix string")
    for part in opened:
        out = out.unionByName(part)
    return out


def sessions(files: DataFrame, name: str = "name") -> DataFrame:
    """files with a column session: the suffix of the session that each file's name belongs to.

    Suffixes compete by their count of tokens, longest first; each takes the files whose
    names have it and that none has taken, if they have two different names or more.
    A name that none takes is a session of its own. Suffixes as long never share a
    name, so no rule between them is needed. A null name has the session null, repeated
    names stay together, empty names and empty tokens are names and tokens like others.
    A column session that files have already is replaced.
    """
    named = files.filter(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    names = scratch.staged(named.withColumn("n", F.size(F.split("name", MARK, -1))), "names")
    open_ = scratch.staged(taken(names).withColumn("k", F.size(F.split("suffix", MARK, -1))), "opened")
    mine = lookup(spread(names).select("name", "suffix"), open_, "suffix").groupBy("name").agg(F.max(F.struct("k", "suffix")).alias("best"))
    own = mine.select(F.col("name").alias(name), F.when(F.col("best.k").isNotNull(), F.col("best.suffix")).otherwise(F.col("name")).alias("session"))
    return lookup(files.drop("session"), scratch.staged(own, "assigned"), name)
