"""Writers: files through Spark's commit protocol, manifests to append to, and what a resumed run still has to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def to_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def to_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """Adds rows; each write is committed as a whole."""
    df.write.mode("append").json(path)


def json_array_text(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with all records as a JSON list. For small outputs: the list is one value; to_json_array has no such bound."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r"))))
    return df.agg(F.to_json(F.transform(rows, lambda x: x["r"])).alias("value"))


def to_json_array(df: DataFrame, order: list[str], path: str) -> None:
    """All records as one JSON list of any size: a folder of part files that, one after the other by name, are the list.

    Each record is a line, opened by a bracket (the first) or a comma; the last file
    closes the list. The sort deals rows in ranges, so no task holds the list, and ties
    of a hot key are dealt by their place in the input. A folder appears whole or not at
    all: it is written beside its path and moved there at the end; an existing one is
    an error. Nulls are written out.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.writing"
    scratch.remove(spark, beside)
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    ranked = df.select(record.alias("_record"), F.struct(*order).alias("_order"), F.monotonically_increasing_id().alias("_place")).orderBy("_order", "_place")
    # A range's bound is one of the rows, so the first range is never empty, and its first row has the number 0.
    opening = F.when(F.monotonically_increasing_id() == 0, "[").otherwise(",")
    try:
        ranked.select(F.concat(opening, "_record").alias("value")).write.text(beside)
        some = spark.read.text(beside).limit(1).count()
        scratch.put(spark, f"{beside}/part-z-close.txt", "]\n" if some else "[]\n")
        scratch.rename(spark, beside, path)
    except BaseException:
        scratch.remove(spark, beside)
        raise


def still_to_do(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows that the manifest doesn't have."""
    return df.join(manifest.select(key).distinct(), key, "left_anti")


def split_write(df: DataFrame, flag: str, selected: str, rest: str, mode: str = "errorifexists") -> None:
    """Flagged rows to one place, the others to another."""
    df.filter(F.col(flag)).drop(flag).write.mode(mode).parquet(selected)
    df.filter(~F.col(flag)).drop(flag).write.mode(mode).parquet(rest)


def copy_plan(df: DataFrame, path: str, folder: str) -> DataFrame:
    """src and dst of files to copy; two sources never share a destination."""
    name = F.substring_index(path, "/", -1)
    return df.select(F.col(path).alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("dst")).groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")


def attribution(df: DataFrame, name: str, link: str, date: str) -> DataFrame:
    """A line of credit for each row."""
    return df.withColumn("credit", F.concat_ws(" | ", F.col(name), F.col(link), F.concat(F.lit("retrieved "), F.col(date))))


def per_file(df: DataFrame, path: str, column: str = "source_file", mode: str = "errorifexists") -> None:
    """Writes each source file's rows into a folder of its own."""
    df.write.mode(mode).partitionBy(column).option("header", True).csv(path)


def commit_if(df: DataFrame, path: str, valid: Callable[[DataFrame], bool]) -> bool:
    """Writes beside the path, holds what was written against valid, and only then moves it there; what isn't valid is deleted."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.writing"
    scratch.remove(spark, beside)
    df.write.parquet(beside)
    if valid(spark.read.schema(df.schema).parquet(beside)):
        scratch.rename(spark, beside, path)
        return True
    scratch.remove(spark, beside)
    return False


def in_batches(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, batches: int) -> None:
    """Does the work in so many batches by the key's hash, each appended to the manifest when done; a run that was stopped goes on where it was."""
    spark = df.sparkSession
    for k in range(batches):
        part = df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        done = work(part).limit(0)
        try:
            done = spark.read.schema(done.schema).json(path)
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        append_manifest(work(still_to_do(part, done, key)), path)
