"""Queries of sources and sinks: each writes files from the tables into the shared folder and reads them with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout
from ..sources import readers, scratch, writers
from .catalog import query, read

REGION = "r_regionkey int, r_name string"


def region(spark, d):
    return read(spark, d, "region").select("r_regionkey", "r_name")


def nation(spark, d):
    return read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def lines(spark, name, *parts):
    """One text file of the values of parts, each a frame with the columns o (order) and value; fixtures of a few rows."""
    path = scratch.folder(spark, name)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every.repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return path


def line(spark, o, value):
    return spark.range(1).select(F.lit(o).cast("double").alias("o"), F.lit(value).alias("value"))


def json_lines(df, order):
    return df.select(F.col(order).cast("double").alias("o"), F.to_json(F.struct(*df.columns)).alias("value"))


def array_file(spark, df, order):
    path = scratch.folder(spark, "array")
    writers.json_array_text(df, [order]).coalesce(1).write.text(path)
    return path


@query("S1_csv_inferred", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1(spark, d):
    path = scratch.folder(spark, "csv")
    writers.to_csv(nation(spark, d), path)
    return readers.csv_inferred(spark, path)


@query("S2_csv_strings", "SELECT n_nationkey::VARCHAR AS k, n_name AS n FROM nation")
def s2(spark, d):
    rows = nation(spark, d).select(F.col("n_nationkey").cast("double").alias("o"), F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    return readers.csv_strings(spark, lines(spark, "bom", line(spark, -1, "﻿k,n"), rows))


@query("S3_csv_any_encoding", "SELECT r_name || 'é' AS name FROM region UNION ALL SELECT r_name || 'ü' FROM region")
def s3(spark, d):
    latin, utf = scratch.folder(spark, "latin"), scratch.folder(spark, "utf")
    region(spark, d).select(F.concat("r_name", F.lit("é")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(latin)
    region(spark, d).select(F.concat("r_name", F.lit("ü")).alias("name")).write.option("header", True).csv(utf)
    return readers.csv_any_encoding(spark, latin).unionByName(readers.csv_any_encoding(spark, utf))


@query("S4_csv_safe", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0")
def s4(spark, d):
    path = scratch.folder(spark, "safe")
    here = F.col("n_nationkey") % 5 != 0
    nation(spark, d).select(*[F.when(here, F.col(c)).alias(c) for c in ("n_nationkey", "n_name")], F.lit(None).cast("string").alias("nothing")).write.option("header", True).csv(path)
    return readers.csv_safe(spark, path)


@query("S5_json_array", "SELECT r_regionkey, r_name FROM region")
def s5(spark, d):
    return readers.json_array(spark, array_file(spark, region(spark, d), "r_regionkey"), region(spark, d).schema)


@query("S6_jsonl", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s6(spark, d):
    src = nation(spark, d)
    return readers.jsonl(spark, lines(spark, "jsonl", json_lines(src, "n_nationkey"), line(spark, 1.5, "not json"), line(spark, 2.5, ""), line(spark, 3.5, '{"n_nationkey": 1')), src.schema)


@query("S7_json_or_jsonl", "SELECT r_name AS name, 'array' AS kind FROM region UNION ALL SELECT r_name, 'lines' FROM region")
def s7(spark, d):
    src = region(spark, d)
    a = readers.json_or_jsonl(spark, array_file(spark, src, "r_regionkey"), src.schema)
    b = readers.json_or_jsonl(spark, lines(spark, "lines", line(spark, -1, "  "), json_lines(src, "r_regionkey")), src.schema)
    return a.select(F.col("r_name").alias("name"), F.lit("array").alias("kind")).unionByName(b.select(F.col("r_name").alias("name"), F.lit("lines").alias("kind")))


@query("S8_jsonl_or_raw", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS value FROM region UNION ALL SELECT '\"r_name\" is no JSON' UNION ALL SELECT ''")
def s8(spark, d):
    path = lines(spark, "raw", json_lines(region(spark, d), "r_regionkey"), line(spark, 1.5, '"r_name" is no JSON'), line(spark, 2.5, ""))
    return readers.jsonl_or_raw(spark, path, lambda v: F.replace(v, F.lit('"r_name"'), F.lit('"name"')))


@query("S9_json_union", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def s9(spark, d):
    src = region(spark, d)
    paths = [array_file(spark, src, "r_regionkey"), lines(spark, "object", json_lines(src.filter("r_regionkey = 2"), "r_regionkey"))]
    return readers.json_union(spark, paths, src.schema).select("r_regionkey", "r_name")


@query("S10_csv_positional_union", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey::VARCHAR, r_name FROM region")
def s10(spark, d):
    a, b = scratch.folder(spark, "first"), scratch.folder(spark, "second")
    writers.to_csv(nation(spark, d).select("n_nationkey", "n_name"), a)
    writers.to_csv(region(spark, d).withColumn("more", F.lit("x")), b)
    return readers.csv_positional_union(spark, [a, b])


@query("S12_listing", "SELECT n_regionkey::VARCHAR AS region, '.csv' AS ext FROM nation GROUP BY 1")
def s12(spark, d):
    path = scratch.folder(spark, "tree")
    nation(spark, d).coalesce(1).write.partitionBy("n_regionkey").csv(f"{path}/a")
    nation(spark, d).coalesce(1).write.json(f"{path}/b")
    return readers.listing(spark, path, "*.csv").select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).alias("region"), "ext")


@query("S13_annotation_files", "SELECT n_regionkey::VARCHAR AS name FROM nation GROUP BY 1 UNION ALL SELECT 'z.json'")
def s13(spark, d):
    path = scratch.folder(spark, "annotations")
    nation(spark, d).coalesce(1).write.partitionBy("n_regionkey").json(path)
    nation(spark, d).coalesce(1).write.partitionBy("n_regionkey").csv(f"{path}/other")
    found = readers.annotation_files(spark, [path, path], ["z.json", "z.json"], recursive=True)
    return found.select(F.when(F.col("path") == "z.json", F.col("path")).otherwise(F.regexp_extract("path", r"n_regionkey=(\d+)", 1)).alias("name"))


@query("S17_per_file", "SELECT n_nationkey, upper(n_name) AS n_name, 'f' || n_regionkey AS source_file FROM nation")
def s17(spark, d):
    a, b = scratch.folder(spark, "before"), scratch.folder(spark, "after")
    writers.per_file(nation(spark, d).select("n_nationkey", "n_name", F.concat(F.lit("f"), F.col("n_regionkey")).alias("source_file")), a)
    whole = spark.read.option("header", True).schema("n_nationkey int, n_name string, source_file string").csv(a)
    writers.per_file(whole.withColumn("n_name", F.upper("n_name")), b)
    return spark.read.option("header", True).schema("n_nationkey int, n_name string, source_file string").csv(b)


@query("S19_sitemap", "SELECT 'http://x/' || n_name AS url, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS pos FROM nation")
def s19(spark, d):
    one = F.concat(F.lit("<url><loc> http://x/"), "n_name", F.lit(" </loc></url>"))
    rows = nation(spark, d).select(F.col("n_nationkey").cast("double").alias("o"), one.alias("value"))
    again = nation(spark, d).filter("n_nationkey = 3").select(F.lit(99.0).alias("o"), one.alias("value"))
    return readers.sitemap(spark, lines(spark, "sitemap", line(spark, -1, "<urlset>"), rows, again, line(spark, 100, "</urlset>")))


@query("S21_key_values", "SELECT n_name AS key, n_nationkey || '=' || n_regionkey AS value FROM nation")
def s21(spark, d):
    rows = nation(spark, d).select(F.col("n_nationkey").cast("double").alias("o"), F.concat(F.lit(" "), "n_name", F.lit(" = "), "n_nationkey", F.lit("="), "n_regionkey").alias("value"))
    return readers.key_values(spark, lines(spark, "settings", line(spark, -1, "# a=b"), line(spark, 1.5, ""), line(spark, 2.5, "no sign"), rows))


@query("K1_csv", "SELECT c_custkey, c_mktsegment FROM customer")
def k1(spark, d):
    path = scratch.folder(spark, "out")
    writers.to_csv(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    return spark.read.option("header", True).schema("c_custkey long, c_mktsegment string").csv(path)


@query("K3_jsonl", "SELECT c_custkey, c_mktsegment FROM customer")
def k3(spark, d):
    path = scratch.folder(spark, "out")
    src = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    writers.to_jsonl(src, path)
    return readers.jsonl(spark, path, src.schema)


@query("K4_append_manifest", "SELECT doc_id FROM documents")
def k4(spark, d):
    path, docs = scratch.folder(spark, "manifest"), read(spark, d, "documents").select("doc_id")
    writers.append_manifest(docs.filter("doc_id % 2 = 0"), path)
    writers.append_manifest(docs.filter("doc_id % 2 <> 0 OR doc_id IS NULL"), path)
    return spark.read.schema("doc_id long").json(path)


@query("K5_commit_if", "SELECT r_regionkey, r_name FROM region")
def k5(spark, d):
    path, src = scratch.folder(spark, "sample"), region(spark, d)
    bad = writers.commit_if(src.withColumn("r_name", F.lit(None).cast("string")), path, lambda df: df.filter("r_name IS NULL").limit(1).count() == 0)
    good = writers.commit_if(src, path, lambda df: df.filter("r_name IS NULL").limit(1).count() == 0)
    if bad or not good:
        raise AssertionError("only the valid write may be committed")
    return spark.read.schema(REGION).parquet(path)


@query("K7_split_write", "SELECT doc_id, quality = 1 AS selected FROM labels WHERE quality IS NOT NULL")
def k7(spark, d):
    a, b = scratch.folder(spark, "selected"), scratch.folder(spark, "rest")
    writers.split_write(read(spark, d, "labels").filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("flag")), "flag", a, b)
    there = lambda p, v: spark.read.schema("doc_id long").parquet(p).withColumn("selected", F.lit(v))
    return there(a, True).unionByName(there(b, False))


@query("K9_array_of_manifest", "SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS value FROM region")
def k9(spark, d):
    path = scratch.folder(spark, "manifest")
    for part in ("r_regionkey % 2 = 1", "r_regionkey % 2 = 0"):
        writers.append_manifest(region(spark, d).filter(part), path)
    return writers.json_array_text(spark.read.schema(REGION).json(path), ["r_regionkey"])


@query("K2_array_parts", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def k2_parts(spark, d):
    path, src = scratch.folder(spark, "array"), read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    writers.to_json_array(src, ["l_orderkey", "l_linenumber"], path)
    return readers.json_array_parts(spark, path, src.schema)


@query("K9_array_parts", "SELECT event_id, event_type, value FROM events")
def k9_parts(spark, d):
    manifest, path = scratch.folder(spark, "manifest"), scratch.folder(spark, "array")
    events = read(spark, d, "events").select("event_id", "event_type", "value")
    for part in ("event_id % 2 = 0", "event_id % 2 <> 0 OR event_id IS NULL"):
        writers.append_manifest(events.filter(part), manifest)
    writers.to_json_array(readers.jsonl(spark, manifest, events.schema), ["event_type"], path)  # a key with many ties
    return readers.json_array_parts(spark, path, events.schema)


@query("ST9_in_batches", "SELECT doc_id, n_chars * 2 AS twice FROM documents")
def st9(spark, d):
    path, docs = scratch.folder(spark, "manifest"), read(spark, d, "documents").select("doc_id", "n_chars")
    work = lambda df: df.select("doc_id", (F.col("n_chars") * 2).alias("twice"))
    writers.in_batches(docs.filter("doc_id % 3 = 0"), "doc_id", work, path, 2)  # a run that was stopped
    writers.in_batches(docs, "doc_id", work, path, 4)
    return spark.read.schema("doc_id long, twice long").json(path)


@query("H5_blank_lines", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: x || CASE WHEN contains('0123', substr(md5('7:' || (i - 1)), 1, 1)) THEN chr(10) ELSE '' END), chr(10)) AS t FROM documents")
def h5(spark, d):
    return read(spark, d, "documents").select("doc_id", layout.blank_lines(F.col("text"), 4, 7).alias("t"))


@query("H5_wide_gaps", "SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda x, i: x || CASE WHEN i = len(string_split(text, ' ')) THEN '' WHEN contains('012', substr(md5('5:' || (i - 1)), 1, 1)) THEN '   ' ELSE ' ' END), '') AS t FROM benchmark")
def h5_gaps(spark, d):
    return read(spark, d, "benchmark").select("item_id", layout.wide_gaps(F.col("text"), 3, 5).alias("t"))
