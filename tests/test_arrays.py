"""Lists and arrays of any size, written and read in parts."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from curatrix.sources import readers, writers


def joined(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_list_is_one_json_value_in_order(spark, tmp_path, coalesced):
    """In one file after the ranges are put together, and in several."""
    rows = [(i % 7 if i % 11 else None, i, 'a "quoted"\nline, é ]' if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, `t.x` string").repartition(5)
    path = str(tmp_path / "list")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        writers.to_json_array(df, ["k", "i"], f"file://{path}")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = [{"k": k, "i": i, "t.x": t} for k, i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert json.loads(joined(path)) == want
    assert (len(glob.glob(f"{path}/part-0*")) > 2) == (coalesced == "false")
    assert sorted(map(tuple, readers.json_array_parts(spark, path, df.schema).collect()), key=lambda r: r[1]) == rows


def test_million_rows_with_a_hot_key(spark, tmp_path):
    """A third of the rows share the key and everything else; the ranges still split them."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("t"))
    path = str(tmp_path / "million")
    writers.to_json_array(df, ["k"], path)
    got = readers.json_array_parts(spark, path, df.schema)
    assert got.rdd.getNumPartitions() > 1
    assert tuple(got.agg(F.count("*"), F.sum("k"), F.count_distinct("k")).collect()[0]) == tuple(df.agg(F.count("*"), F.sum("k"), F.count_distinct("k")).collect()[0])
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/part-0*")]
    assert max(sizes) < 0.6 * sum(sizes)
    assert [r["k"] for r in json.loads(joined(path))[:3]] == [1, 2, 4]


def test_empty_list(spark, tmp_path):
    df = spark.createDataFrame([], "k int")
    path = str(tmp_path / "none")
    writers.to_json_array(df, ["k"], path)
    assert json.loads(joined(path)) == [] and readers.json_array_parts(spark, path, df.schema).count() == 0


def test_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(1000).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="broken"):
        writers.to_json_array(bad, ["k"], str(tmp_path / "bad"))
    assert os.listdir(tmp_path) == []


def test_existing_list_stays(spark, tmp_path):
    path = str(tmp_path / "list")
    writers.to_json_array(spark.range(3), ["id"], path)
    with pytest.raises(FileExistsError):
        writers.to_json_array(spark.range(9), ["id"], path)
    assert len(json.loads(joined(path))) == 3 and os.listdir(tmp_path) == ["list"]


def test_line_that_is_no_record(spark, tmp_path):
    (tmp_path / "part-00000").write_text('[{"k":1}\nnot a record\n]\n')
    with pytest.raises(Exception, match="no record"):
        readers.json_array_parts(spark, str(tmp_path), spark.createDataFrame([], "k int").schema).collect()
