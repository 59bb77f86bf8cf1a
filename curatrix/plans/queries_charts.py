"""Queries of the chart aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts
from .catalog import query, read

PIE = """
WITH by_label AS (SELECT coalesce({label}, 'nan') AS label, sum(coalesce({value}, 0.0)) AS s, count(*) AS n FROM {table} GROUP BY 1),
picked AS (SELECT label, CASE WHEN (SELECT sum(s) FROM by_label) = 0 OR (SELECT count(DISTINCT coalesce({value}, 0.0)) FROM {table}) <= 1 THEN n::DOUBLE ELSE s END AS v FROM by_label),
ranked AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rn, count(*) OVER () AS m FROM picked)
SELECT CASE WHEN m <= 10 OR rn <= 9 THEN label ELSE 'Other' END AS label, round(sum(v), 2) AS value FROM ranked GROUP BY 1 HAVING sum(v) > 0
"""


@query("A1_pie", PIE.format(label="o_orderpriority", value="o_totalprice", table="orders"))
def a1(spark, d):
    return charts.pie(read(spark, d, "orders"), "o_orderpriority", "o_totalprice").withColumn("value", F.round("value", 2))


@query("A1_pie_other", PIE.format(label="p_type", value="p_retailprice", table="part"))
def a1_other(spark, d):
    return charts.pie(read(spark, d, "part"), "p_type", "p_retailprice").withColumn("value", F.round("value", 2))


R2 = "round({0}, 2) AS {0}"


@query("A2_hbar", "SELECT coalesce(p_brand, 'nan') AS label, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 HAVING sum(p_retailprice) > 0 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 12")
def a2(spark, d):
    return charts.bars(read(spark, d, "part"), "p_brand", "p_retailprice").withColumn("value", F.round("value", 2))


@query("A2_hbar_count", "SELECT coalesce(p_brand, 'nan') AS label, count(*)::DOUBLE AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def a2_count(spark, d):
    return charts.bars(read(spark, d, "part"), "p_brand", None)


@query("A4_single_bars", "SELECT regexp_replace(coalesce(c_mktsegment, 'nan'), '[^\\x00-\\x7F]', '', 'g') AS label, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1 HAVING sum(c_acctbal) > 0 ORDER BY sum(c_acctbal) DESC, 1 LIMIT 7")
def a4(spark, d):
    from ..functions.strings import ascii_filter

    return charts.bars(read(spark, d, "customer").withColumn("label", ascii_filter(F.col("c_mktsegment"))), "label", "c_acctbal", 7).withColumn("value", F.round("value", 2))


@query("A5_grouped", "SELECT l_returnflag || l_linestatus AS label, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_tax), 2) AS l_tax, round(sum(l_quantity) + sum(l_extendedprice) + sum(l_tax), 2) AS total FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) + sum(l_extendedprice) + sum(l_tax) DESC LIMIT 10")
def a5(spark, d):
    li = read(spark, d, "lineitem").withColumn("label_", F.concat("l_returnflag", "l_linestatus"))
    out = charts.grouped_measures(li, "label_", ["l_quantity", "l_extendedprice", "l_tax"])
    return out.select("label", *[F.round(c, 2).alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "total")])


@query("A6_count", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def a6(spark, d):
    return charts.count_by(read(spark, d, "events"), "event_type")


SHARE = """
WITH by_label AS (SELECT coalesce(p_type, 'nan') AS label, sum(p_retailprice) AS value, min(p_partkey) AS f FROM part GROUP BY 1),
s AS (SELECT *, value / sum(value) OVER () AS share FROM by_label), r AS (SELECT *, row_number() OVER (ORDER BY share DESC, f, label) AS rn FROM s),
t AS (SELECT CASE WHEN rn <= 20 THEN label ELSE 'Other' END AS label, CASE WHEN rn <= 20 THEN 'label' ELSE 'beyond_top' END AS kind, sum(value) AS value, sum(share) AS share FROM r GROUP BY 1, 2)
SELECT CASE WHEN share < 0.01 THEN 'Other' ELSE label END AS label, CASE WHEN share < 0.01 THEN 'below_threshold' ELSE kind END AS kind, round(sum(value), 2) AS value, round(sum(share), 6) AS share FROM t GROUP BY 1, 2
"""


@query("A7_shares", SHARE)
def a7(spark, d):
    out = charts.shares(read(spark, d, "part"), "p_type", "p_retailprice", "p_partkey", top=20, threshold=0.01)
    return out.select("label", "kind", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"))


@query("A8_first_seen", "SELECT coalesce(o_orderpriority, 'nan') AS label, round(sum(o_totalprice), 2) AS value, min(o_orderkey) AS first_seen FROM orders GROUP BY 1")
def a8(spark, d):
    return charts.first_seen_sums(read(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey").withColumn("value", F.round("value", 2))


@query("A11_histogram", "WITH t AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1), h AS (SELECT k, count(*) AS n FROM t GROUP BY 1) SELECT g.bin::INT AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT coalesce(max(k), 0) + 1 FROM t))) AS bin) g LEFT JOIN h ON h.k = g.bin")
def a11(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"))
    return charts.histogram(turns, "k")


@query("A13_cardinality", "SELECT count(*) AS total, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def a13(spark, d):
    from ..operators.reconcile import cardinality

    return cardinality(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("A14_best_parameter", "SELECT max_by(size, (avg_value, -size)) AS best, max(avg_value) AS score FROM (SELECT p_size AS size, round(avg(p_retailprice), 4) AS avg_value FROM part GROUP BY 1) WHERE avg_value > 0")
def a14(spark, d):
    scored = read(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.round(F.avg("p_retailprice"), 4).alias("avg_value"))
    return charts.best_parameter(scored, "avg_value", "size")


@query("A15_series_slice", "WITH k AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 5) SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 4) AS value FROM events WHERE user_id IN (SELECT user_id FROM k)")
def a15(spark, d):
    ev = read(spark, d, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return charts.series_slice(ev, "user_id", "event_id", 5, ["user_id", "ts", "value"]).withColumn("value", F.round("value", 4))


@query("A16_clip_scale", "WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT event_id, round((greatest(lo, least(hi, value)) - lo) / (hi - lo), 6) AS scaled FROM events JOIN q USING (event_type) WHERE value IS NOT NULL")
def a16(spark, d):
    return charts.clip_and_scale(read(spark, d, "events").filter("value IS NOT NULL"), "event_type", "value").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("A17_flatness", "SELECT p_brand, round(stddev_pop(p_retailprice) / (abs(avg(p_retailprice)) + 1e-9), 6) AS cv, stddev_pop(p_retailprice) / (abs(avg(p_retailprice)) + 1e-9) < 0.03 AS flat FROM part GROUP BY 1")
def a17(spark, d):
    return charts.flatness(read(spark, d, "part"), "p_brand", "p_retailprice").withColumn("cv", F.round("cv", 6))


BINS = """
WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi, least(10, greatest(4, floor(sqrt(count(value)))))::INT AS k FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, (CASE WHEN hi = lo THEN 1 ELSE least(k, greatest(1, ceil((value - lo) / ((hi - lo) / k)))) END)::INT AS bin, count(*) AS n FROM events JOIN b USING (event_type) WHERE value IS NOT NULL GROUP BY 1, 2
"""


@query("A18_bins", BINS)
def a18(spark, d):
    return charts.equal_width_bins(read(spark, d, "events"), "event_type", "value")


@query("A19_distinct", "SELECT DISTINCT source, lang FROM documents")
def a19(spark, d):
    return read(spark, d, "documents").select("source", "lang").distinct()


@query("P4_first_columns", "SELECT 'o_orderstatus' AS label_column, 'o_orderkey' AS value_column")
def p4(spark, d):
    label, value = charts.numeric_and_other(read(spark, d, "orders"))
    return spark.createDataFrame([(label, value)], "label_column string, value_column string")


@query("P5_chart_shape", "SELECT * FROM (VALUES ('lineitem', 'grouped'), ('region', 'single'), ('labels', 'single')) t(name, shape)")
def p5(spark, d):
    return spark.createDataFrame([(t, charts.chart_shape(read(spark, d, t))) for t in ("lineitem", "region", "labels")], "name string, shape string")


@query("P6_column_by_candidates", "SELECT o_orderdate AS found FROM orders")
def p6(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col(charts.column_of(o, ["TIME_PERIOD", "time", "o_orderdate"])).alias("found"))


@query("P7_column_by_index", "SELECT n_name AS found FROM nation")
def p7(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.col(charts.column_of(n, index=1)).alias("found"))


@query("P11_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def p11(spark, d):
    return read(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_acctbal")


@query("P12_finite", "SELECT event_id, CASE WHEN value = 0 THEN NULL ELSE round(1 / value, 6) END AS inverse, round(value, 6) AS value FROM events WHERE value IS NOT NULL")
def p12(spark, d):
    ev = read(spark, d, "events").select("event_id", F.when(F.col("value") == 0, F.lit(float("inf"))).otherwise(1 / F.nullif("value", F.lit(0.0))).alias("inverse"), "value")
    return charts.finite_or_null(ev, ["inverse", "value"]).select("event_id", F.round("inverse", 6).alias("inverse"), F.round("value", 6).alias("value"))


@query("P13_enough_categories", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3)")
def p13(spark, d):
    return charts.enough_categories(read(spark, d, "lineitem"), "l_orderkey", "l_partkey").select("l_orderkey", "l_linenumber")


@query("U8_downsample", "SELECT event_type, count(*) AS n, [round_even(i * (count(*) - 1) / 4.0, 0)::BIGINT for i in range(0, 5)] AS points FROM events GROUP BY 1")
def u8(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("points", charts.downsample(F.col("n"), 5))


@query("X2_datetime_coercion", "SELECT 'l_shipdate' AS col, count(l_shipdate) AS valid, count(l_shipdate) >= 6 AS accepted FROM lineitem UNION ALL SELECT 'l_returnflag', 0, false")
def x2(spark, d):
    li = read(spark, d, "lineitem")
    rows = [li.agg(F.count(F.try_to_timestamp(F.col(c).cast("string"))).alias("valid")).select(F.lit(c).alias("col"), "valid", (F.col("valid") >= 6).alias("accepted")) for c in ("l_shipdate", "l_returnflag")]
    return rows[0].unionByName(rows[1])


@query("X4_finite_sorted", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)")
def x4(spark, d):
    from ..operators.sampling import global_rank

    fine = read(spark, d, "events").filter("value IS NOT NULL AND NOT isnan(value)").filter(~F.col("value").isin(float("inf"), float("-inf")))
    return global_rank(fine, ["value", "event_id"]).select("event_id", (F.col("rank") - 1).alias("place"))


@query("W7_chunks", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, (i // greatest(1, n // 10))::BIGINT AS chunk, count(*) AS n FROM r GROUP BY 1, 2")
def w7(spark, d):
    from ..operators.sampling import place_within

    idx = place_within(read(spark, d, "events").select("event_type", "event_id"), "event_type", ["event_id"], "place")
    chunk = F.floor((F.col("place") - 1) / F.greatest(F.lit(1), F.floor(F.col("_size") / 10)))
    return idx.groupBy("event_type", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("W8_trailing_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def w8(spark, d):
    from pyspark.sql import Window as W

    from ..streaming.rolling import micros

    # to the nearest second, halves to the even one
    ev = read(spark, d, "events").withColumn("s", F.rint(micros("ts") / 1e6).cast("long"))
    return ev.select("event_id", F.count(F.lit(1)).over(W.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)).alias("in_window"))
