"""Queries of boxes over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..streaming.rolling import millis
from .catalog import query, read

#: An event as a box: from its hour and value, as wide and high as its ids say.
_BOXES = "WITH e AS (SELECT event_id AS id, (epoch_us(ts) // 3600000000)::DOUBLE AS x0, value AS y0, event_id % 5 + 1 AS w, user_id % 7 + 1 AS h FROM events), b AS (SELECT id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM e)"
_MEET = "a.id <> b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


def boxes(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(millis("ts") / 3_600_000).cast("double").alias("x0"), F.col("value").alias("y0"), "user_id")
    return e.select("id", "x0", "y0", (F.col("x0") + F.col("id") % 5 + 1).alias("x1"), (F.col("y0") + (F.col("user_id") % 7 + 1)).alias("y1"))


@query("P17_overlaps", f"{_BOXES} SELECT a.id, count(b.id) AS n FROM b a LEFT JOIN b ON {_MEET} GROUP BY 1")
def p17_overlaps(spark, d):
    return spatial.counted(boxes(spark, d), 4.0)


@query("P17_contained", f"{_BOXES} SELECT a.id, count(b.id) AS n FROM b a LEFT JOIN b ON {_MEET} AND a.x0 <= b.x0 AND b.x1 <= a.x1 AND a.y0 <= b.y0 AND b.y1 <= a.y1 GROUP BY 1")
def p17_contained(spark, d):
    return spatial.counted(boxes(spark, d), 4.0, spatial.contains)


@query("U10_placed")
def u10(spark, d):
    return spatial.placed(boxes(spark, d), 4.0)
