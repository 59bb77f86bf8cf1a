"""Queries of sessions that file names share, over names that the documents give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import sessions
from .catalog import query, read

#: A document's file name: which of its five tokens it has follows from its number and length, so names differ in depth.
_NAME = (
    "concat_ws('_', CASE WHEN doc_id % 3 <> 0 THEN concat('m', doc_id % 40) END, CASE WHEN doc_id % 2 = 0 THEN substring(md5(coalesce(text, '')), 1, 2) END, "
    "CASE WHEN n_chars % 5 <> 0 THEN substring(md5(coalesce(text, '')), 3, 1) END, CASE WHEN n_chars % 7 <> 0 THEN lang END, source)"
)
#: Level by level from the longest name down: what two free names or more share at a level takes them.
_SESSIONS = f"""
WITH RECURSIVE files AS (SELECT doc_id, {_NAME} AS name FROM documents),
names AS (SELECT DISTINCT name, string_split(name, '_') AS t FROM files),
level AS (
  SELECT (SELECT max(len(t)) FROM names) + 1 AS k, name, t, NULL::VARCHAR AS session FROM names
  UNION ALL
  SELECT k - 1, name, t, CASE WHEN session IS NULL AND s IS NOT NULL AND count(*) FILTER (session IS NULL) OVER (PARTITION BY s) >= 2 THEN s ELSE session END
  FROM (SELECT *, CASE WHEN len(t) >= k - 1 THEN array_to_string(t[len(t) - k + 2:], '_') END AS s FROM level WHERE k > 1)
)
SELECT doc_id, name, coalesce(session, name) AS session FROM files JOIN (SELECT name, session FROM level WHERE k = 1) USING (name)
"""


def files(spark, d):
    return read(spark, d, "documents").select("doc_id", F.expr(_NAME).alias("name"))


@query("X7_sessions", _SESSIONS)
def x7_sessions(spark, d):
    return sessions.sessions(files(spark, d))


@query("X8_ranked_suffixes", f"SELECT s AS suffix, len(string_split(s, '_')) AS tokens, count(DISTINCT name) AS names FROM (SELECT name, unnest(list_transform(generate_series(1, len(t)), lambda i: array_to_string(t[i:], '_'))) AS s FROM (SELECT {_NAME} AS name, string_split({_NAME}, '_') AS t FROM documents)) GROUP BY 1 HAVING count(DISTINCT name) >= 2")
def x8(spark, d):
    tables.register(spark)
    names = files(spark, d).select("name").distinct()
    return spark.sql("SELECT suffix, tokens, count(*) AS names FROM {names}, LATERAL suffixes(name) GROUP BY suffix, tokens HAVING count(*) >= 2 ORDER BY tokens DESC, names DESC, suffix", names=names)
