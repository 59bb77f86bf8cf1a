"""Queries of streams: rolling buffers, replies, polling, and sliding votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import rolling as ST
from ..streaming import run, votes
from .catalog import query, read

DAY = 86_400_000
#: Each seventh event comes six hours late; arrival is by event_id.
LATE = 6 * 3_600_000
_MS = f"epoch_us(ts) // 1000 - CASE WHEN event_id % 7 = 0 THEN {LATE} ELSE 0 END"
_WITH_ARRIVALS = f"WITH arrivals AS (SELECT user_id::VARCHAR AS key, event_id AS seq, {_MS} AS ms, event_type FROM events)"
#: Of rows (key, epoch, seq, ms): each leaves with the first later one whose bound has passed it; what is held is a running sum of both.
_HELD = f"""
        gone AS (SELECT a.key, a.epoch, min(b.seq) AS seq FROM segs a JOIN segs b ON a.key = b.key AND a.epoch = b.epoch AND b.seq > a.seq AND b.ms > a.ms + {DAY} GROUP BY a.key, a.epoch, a.seq),
        moves AS (SELECT key, epoch, seq, 1 AS n FROM segs UNION ALL SELECT key, epoch, seq, -1 FROM gone),
        held AS (SELECT key, epoch, seq, sum(sum(n)) OVER (PARTITION BY key, epoch ORDER BY seq)::BIGINT AS held FROM moves GROUP BY 1, 2, 3)"""


def events(spark, d):
    return run.stream_of(spark, f"{d}/events.parquet")


def at():
    return ST.millis("ts") - F.when(F.col("event_id") % 7 == 0, LATE).otherwise(0)


def buffered(spark, d):
    return run.settled(ST.rolling(ST.segments(events(spark, d), "user_id", at(), "event_type", "event_id"), DAY), "rolled")


@query("ST1_rolling_buffer", f"{_WITH_ARRIVALS}, segs AS (SELECT *, 0 AS epoch FROM arrivals), {_HELD} SELECT key, seq, held FROM held")
def st1(spark, d):
    return buffered(spark, d).select("key", "seq", "held")


@query("ST2_timed_buffer", f"""
        WITH segs AS (SELECT user_id::VARCHAR AS key, event_id AS seq, epoch_us(ts) // 1000 AS ms FROM events),
        added AS (SELECT key, 'added' AS what, seq, ms AS "at", count(*) OVER (PARTITION BY key ORDER BY seq) AS held FROM segs),
        due AS (SELECT key, ms + {DAY} + 1 AS expiry, count(*) AS n FROM segs GROUP BY 1, 2),
        expired AS (SELECT key, expiry, sum(n) OVER (PARTITION BY key) - sum(n) OVER (PARTITION BY key ORDER BY expiry) AS held FROM due)
        SELECT * FROM added UNION ALL SELECT key, 'expired', NULL, expiry, held::BIGINT FROM expired WHERE expiry <= (SELECT max(ms) FROM segs)""")
def st2(spark, d):
    rows = ST.segments(events(spark, d), "user_id", ST.millis("ts"), "event_type", "event_id")
    rows = rows.withColumn("clock", F.timestamp_millis("ts")).withWatermark("clock", "0 seconds")
    return run.settled(ST.timed(rows, DAY, "clock"), "timed")


@query("ST3_shown_text")
def st3(spark, d):
    return ST.shown(buffered(spark, d)).select("key", "seq", "text")


@query("ST4_reset_buffer", f"""{_WITH_ARRIVALS},
        told AS (SELECT *, CASE event_type WHEN 'error' THEN 'reset' WHEN 'purchase' THEN 'begin' WHEN 'view' THEN 'end' END AS control FROM arrivals),
        named AS (SELECT *, count_if(coalesce(control, '') IN ('reset', 'begin')) OVER w AS epoch, coalesce(last_value(CASE WHEN control <> 'reset' THEN control END IGNORE NULLS) OVER w, 'end') AS gate FROM told WINDOW w AS (PARTITION BY key ORDER BY seq)),
        segs AS (SELECT key, epoch, seq, ms FROM named WHERE control IS NULL AND gate = 'end'), {_HELD}
        SELECT key, seq, held FROM held
        UNION ALL SELECT c.key, c.seq, coalesce(arg_max(h.held, h.seq), 0) FROM named c LEFT JOIN held h ON h.key = c.key AND h.epoch = c.epoch AND h.seq < c.seq WHERE c.control IS NOT NULL GROUP BY 1, 2""")
def st4(spark, d):
    kind = F.when(F.col("event_type") == "error", ST.RESET).when(F.col("event_type") == "purchase", ST.BEGIN).when(F.col("event_type") == "view", ST.END)
    data = ST.segments(events(spark, d).filter(kind.isNull()), "user_id", at(), "event_type", "event_id")
    control = ST.segments(events(spark, d).filter(kind.isNotNull()), "user_id", at(), "event_type", "event_id", kind)
    return run.settled(ST.rolling(data, DAY, control), "reset").select("key", "seq", "held")


@query("ST5_latest_reply", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def st5(spark, d):
    return ST.latest_reply(read(spark, d, "events"), "user_id", "event_id", "event_type")


@query("ST5_replies_of_a_stream", "SELECT user_id::VARCHAR AS key, event_id AS request, event_type AS reply FROM events WHERE (user_id, event_id) IN (SELECT (user_id, max(event_id)) FROM events GROUP BY user_id) AND event_type <> 'error'")
def st5_stream(spark, d):
    # an error is a request that is never answered
    said = F.when(F.col("event_type") != "error", F.col("event_type"))
    return run.settled(ST.latest_replies(events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request"), said.alias("reply"))), "replies")


@query("ST6_of_kind", "SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def st6(spark, d):
    ev = read(spark, d, "events")
    first = ev.agg(F.min("event_type")).collect()[0][0]
    return ST.of_kind(ev, first, "event_type").select("event_id")


@query("ST7_polled", "SELECT event_id, event_type, value FROM events WHERE value > 10")
def st7(spark, d):
    rows = events(spark, d).filter("value > 10").select("event_id", "event_type", "value")
    sink, state = run.BatchFolders(scratch.folder(spark, "polled")), scratch.folder(spark, "polled-state")
    run.poll(rows, sink, state).awaitTermination()
    scratch.remove(spark, state)
    return sink.table(spark, rows.schema)


@query("ST10_sliding_votes", """
        WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_id, value > 50 AS f, time_bucket(INTERVAL 1 DAY, ts) - o * INTERVAL 1 DAY AS start FROM events, range(0, 2) t(o)),
        l AS (SELECT start, f, lag(f) OVER v AS f1, lag(f, 2) OVER v AS f2 FROM w WINDOW v AS (PARTITION BY start ORDER BY day, event_id))
        SELECT strftime(start, '%Y-%m-%d') AS day, count_if(f) >= 1 AS one, count_if(f) >= 2 AS two, 2 * count_if(f) > count(*) AS majority, count_if(f) = count(*) AS "all", coalesce(bool_or(f AND f1), false) AS two_consecutive, coalesce(bool_or(f AND f1 AND f2), false) AS three_consecutive FROM l GROUP BY start""")
def st10(spark, d):
    found = votes.sliding_votes(read(spark, d, "events"), ST.millis("ts") / 1000, F.col("value") > 50, ["event_id"], 2 * 86_400, 86_400)
    return found.select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("start") / 86_400).cast("int")).cast("string").alias("day"), *[r.replace("-", "_") for r in votes.RULES])


@query("ST10_f_score", "SELECT round(2.0 * count_if(toxic = 1 AND quality = 1) / (2 * count_if(toxic = 1 AND quality = 1) + count_if(toxic = 1 AND quality <> 1) + count_if(toxic <> 1 AND quality = 1)), 6) AS f_score FROM labels")
def st10b(spark, d):
    lab = read(spark, d, "labels").select((F.col("toxic") == 1).alias("p"), (F.col("quality") == 1).alias("t"))
    return votes.f_score(lab, "p", "t").select(F.round("f_score", 6).alias("f_score"))


def _rules(flag):
    """The six rules over rows (g, x, f, f1, f2) of a window, as aggregates of one flag."""
    f, f1, f2 = flag, f"{flag}1", f"{flag}2"
    return f"""[{{'r': 'one', 'v': count_if({f}) >= 1}}, {{'r': 'two', 'v': count_if({f}) >= 2}}, {{'r': 'majority', 'v': 2 * count_if({f}) > count(*)}}, {{'r': 'all', 'v': count_if({f}) = count(*)}}, {{'r': 'two-consecutive', 'v': coalesce(bool_or({f} AND {f1}), false)}}, {{'r': 'three-consecutive', 'v': coalesce(bool_or({f} AND {f1} AND {f2}), false)}}]"""


#: Every choice of two rules, a length of 1 to 10 hours and a step up to it, but the pruned ones, and how well one rule's votes meet the other's.
@query("U11_grid", f"""
        WITH e AS (SELECT event_id, epoch_us(ts) // 3600000000 AS slice, value > 50 AS p, event_type = 'error' AS t FROM events),
        g AS (SELECT size, step FROM range(1, 11) a(size), range(1, 11) b(step) WHERE step <= size),
        w AS (SELECT size, step, k * step AS start, slice, event_id, p, t FROM (SELECT *, unnest(range((slice - size + 1 + step - 1) // step, slice // step + 1)) AS k FROM e, g)),
        l AS (SELECT size, step, start, p, t, lag(p) OVER v AS p1, lag(p, 2) OVER v AS p2, lag(t) OVER v AS t1, lag(t, 2) OVER v AS t2 FROM w WINDOW v AS (PARTITION BY size, step, start ORDER BY slice, event_id)),
        s AS (SELECT size, step, start, {_rules("p")} AS ps, {_rules("t")} AS ts FROM l GROUP BY 1, 2, 3),
        x AS (SELECT size, step, a, unnest(ts) AS b FROM (SELECT size, step, unnest(ps) AS a, ts FROM s)),
        ok AS (SELECT size, step, a.r AS predicted_rule, b.r AS truth_rule, a.v AS p, b.v AS t FROM x WHERE NOT (size = 1 AND (a.r <> 'one' OR b.r <> 'one')) AND NOT (size = 2 AND (a.r = 'three-consecutive' OR b.r = 'three-consecutive')))
        SELECT predicted_rule, truth_rule, size, step, round(CASE WHEN 2 * count_if(p AND t) + count_if(p <> t) > 0 THEN 2.0 * count_if(p AND t) / (2 * count_if(p AND t) + count_if(p <> t)) END, 6) AS f_score FROM ok GROUP BY 1, 2, 3, 4""")
def u11(spark, d):
    found = votes.swept(read(spark, d, "events"), ST.millis("ts") / 3_600_000, F.col("value") > 50, F.col("event_type") == "error", ["event_id"], list(range(1, 11)))
    return found.withColumn("f_score", F.round("f_score", 6))
