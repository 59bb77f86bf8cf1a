import hashlib

from curatrix.llm import exact
from curatrix.llm.common import stage

from .helpers import documents, lowered


def plain(rows):
    """Of (doc_id, text) rows: doc_id, keep_id, group_size, text_sha256, in the order of the rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(lowered(t).encode()).hexdigest()))
    return out


def order(row):
    return [(x is not None, x) for x in row]


def held(spark, rows, parts, **how):
    got = exact.exact_dedup(documents(spark, rows).repartition(parts), **how)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = got.collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in got), key=order) == sorted(plain(rows), key=order)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len({sha for _, sha in kept}) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    long = "Wort " * 400_000
    rows = [(1, None), (2, ""), (3, " "), (4, "Ab"), (5, "aB"), (5, "AB"), (5, "AB"), (6, "Äb"), (7, "äb"), (None, "ab"), (None, "only"), (None, "only"), (8, long), (9, long.upper()), (10, long + "."), (11, "K"), (12, "k")]
    held(spark, rows, 3)


def test_many_runs_and_rounds(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"Text {i % 400}" if i % 2 else f"text {i}") for i in range(3000)]
    for parts, fan in ((1, 4), (2, 1), (40, 1), (40, 2), (17, 4)):
        held(spark, rows, parts, fan_bits=fan)


def test_a_round_merges_neighbouring_runs_only(spark):
    rows = documents(spark, [(i, "copy") for i in range(64)]).repartition(8).selectExpr("cast(spark_partition_id() as long) run", "unhex(sha2(text, 256)) sha", "struct(doc_id, doc_id AS at) best", "1L n")
    rows = stage(rows, "entries")
    runs = rows.select("run").distinct().count()
    from pyspark.sql import functions as F

    one = exact.merged(rows, F.shiftright("run", 1), F.lit(0)).collect()
    assert len(one) == -(-runs // 2) and sum(r.n for r in one) == 64
    top = exact.rounds(rows, 8, 1).collect()
    assert [(r.best.doc_id, r.n) for r in top] == [(63, 64)]


def test_empty_table(spark):
    assert exact.exact_dedup(documents(spark, [])).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = exact.op13_exact_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
