"""Sessions of names against the greedy rule, suffix by suffix over a list."""

import random

import pytest
from pyspark.sql import functions as F

from curatrix.functions import tables
from curatrix.functions.strings import suffixes
from curatrix.operators import reconcile, sessions
from curatrix.plans import queries_sessions


def fits(name, suffix):
    return name == suffix or name.endswith("_" + suffix)


def greedy(names):
    """The session of each different name: all suffixes ranked by tokens, then by how many names they fit."""
    names = set(names)
    fitting = {s: {n for n in names if fits(n, s)} for n in names for s in ["_".join(n.split("_")[k:]) for k in range(n.count("_") + 1)]}
    out = {}
    for s in sorted(fitting, key=lambda s: (-s.count("_"), -len(fitting[s]), s)):
        free = [n for n in fitting[s] if n not in out]
        if len(free) >= 2:
            out.update(dict.fromkeys(free, s))
    return {n: out.get(n, n) for n in names}


def found(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    rows = sessions.sessions(df).collect()
    assert sorted((r["i"], r["name"]) for r in rows) == list(enumerate(names))
    return {r["name"]: r["session"] for r in rows}


def test_sessions(spark):
    names = ["m1_day_two", "m2_day_two", "m3_two", "m4_two", "lonely"]
    assert found(spark, names) == {"m1_day_two": "day_two", "m2_day_two": "day_two", "m3_two": "two", "m4_two": "two", "lonely": "lonely"}
    assert found(spark, []) == {}


@pytest.mark.parametrize("seed", range(4))
def test_sessions_equal_greedy_rule(spark, seed):
    draw = random.Random(seed)
    names = ["_".join(draw.choice(["a", "b", "", "cc"][: 2 + seed % 3]) for _ in range(draw.randrange(1, 7))) for _ in range(40 * (seed + 1))]
    names += names[:5] + ["", "_", "x" * 3000, "y_" * 60 + "a", "z_" * 60 + "a"]
    assert found(spark, names) == greedy(names)


def test_one_name_left_at_each_length(spark):
    names = ["a", "b_a", "c_b_a", "d_c_b_a", "x_a", "q_c_b_a", "p_b_a", "p_r_a"]
    assert found(spark, names) == greedy(names)


def test_null_names_and_a_session_column(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "m_t", "old"), (3, "n_t", "old"), (4, None, "old")], "i int, file string, session string")
    assert {r["i"]: r["session"] for r in sessions.sessions(df, "file").collect()} == {1: None, 2: "t", 3: "t", 4: None}


def test_sessions_of_the_query(spark, sf):
    names = [r["name"] for r in queries_sessions.files(spark, sf).collect()]
    got = {r["name"]: r["session"] for r in queries_sessions.x7_sessions(spark, sf).collect()}
    assert got == greedy(names) and len(set(got.values())) > 3


def test_lookup_with_hot_keys(spark):
    """A third of the rows share a key, null keys stay, keys without a row get nulls."""
    rows = [(i, None if i % 10 == 0 else 7 if i % 3 == 0 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k int")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 600, 2)] + [(7, "hot")], "k int, v string")
    known = {k: f"v{k}" for k in range(0, 600, 2)} | {7: "hot"}
    for share in (2, 5, 1000):
        assert {(r["i"], r["v"]) for r in reconcile.lookup(df, table, "k", share).collect()} == {(i, known.get(k)) for i, k in rows}
        assert reconcile.lookup(df, table, "k", share).count() == 600


def test_suffix_table_equals_expression(spark):
    tables.register(spark)
    df = spark.createDataFrame([("a_b_c",), ("",), ("x_",), (None,)], "name string")
    got = sorted((r["suffix"], r["tokens"]) for r in spark.sql("SELECT s.* FROM {df}, LATERAL suffixes(name) s", df=df).collect())
    want = df.filter("name IS NOT NULL").select(F.explode(suffixes(F.col("name"))).alias("s")).select("s", F.size(F.split("s", "_", -1)).alias("n")).collect()
    assert got == sorted((r["s"], r["n"]) for r in want)
