"""Operators against plain models, and the edge cases that tables don't show."""

import json
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import layout, strings, urls
from curatrix.operators import charts, clean, conversations, nearest, reconcile, sampling
from curatrix.plans import catalog
from curatrix.sources import readers, writers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).collect()[0][0]


def texts(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", build(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def round_robin(sizes, target):
    """The allocation rule as a loop."""
    n = len(sizes)
    take = [min(s, target // n) for s in sizes]
    left = min(target, sum(sizes)) - sum(take)
    while left > 0:
        for g in range(n):
            if left and take[g] < sizes[g]:
                take[g] += 1
                left -= 1
    return take


def test_equitable_is_round_robin(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 5))]
        target = rng.randint(1, sum(sizes) + 2)
        rows = [(f"g{g}", g * 100 + k) for g, s in enumerate(sizes) for k in range(s)]
        got = sampling.equitable(spark.createDataFrame(rows, "g string, i int"), "g", ["i"], "i", target).filter("selected").groupBy("g").count().collect()
        assert {r["g"]: r["count"] for r in got} == {f"g{g}": t for g, t in enumerate(round_robin(sizes, target)) if t}


def test_trailing_window_rounds_to_the_nearest_second(spark, tmp_path):
    at = ["2024-01-01 00:00:00.600", "2024-01-02 00:00:00.700", "2024-01-02 00:00:01.400", "2024-01-02 00:00:01.500"]
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(at)], "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(catalog.SQL["W8_trailing_window"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert {tuple(r) for r in catalog.QUERIES["W8_trailing_window"](spark, str(tmp_path)).collect()} == set(want) == {(0, 1), (1, 3), (2, 3), (3, 3)}


def test_schedule_sums_to_n():
    for n in (0, 1, 7, 10, 101):
        counts = sampling.schedule_counts(n, {"a": 0.35, "b": 0.35, "c": 0.2, "d": 0.1})
        assert sum(counts.values()) == n and min(counts.values()) >= 0


def test_schedule_slack():
    """What rounding leaves goes to the named feature instead of the heaviest."""
    third = {"a": 0.5, "b": 0.25, "c": 0.25}
    assert sampling.schedule_counts(10, third) == {"a": 6, "b": 2, "c": 2} and sampling.schedule_counts(10, third, "c") == {"a": 5, "b": 2, "c": 3}
    assert sampling.schedule_counts(3, {"a": 0.5, "b": 0.5, "c": 0.0}, "c") == {"a": 2, "b": 1, "c": 0}


@pytest.mark.parametrize("n", [2, 6, 7, 10])
def test_schedule_query_equals_sql_for_any_number(spark, tmp_path, n):
    spark.range(n).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(catalog.SQL["U5_schedule"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet' AS documents")).fetchall()
    assert sorted(tuple(r) for r in catalog.QUERIES["U5_schedule"](spark, str(tmp_path)).collect()) == sorted(want)


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7919 % 101,) for i in range(101)], "v int")
    assert [r["rank"] for r in sampling.global_rank(df, ["v"]).orderBy("v").collect()] == list(range(1, 102))


def test_pie_edges(spark):
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 1.0)], "l string, v double")
    assert {r["label"]: r["value"] for r in charts.pie(flat, "l", "v").collect()} == {"a": 1.0, "b": 1.0, "nan": 1.0}
    zero = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.0)], "l string, v double")
    assert {r["label"]: r["value"] for r in charts.pie(zero, "l", "v").collect()} == {"a": 2.0, "b": 1.0}
    many = spark.createDataFrame([(f"k{i:02}", float(i + 1)) for i in range(11)], "l string, v double")
    got = {r["label"]: r["value"] for r in charts.pie(many, "l", "v").collect()}
    assert len(got) == 10 and got["Other"] == 3.0
    ten = spark.createDataFrame([(f"k{i:02}", float(i + 1)) for i in range(10)], "l string, v double")
    assert "Other" not in {r["label"] for r in charts.pie(ten, "l", "v").collect()}


def test_shares_raise_without_total(spark):
    with pytest.raises(ValueError):
        charts.shares(spark.createDataFrame([("a", 0.0, 1)], "l string, v double, o int"), "l", "v", "o")


def test_bins_of_equal_values(spark):
    df = spark.createDataFrame([("a", 5.0)] * 20, "k string, v double")
    assert [(r["bin"], r["n"]) for r in charts.equal_width_bins(df, "k", "v").collect()] == [(1, 20)]


def test_empty_histogram(spark):
    assert [(r["bin"], r["n"]) for r in charts.histogram(spark.createDataFrame([], "n int"), "n").collect()] == [(0, 0)]


#: Texts and what the chain makes of them, written by hand.
CHAIN = [
    ("<image>\n junk **Question:** Sure! OK, great. What?\n\n\n\nA. x   y\nHint: z\nAnswer: w", "<image>\n  Sure! OK, great. What?\nA. x y"),
    ("Greatest", "est"),
    ("Sure! Here is your text: ok, “quoted” ", "quoted"),
    ("Options: a\n\n1) b", "a\n1) b"),
    ("", ""),
    (None, None),
    ("*bold* text", "bold text"),
    ("of course, certainly! yes", "yes"),
    ("one\n\ntwo\n\n\n\nthree", "one\n\ntwo\n\nthree"),
    ("keep\nHint: gone\nAnswer: gone\ntoo", "keep"),
]
SPACES = [
    ("<image>\n\n\n\nXx y", "<image>\n\n\nXx y"),
    ("<image>\n\nA", "<image>\n\nA"),
    ("<image>\n\n\nA", "<image>\n\nA"),
    ("p\n\nA<image>\nq  r", "p\n\nA<image>\nq r"),
    ("p\n\nA", "p\nA"),
    ("p\n\n12) q", "p\n12) q"),
    ("p\n\nAB q", "p\n\nAB q"),
    ("p\n\n\n(A) q \t r", "p\n\n(A) q r"),
    ("\n<image><image>\n", "\n<image><image>\n"),
]
LABELLED = [
    ("IMAGE: Sure! a  b Caption : 'ok then'", "image: a bcaption: ok then"),
    ("before image:x\n\ny", "before image: x y"),
    ("no label", "no label"),
    ("caption:", "caption: "),
    ("my_image: x", "my_image: x"),
    (None, None),
]


def test_clean_chain(spark):
    assert texts(spark, [t for t, _ in CHAIN], clean.clean) == [w for _, w in CHAIN]
    assert texts(spark, [t for t, _ in SPACES], clean.gentle_spaces) == [w for _, w in SPACES]
    assert texts(spark, [t for t, _ in LABELLED], lambda t: clean.clean_labelled(t, ["image", "caption"])) == [w for _, w in LABELLED]
    assert texts(spark, ["Greatest"], lambda t: clean.strip_phrases(t, bounded=True)) == ["Greatest"]


def test_tokens(spark):
    raw = ["hi", "<image>\nhi", "<image> hi <image>", "<image>hi", "hi <image>"]
    got = texts(spark, raw, clean.one_token)
    assert [g["value"] for g in got] == ["<image>\nhi", "<image>\nhi", "<image>\nhi", "<image>\nhi", "hi <image>"]
    assert [g["issue"] for g in got] == ["missing", None, "multiple:2", "newline", "newline"]


def test_expected_text(spark):
    df = spark.createDataFrame([("ab  cd\nef", "a b c"), ("ab", "abcd"), ("ab", "")], "c string, d string")
    assert [r[0] for r in df.select(layout.expected_text(F.col("c"), F.col("d"))).collect()] == ["ab c", "ab", ""]


def test_repeats(spark):
    assert texts(spark, ["a b a b c", "the cat The Cat the cat", "x x y", None], layout.without_repeats) == ["a b c", "the cat", "x x y", None]


def test_wrap(spark):
    assert texts(spark, ["aa bb cc dddddddd e", ""], lambda t: layout.wrap(t, 5)) == [["aa bb", "cc", "dddddddd", "e"], []]


def test_numbers_and_keys(spark):
    assert texts(spark, ["1,234", "12.5%", "x", None], strings.to_number) == [1234.0, 12.5, None, None]
    assert texts(spark, ["x/y-5-7z", "none"], strings.number_after_dash) == ["5", None]
    assert texts(spark, ["Yes!!", "yes"], strings.answer_key) == ["yes", "yes"]
    assert texts(spark, ["a/b/.x", "a/b.c/d.e.f", "plain"], strings.stem) == [".x", "d.e", "plain"]


def test_canonical_query(spark):
    assert texts(spark, ["http://h/p?b=2&a=%20x&a=", "http://h/p", "not a url"], lambda u: urls.canonical_query(urls.query_of(u))) == ["a=&a= x&b=2", "", ""]


def test_data_links(spark):
    html = '<a href="/a.csv">x</a><a href="b">Download data as .csv</a><a href="/a.csv">again</a><a>none</a>'
    df = spark.createDataFrame([(html, "http://h/p/"), (None, None)], "h string, u string")
    got = df.select(urls.data_links("h", "u").alias("l")).collect()
    assert [(x["url"], x["label"]) for x in got[0]["l"]] == [("http://h/p/b", "Download data as .csv"), ("http://h/a.csv", "x")]


def test_arbitration_errors(spark):
    df = spark.createDataFrame([("x", ["a", "b"], ["m", "n"])], "j string, a array<string>, m array<string>")
    with pytest.raises(Exception, match="too few candidates"):
        conversations.arbitrate(df, "j", "a", "m").collect()


def test_nearest_rejects_too_few_bands(spark):
    df = spark.createDataFrame([(1, 2)], "qid long, w long")
    with pytest.raises(ValueError):
        nearest.nearest_within(df, df, ["w"], 6, 6)


def test_nearest_bucket_without_candidates(spark):
    q = spark.createDataFrame([(1, 0, 0, 5), (2, 50, 50, 5)], "qid long, bx int, by int, w long")
    b = spark.createDataFrame([(9, 1, 1, 4)], "bid long, bx int, by int, w long")
    got = {r["qid"]: (r["bid"], r["similarity"]) for r in nearest.nearest_in_bucket(q, b, ["w"], 64).collect()}
    assert got == {1: (9, 1 - 1 / 64), 2: (None, None)}


def test_nearest_bucket_in_blocks_equals_loop(spark):
    """Buckets of several blocks, ties, copies, neighbours' buckets, rows without a hash or a bucket."""
    draw = random.Random(5)
    made = lambda first, n: [(first + i, draw.choice([0, 0, 0, 3, 4, None]), draw.choice([0, 0, 7]), draw.choice([None, *[draw.getrandbits(9)] * 8]), draw.getrandbits(3)) for i in range(n)]
    qs, bs = made(0, 120) + [(999, 5, 6, 1, 1), (998, 60, 0, 1, 1)], made(1000, 150)
    got = nearest.nearest_in_bucket(spark.createDataFrame(qs, "qid long, bx int, by int, w long, v long"), spark.createDataFrame(bs, "bid long, bx int, by int, w long, v long"), ["w", "v"], 64, 16).collect()
    want = {}
    for i, x, y, w, v in qs:
        own = any((b[1], b[2]) == (x, y) for b in bs)
        near = [b for b in bs if None not in (x, y, w, b[1], b[3]) and (abs(b[1] - x) <= 1 and abs(b[2] - y) <= 1 if not own else (b[1], b[2]) == (x, y))]
        want[i] = min((((b[3] ^ w).bit_count() + (b[4] ^ v).bit_count(), b[0]) for b in near), default=None)
    assert {r["qid"]: r["bid"] and (round(64 * (1 - r["similarity"])), r["bid"]) for r in got} == want


def test_nearest_bucket_joins_no_pairs(spark):
    """Pairs aren't rows of a join: the plan joins a bucket's hashes only with the numbers of its blocks."""
    q, b = (spark.range(3).selectExpr(f"id AS {n}", "1 AS bx", "1 AS by", "id AS w") for n in ("qid", "bid"))
    plan = nearest.nearest_in_bucket(q, b, ["w"], 64)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_matches_and_rejects_cover_the_source(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "key string") for v in (["a", "b", "b", None], ["b", "c"]))
    assert {r["key"]: r["status"] for r in reconcile.compare_keys(a, b).collect()} == {"a": "missing", "b": "matched", "c": "extra"}
    assert {r["key"]: r["reason"] for r in reconcile.one_to_one(a.dropna(), b).collect()} == {"a": "no_row", "b": "duplicate_in_source"}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    (tmp_path / "b.json").write_text('[{"id": "3"}, {"id": "4"}]')
    (tmp_path / "c.json").write_text('{"id": "5"}')
    path = str(tmp_path)
    assert sorted(r["id"] for r in readers.json_or_jsonl(spark, f"{path}/a.jsonl", readers.ANNOTATION).collect()) == ["1", "2"]
    assert sorted(r["id"] for r in readers.json_or_jsonl(spark, f"{path}/b.json", readers.ANNOTATION).collect()) == ["3", "4"]
    assert [r["id"] for r in readers.json_union(spark, [f"{path}/b.json", f"{path}/c.json"], readers.ANNOTATION).collect()] == ["3", "4", "5"]
    kept = readers.jsonl_or_raw(spark, f"{path}/a.jsonl", lambda v: F.regexp_replace(v, '"id"', '"key"')).collect()
    assert [r[0] for r in kept] == ['{"key": "1"}', "", "not json", '{"key": "2"}']
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,NA\n")
    assert readers.csv_strings(spark, f"{path}/bom.csv").columns == ["a", "b"]
    (tmp_path / "latin.csv").write_bytes("n\ncaf\xe9\n".encode("latin-1"))
    assert [r[0] for r in readers.csv_any_encoding(spark, f"{path}/latin.csv").collect()] == ["café"]
    (tmp_path / "safe.csv").write_text("a,b,c\n1,,x\n,,\n2,,y\n")
    safe = readers.csv_safe(spark, f"{path}/safe.csv")
    assert safe.columns == ["a", "c"] and safe.count() == 2 and readers.csv_safe(spark, f"{path}/safe.csv", 1).count() == 1
    with pytest.warns(UserWarning):
        assert readers.csv_safe(spark, f"{path}/nowhere.csv") is None
    (tmp_path / "p1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "p2.csv").write_text("x,y,z\n3,4,5\n")
    assert [tuple(r) for r in readers.csv_positional_union(spark, [f"{path}/p1.csv", f"{path}/p2.csv"]).collect()] == [("1", "2"), ("3", "4")]
    assert {r["name"] for r in readers.listing(spark, path, "*.csv").collect()} >= {"p1.csv", "p2.csv"}
    assert readers.annotation_files(spark, [path], ["z.json"]).count() == 4
    (tmp_path / "kv.txt").write_text("# c\na = 1\n\nb=x=y\n")
    assert {r["key"]: r["value"] for r in readers.key_values(spark, f"{path}/kv.txt").collect()} == {"a": "1", "b": "x=y"}
    (tmp_path / "t.txt").write_text(" ".join(["w"] * 20) + "\n\n" + "short\n")
    assert readers.corpus_paragraphs(spark, f"{path}/t.txt").count() == 1
    (tmp_path / "map.xml").write_text("<u><loc> http://a </loc><loc>http://b</loc><loc>http://a</loc></u>")
    assert [r["url"] for r in readers.sitemap(spark, f"{path}/map.xml").collect()] == ["http://a", "http://b"]
    df = spark.createDataFrame([(1, True), (2, False)], "id int, chosen boolean")
    writers.split_write(df, "chosen", f"{path}/sel", f"{path}/rest")
    assert spark.read.parquet(f"{path}/sel").count() == spark.read.parquet(f"{path}/rest").count() == 1
    writers.append_manifest(df.filter("id = 1"), f"{path}/manifest")
    assert [r["id"] for r in writers.still_to_do(df, spark.read.json(f"{path}/manifest"), "id").collect()] == [2]
    writers.to_csv(df, f"{path}/out_csv")
    writers.to_jsonl(df, f"{path}/out_jsonl")
    assert spark.read.json(f"{path}/out_jsonl").count() == readers.csv_inferred(spark, f"{path}/out_csv").count() == 2
    assert json.loads(writers.json_array_text(df, ["id"]).collect()[0][0])[0] == {"id": 1, "chosen": True}
    writers.per_file(readers.json_union(spark, [f"{path}/b.json"], readers.ANNOTATION).select("id", "source_file"), f"{path}/per_file")


def test_ranks_of_wide_rows(spark):
    """Rows wider than their order, more than a sample of the ranges holds: every rank once, and in order."""
    df = spark.range(0, 200_000, numPartitions=20).withColumn("pad", F.sha2(F.col("id").cast("string"), 256)).withColumn("h", F.xxhash64("id"))
    got = sampling.global_rank(df, ["h"], 8).select("h", "rank", F.length("pad").alias("n")).collect()
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 200_001)) and all(a["h"] < b["h"] for a, b in zip(got, got[1:]))


def test_places_within_groups(spark):
    rows = [("a", 3), ("a", 1), (None, 5), ("b", 2), (None, 4), ("a", 2)]
    got = sampling.place_within(spark.createDataFrame(rows, "g string, i int"), "g", ["i"], "p").collect()
    assert {(r["g"], r["i"], r["p"], r["_size"]) for r in got} == {("a", 1, 1, 3), ("a", 2, 2, 3), ("a", 3, 3, 3), ("b", 2, 1, 1), (None, 4, 1, 2), (None, 5, 2, 2)}


def test_full_level(spark):
    rng = random.Random(5)
    for sizes in ([], [3], [1, 1, 9], [rng.randrange(1, 3000) for _ in range(30)]):
        df = spark.createDataFrame([(n,) for n in sizes], "_size long")
        for target in (0, 1, 7, 20_000):
            level = max((t for t in range(target + 1) if sum(min(n, t) for n in sizes) <= target), default=0)
            assert sampling.full_level(df, target) == (level, target - sum(min(n, level) for n in sizes))


def test_clip_and_scale(spark):
    """Percentiles against numpy's, with repeated and missing values; in a flat group the share of values below."""
    rng = random.Random(3)
    varied = [float(rng.randrange(40)) for _ in range(500)]
    flat = [0.0] + [5.0] * 300 + [9.0]
    rows = [("v", x) for x in varied] + [("f", x) for x in flat] + [("v", None), ("n", None)]
    got = charts.clip_and_scale(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()
    assert len(got) == len(rows)
    lo, hi = np.quantile(varied, 0.01), np.quantile(varied, 0.99)
    for r in got:
        if r["x"] is None:
            assert r["scaled"] is None
        elif r["g"] == "v":
            assert abs(r["scaled"] - (min(max(r["x"], lo), hi) - lo) / (hi - lo)) < 1e-12
        else:
            assert abs(r["scaled"] - {0.0: 0, 5.0: 1, 9.0: 301}[r["x"]] / 301) < 1e-12


def test_nearest_against_all_pairs(spark):
    """Two words, repeated and missing hashes, near ones within and beyond the bound."""
    rng = random.Random(8)
    seeds = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(6)]
    base = [(i, *s) for i, s in enumerate(seeds + seeds[:2])] + [(99, None, 1)]

    def flipped(s, n):
        bits = rng.sample(range(126), n)
        return s[0] ^ sum(1 << b for b in bits if b < 63), s[1] ^ sum(1 << (b - 63) for b in bits if b >= 63)

    queries = [(100 + k, *flipped(seeds[k % 6], k % 9)) for k in range(40)] + [(999, 1, None)]
    got = nearest.nearest_within(spark.createDataFrame(queries, "qid int, a long, b long"), spark.createDataFrame(base, "bid int, a long, b long"), ["a", "b"], 5, 7, 63).collect()
    want = {}
    for q, a, b in queries:
        near = [((a ^ x).bit_count() + (b ^ y).bit_count(), i) for i, x, y in base if None not in (a, b, x, y)]
        near = min((p for p in near if p[0] <= 5), default=(None, None))
        want[q] = (near[1], near[0])
    assert {r["qid"]: (r["bid"], r["distance"]) for r in got} == want


def test_with_each_in_blocks(spark):
    left, values = spark.createDataFrame([(i,) for i in range(7)], "i int"), spark.createDataFrame([(i,) for i in range(25)], "v int")
    for most in (4, 100):
        assert sorted(tuple(r) for r in reconcile.with_each(left, values, most).collect()) == [(i, v) for i in range(7) for v in range(25)]
