"""Boxes against loops over all pairs."""

import random

import numpy as np
import pytest

from curatrix.operators import spatial
from curatrix.plans import queries_boxes

BOX = "id long, x0 double, y0 double, x1 double, y1 double"


def meet(a, b):
    return a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]


def has(a, b):
    return meet(a, b) and a[1] <= b[1] and b[3] <= a[3] and a[2] <= b[2] and b[4] <= a[4]


def crowd():
    """Copies, edges that touch, negative places, boxes over many cells, none with an area, null sides."""
    draw = random.Random(8)
    rows = []
    for i in range(150):
        x, y = draw.choice([0.0, draw.randrange(-20, 20)]), draw.choice([0.0, draw.randrange(-20, 20)])
        rows.append((i, float(x), float(y), float(x + draw.choice([1, 2, 9])), float(y + draw.choice([1, 3, 7]))))
    rows += [(200 + k, 0.0, 0.0, 2.0, 2.0) for k in range(20)]
    return rows + [(300, 1.0, 1.0, 1.0, 5.0), (301, None, 0.0, 1.0, 1.0), (302, 5.0, 5.0, 4.0, 6.0)]


def solid(r):
    return None not in r and r[1] < r[3] and r[2] < r[4]


@pytest.mark.parametrize("block", [8, 2048])
def test_counts_equal_loop(spark, block):
    rows = crowd()
    df = spark.createDataFrame(rows, BOX)
    for relation, rule in ((spatial.overlap, meet), (spatial.contains, has)):
        want = {a[0]: sum(solid(a) and solid(b) and a[0] != b[0] and rule(a, b) for b in rows) for a in rows}
        assert {r["id"]: r["n"] for r in spatial.counted(df, 3.0, relation, block).collect()} == want


def test_empty_table_of_boxes(spark):
    none = spark.createDataFrame([], BOX)
    assert spatial.counted(none, 3.0).count() == 0 and spatial.placed(none, 3.0).count() == 0


def by_loop(rows, ranks):
    kept = []
    for r in sorted((r for r in rows if solid(r)), key=lambda r: ranks[r[0]]):
        if not any(meet(r, k) for k in kept):
            kept.append(r)
    return {r[0]: not solid(r) or r in kept for r in rows}


def ranks_of(df, seed=0):
    return {r["id"]: (r["h"], r["id"]) for r in df.selectExpr("id", f"xxhash64({seed}, id) AS h").collect()}


@pytest.mark.parametrize("seed", [0, 5])
def test_placed_equals_loop_over_the_order(spark, seed):
    df = spark.createDataFrame(crowd(), BOX)
    assert {r["id"]: r["kept"] for r in spatial.placed(df, 3.0, seed, 16).collect()} == by_loop(crowd(), ranks_of(df, seed))


def test_placed_query_over_the_whole_table(spark, sf):
    df = queries_boxes.boxes(spark, sf)
    rows = [tuple(r[c] for c in ("id", "x0", "y0", "x1", "y1")) for r in df.collect()]
    assert {r["id"]: r["kept"] for r in queries_boxes.u10(spark, sf).collect()} == by_loop(rows, ranks_of(df))


@pytest.mark.parametrize("first", [1, 8, 60])
def test_placed_in_parts_of_the_order_equals_loop(spark, first):
    df = spark.createDataFrame(crowd(), BOX)
    assert {r["id"]: r["kept"] for r in spatial.placed(df, 3.0, 2, 16, first).collect()} == by_loop(crowd(), ranks_of(df, 2))


def test_placed_writes_few_overlaps(spark, monkeypatch):
    """1,500 boxes that all overlap each other: 2,248,500 ordered pairs, of which few are written."""
    written, staged = [], spatial.scratch.staged

    def counting(df, name):
        out = staged(df, name)
        written.append(out.count() if name == "overlaps" else 0)
        return out

    monkeypatch.setattr(spatial.scratch, "staged", counting)
    monkeypatch.setattr(spatial.placed, "__defaults__", (0, 2048, 64), raising=False)
    rows = [(i, i / 2000, 0.0, 3.0, 3.0 - i / 4000) for i in range(1500)]
    df = spark.createDataFrame(rows, BOX)
    assert {r["id"]: r["kept"] for r in spatial.placed(df, 4.0).collect()} == by_loop(rows, ranks_of(df))
    assert sum(written) < 50_000


@pytest.mark.parametrize("relation", [spatial.overlap, spatial.contains])
def test_counts_make_no_row_for_a_pair(spark, monkeypatch, relation):
    """3,000 boxes of which all overlap each other; shapes of several rows, tiles of all sizes."""
    monkeypatch.setattr(spatial, "meetings", None)
    draw = random.Random(4)
    rows = [(i, draw.randrange(40) / 10, draw.randrange(40) / 10, 4.0 + draw.randrange(40) / 10, 4.0 + draw.randrange(40) / 10) for i in range(3000)]
    rule, df = {spatial.overlap: meet, spatial.contains: has}[relation], spark.createDataFrame(rows * 2, BOX)
    want = {a[0]: 2 * sum(rule(a, b) for b in rows) - 1 for a in rows[::100]}
    for cell in (0.5, 30.0):
        got = {r["id"]: r["n"] for r in spatial.counted(df, cell, relation).collect()}
        assert {k: got[k] for k in want} == want


@pytest.mark.parametrize("relation", [spatial.overlap, spatial.contains])
def test_counts_hold_only_near_boxes_against_each_other(monkeypatch, relation):
    """20,000 boxes in one place 64 wide: of 400,000,000 pairs few are looked at, as bits."""
    draw, bits, count = np.random.default_rng(3), [], np.bitwise_count
    low = draw.integers(0, 600, (20_000, 2)) / 10
    boxes, copies = np.column_stack([low, low + draw.integers(1, 5, (20_000, 2))]), draw.integers(1, 4, 20_000)
    monkeypatch.setattr(np, "bitwise_count", lambda words: bits.append(words.size * 64) or count(words))
    got = spatial._count(boxes, boxes, copies, spatial.BOUNDS[relation])
    assert sum(bits) / 2 < 0.25 * len(boxes) ** 2  # copies take two planes of bits
    rule = {spatial.overlap: meet, spatial.contains: has}[relation]
    for k in range(0, 20_000, 2500):
        a = (k, *boxes[k])
        assert got[k] == sum(int(n) for b, n in zip(boxes, copies) if rule(a, (None, *b)))


@pytest.mark.parametrize("relation", [spatial.overlap, spatial.contains])
def test_counts_equal_loop_in_small_parts(monkeypatch, relation):
    monkeypatch.setattr(spatial, "PART", 16, raising=False)
    rows = [r for r in crowd() if solid(r)]
    boxes, copies = np.array([r[1:] for r in rows]), np.arange(len(rows)) % 5 + 1
    rule = {spatial.overlap: meet, spatial.contains: has}[relation]
    want = [sum(int(n) for b, n in zip(rows, copies) if rule(a, b)) for a in rows]
    assert spatial._count(boxes, boxes, copies, spatial.BOUNDS[relation]).tolist() == want


@pytest.mark.parametrize("block", [4, 2048])
def test_counts_equal_loop_in_narrow_tiles(spark, monkeypatch, block):
    """Tiles of the cell's width, so that boxes lie in many of them."""
    monkeypatch.setattr(spatial, "IN_TILE", 0, raising=False)
    rows = crowd()
    df = spark.createDataFrame(rows, BOX)
    for relation, rule in ((spatial.overlap, meet), (spatial.contains, has)):
        want = {a[0]: sum(solid(a) and solid(b) and a[0] != b[0] and rule(a, b) for b in rows) for a in rows}
        assert {r["id"]: r["n"] for r in spatial.counted(df, 2.0, relation, block).collect()} == want
