"""Boxes that overlap or contain each other, and placement without overlap, over whole tables."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

SIDES = ["x0", "y0", "x1", "y1"]
#: Boxes of one block; a cell with more is cut into several, of which each two meet apart.
BLOCK = 2048
#: Boxes of the first part of an order, and how many times those before it each further part has.
FIRST, GROWTH = 8192, 8
#: Boxes of one block where pairs are counted and not made; those of one part; how many a tile has on the average, where cells are not crowded.
COUNTED, PART, IN_TILE = 1 << 18, 2048, 4096
COMPARED = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def overlap(a: str, b: str) -> Column:
    """Whether two boxes share an area, not only an edge."""
    return (F.col(f"{a}x0") < F.col(f"{b}x1")) & (F.col(f"{b}x0") < F.col(f"{a}x1")) & (F.col(f"{a}y0") < F.col(f"{b}y1")) & (F.col(f"{b}y0") < F.col(f"{a}y1"))


def contains(a: str, b: str) -> Column:
    """Whether box a has all of box b, edges included."""
    return (F.col(f"{a}x0") <= F.col(f"{b}x0")) & (F.col(f"{b}x1") <= F.col(f"{a}x1")) & (F.col(f"{a}y0") <= F.col(f"{b}y0")) & (F.col(f"{b}y1") <= F.col(f"{a}y1"))


#: Relations that counted() knows as four bounds: a side of b, how it compares, a side of a.
BOUNDS = {
    overlap: [(0, "<", 2), (2, ">", 0), (1, "<", 3), (3, ">", 1)],
    contains: [(0, ">=", 0), (2, "<=", 2), (1, ">=", 1), (3, "<=", 3)],
}


def shapes(boxes: DataFrame) -> DataFrame:
    """x0, y0, x1, y1, n: the different boxes that have an area, and how many rows have each."""
    return boxes.filter("x0 < x1 AND y0 < y1").groupBy(*SIDES).agg(F.count(F.lit(1)).alias("n"))


def meetings(boxes: DataFrame, cell: float, relation: Callable[[str, str], Column], block: int = BLOCK) -> DataFrame:
    """Every ordered pair (a_..., b_...) of different shapes that share an area and stand in a relation.

    A shape lies in all cells of a grid that it touches; two meet in the first cell
    they share. A cell with more than `block` shapes is dealt into blocks by hash,
    and each two blocks are a key of their own, so no key has more than about two
    blocks. The grid's cell should be near the size of a usual box.
    """
    spread = _cells(boxes, cell)
    crowded = spread.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block).select("cx", "cy", F.ceil(F.col("m") / block).alias("blocks"))
    dealt = spread.join(crowded, ["cx", "cy"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*SIDES), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    at = ["cx", "cy", "lo", "hi"]
    side = lambda p: dealt.select(*at, *[F.col(c).alias(p + c) for c in [*boxes.columns, "fx", "fy", "own"]])
    here = (F.col("cx") == F.greatest("a_fx", "b_fx")) & (F.col("cy") == F.greatest("a_fy", "b_fy"))
    once = (F.col("lo") == F.col("hi")) | (F.col("a_own") != F.col("b_own"))
    unlike = ~(contains("a_", "b_") & contains("b_", "a_"))
    met = side("a_").join(side("b_"), at).filter(here & once & unlike & overlap("a_", "b_") & relation("a_", "b_"))
    return met.select(*[F.col(p + c) for p in ("a_", "b_") for c in boxes.columns])


def _near(t: np.ndarray) -> np.ndarray:
    """An order of rows of sides in which those of a part lie near each other: strips by x0, each by y0."""
    width = PART * math.ceil(math.sqrt(-(-len(t) // PART)))
    by = np.argsort(t[:, 0], kind="stable")
    return np.concatenate([s[np.argsort(t[s, 1], kind="stable")] for s in np.split(by, range(width, len(by), width))])


def _count(a: np.ndarray, b: np.ndarray, weight: np.ndarray, bounds: list[tuple[int, str, int]]) -> np.ndarray:
    """For each row of a the weight of the rows of b that meet all bounds (column of b, comparison, column of a).

    b is taken in parts of rows that lie near each other, and each part is held only
    against the rows of a that its extremes admit. The rows of a part that a bound
    admits are the first or last ones in the order of its column: sets of all such
    beginnings are made as bits, each row of a looks up one set for each bound that
    the extremes leave open, and what is in all of them is counted by bits.
    """
    total = np.zeros(len(a), dtype=np.int64)
    order = _near(b)
    sides = [np.ascontiguousarray(a[:, k]) for k in range(len(SIDES))]
    for at in range(0, len(b), PART):
        part, copies = b[order[at : at + PART]], weight[order[at : at + PART]]
        low, high = part.min(axis=0), part.max(axis=0)
        may = np.ones(len(a), dtype=bool)
        for column, comparison, other in bounds:
            may &= COMPARED[comparison]((low if comparison in ("<", "<=") else high)[column], sides[other])
        near = np.flatnonzero(may)
        if not len(near):
            continue
        size, words = len(part), -(-len(part) // 64)
        row = np.arange(size)
        found = []
        for column, comparison, other in bounds:
            than = sides[other][near]
            if COMPARED[comparison]((high if comparison in ("<", "<=") else low)[column], than).all():
                continue  # every row of the part meets it
            by = np.argsort(part[:, column], kind="stable")
            place = np.searchsorted(part[by, column], than, side="left" if comparison in ("<", ">=") else "right")
            if comparison in (">", ">="):
                by, place = by[::-1], size - place
            sets = np.zeros((size + 1, words), dtype=np.uint64)
            sets[row + 1, by // 64] = np.uint64(1) << (by % 64).astype(np.uint64)
            np.bitwise_or.accumulate(sets, axis=0, out=sets)
            found.append((sets, place))
        if not found:
            total[near] += copies.sum()
            continue
        planes = []
        for bit in range(int(copies.max()).bit_length()):
            plane = np.zeros(words * 64, dtype=np.uint8)
            plane[:size] = copies >> bit & 1
            planes.append((1 << bit, np.packbits(plane, bitorder="little").view("<u8")))
        for start in range(0, len(near), 4096):
            rows = slice(start, start + 4096)
            both = found[0][0][found[0][1][rows]]
            for sets, place in found[1:]:
                both &= sets[place[rows]]
            for value, plane in planes:
                total[near[rows]] += value * np.bitwise_count(both & plane).sum(axis=1, dtype=np.int64)
    return total


def _tallied(relation: Callable[[str, str], Column]):
    """Of two tables of one tile: how much of the second each row of the first meets, of pairs that are counted in this tile."""
    bounds = BOUNDS[relation]

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(len(left), dtype=np.int64)
        right = right.rename_columns([c.removeprefix("b_") for c in right.column_names])
        if len(left) and len(right):
            a, b = (np.column_stack([t.column(c).to_numpy() for c in SIDES]) for t in (left, right))
            weight = right.column("n").to_numpy()
            (ax, ay), (bx, by) = ((t.column("sx").to_numpy(), t.column("sy").to_numpy()) for t in (left, right))
            if relation is contains:
                # a box begins within all that contain it, so the tile it begins in is one of theirs
                kinds = [(np.ones(len(a), dtype=bool), bx & by)]
            else:
                # one of the two must begin in this tile, by each axis
                kinds = [((ax == x) & (ay == y), (bx | x) & (by | y)) for x in (True, False) for y in (True, False)]
            for mine, theirs in kinds:
                if mine.any() and theirs.any():
                    total[mine] = _count(a[mine], b[theirs], weight[theirs], bounds)
        return pa.table({c: left.column(c) for c in SIDES} | {"total": pa.array(total)})

    return tally


def _totals(known: DataFrame, cell: float, relation: Callable[[str, str], Column], block: int) -> DataFrame:
    """x0, y0, x1, y1, total: for each shape (sides, n) the rows of all shapes it meets by a relation of BOUNDS, its own among them.

    No pair is a row: shapes lie in the tiles they touch and are counted tile by
    tile. Tiles are the cells or up to sixteen times as wide, so that they hold some
    thousands of shapes and most shapes lie in one; a tile goes to Python once. One
    with more than `block` shapes is dealt into blocks by hash, each two of which are
    counted apart.
    """
    crowd = known.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(F.floor(F.col("x0") / cell), F.floor(F.col("y0") / cell))).alias("cells")).first()
    tile = cell
    while tile < 16 * cell and crowd["n"] * (tile / cell) ** 2 < IN_TILE * crowd["cells"]:
        tile *= 2
    spread = _cells(known, tile).withColumn("sx", F.col("fx") == F.col("cx")).withColumn("sy", F.col("fy") == F.col("cy")).drop("fx", "fy")
    # at most one row for each `block` shapes in tiles
    crowded = F.broadcast(spread.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block).select("cx", "cy", F.ceil(F.col("m") / block).alias("blocks")))
    tally, columns, schema = _tallied(relation), [*SIDES, "n", "sx", "sy"], ", ".join(f"{c} double" for c in SIDES) + ", total long"
    usual = spread.join(crowded, ["cx", "cy"], "left_anti").groupBy("cx", "cy").applyInArrow(lambda t: tally(t, t), schema)
    dealt = spread.join(crowded, ["cx", "cy"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*SIDES), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = dealt.select("cx", "cy", F.col("own").alias("i"), F.col("other").alias("j"), *columns)
    right = dealt.filter("sx AND sy") if relation is contains else dealt
    right = right.select(*[F.col(c).alias("b_" + k) for c, k in [("cx", "cx"), ("cy", "cy"), ("other", "i"), ("own", "j"), *zip(columns, columns)]])
    at = ["cx", "cy", "i", "j"]
    parts = usual.unionByName(left.groupBy(*at).cogroup(right.groupBy(*["b_" + c for c in at])).applyInArrow(tally, schema))
    return parts.groupBy(*SIDES).agg(F.sum("total").alias("total"))


def counted(boxes: DataFrame, cell: float, relation: Callable[[str, str], Column] = overlap, block: int = COUNTED) -> DataFrame:
    """id, n: how many other boxes (id, x0, y0, x1, y1) each overlaps, or what else the relation says.

    Equal boxes are compared as one, so copies cost nothing. A box without an area,
    or with a null side, meets nothing and has 0.
    """
    sides = [F.col(c).cast("double").alias(c) for c in SIDES]
    known = shapes(boxes.select("id", *sides))
    if relation in BOUNDS:
        whole = _totals(scratch.staged(known, "shapes"), cell, relation, block).select(*SIDES, (F.col("total") - 1).alias("n"))
    else:
        known = scratch.staged(known.withColumn("sid", F.monotonically_increasing_id()), "shapes")
        others = meetings(known, cell, relation, block).groupBy("a_sid").agg(F.sum("b_n").alias("others"))
        whole = known.join(others, F.col("sid") == F.col("a_sid"), "left").select(*SIDES, (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n"))
    return boxes.select("id", *sides).join(whole, SIDES, "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def _cells(boxes: DataFrame, cell: float) -> DataFrame:
    """Each box in every cell (cx, cy) of the grid that it touches, with its first one (fx, fy)."""
    first = lambda c: F.floor(F.col(c) / cell)
    last = lambda c: F.ceil(F.col(c) / cell) - 1
    spread = boxes.withColumn("fx", first("x0")).withColumn("fy", first("y0"))
    return spread.withColumn("cx", F.explode(F.sequence("fx", F.greatest(last("x1"), "fx")))).withColumn("cy", F.explode(F.sequence("fy", F.greatest(last("y1"), "fy"))))


def _clear_of(boxes: DataFrame, placed_: DataFrame, cell: float) -> DataFrame:
    """The boxes that overlap none of the placed ones."""
    a = _cells(boxes.select("rank", *[F.col(c).alias("a_" + c) for c in SIDES], *SIDES), cell).select("rank", "cx", "cy", *["a_" + c for c in SIDES])
    b = _cells(placed_, cell).select(F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"), *[F.col(c).alias("b_" + c) for c in SIDES])
    hit = a.join(b, (F.col("cx") == F.col("b_cx")) & (F.col("cy") == F.col("b_cy")) & overlap("a_", "b_"), "left_semi")
    return boxes.join(hit.select("rank").distinct(), "rank", "left_anti")


def _first_come(boxes: DataFrame, cell: float, block: int) -> DataFrame:
    """The boxes, by rank, that no kept one of a smaller rank overlaps, in rounds over the overlaps.

    A box that goes before all undecided ones it overlaps is kept, and those that
    overlap it are dropped.
    """
    met = meetings(boxes, cell, overlap, block).select(F.col("a_rank").alias("a"), F.col("b_rank").alias("b"))
    links = scratch.staged(met.filter("a < b"), "overlaps")
    open_, kept = boxes.select("rank"), []
    while not links.isEmpty():
        # one is beaten while an undecided neighbour goes before it
        won = scratch.staged(open_.join(links.select(F.col("b").alias("rank")).distinct(), "rank", "left_anti"), "kept")
        out = links.join(won, links["a"] == won["rank"], "left_semi").select(F.col("b").alias("rank")).distinct()
        left = scratch.staged(open_.join(won, "rank", "left_anti").join(out, "rank", "left_anti"), "undecided")
        inner = links.join(left, links["a"] == left["rank"], "left_semi")
        fewer = scratch.staged(inner.join(left, inner["b"] == left["rank"], "left_semi"), "overlaps")
        scratch.drop(links, open_)
        links, open_ = fewer, left
        kept.append(won)
    for won in kept:
        open_ = open_.unionByName(won)
    return boxes.join(open_, "rank", "left_semi")


def placed(boxes: DataFrame, cell: float, seed: int = 0, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """id, kept: boxes (id, x0, y0, x1, y1) placed by hashed priority, each if it overlaps none placed before it.

    The order is taken in parts, of about `first` boxes and then each GROWTH times
    the ones before. A part's boxes that overlap one placed before go at once; as
    the order is random, what is left of a part overlaps only little among itself,
    so its overlaps, which alone are written, don't grow with the square of the
    boxes. What a loop over the part would keep comes out of rounds (_first_come).
    Of equal boxes the first counts. A box without an area or with a null side
    overlaps nothing and is kept.
    """
    order = F.struct(F.xxhash64(F.lit(seed), F.col("id")).alias("h"), F.col("id").alias("id"))
    rows = boxes.select("id", *SIDES).withColumn("rank", order)
    solid = scratch.staged(rows.filter("x0 < x1 AND y0 < y1").groupBy(*SIDES).agg(F.min("rank").alias("rank")), "boxes")
    n, done, chosen = solid.count(), 0, None
    while done < n:
        upto = min(n, max(first, done * GROWTH))
        # the hashes are spread evenly, so a share of their range has about that share of the boxes
        low, high = (-(1 << 63) + (1 << 64) * k // n for k in (done, upto))
        part = solid.filter((F.col("rank.h") >= low) & (F.col("rank.h") <= min(high - 1, (1 << 63) - 1)))
        part = part if chosen is None else scratch.staged(_clear_of(part, chosen, cell), "free")
        won = scratch.staged(_first_come(part, cell, block), "placed")
        chosen = won if chosen is None else chosen.unionByName(won)
        done = upto
    won = rows.select("rank").limit(0) if chosen is None else chosen.select("rank")
    found = rows.join(won.withColumn("won", F.lit(True)), "rank", "left")
    empty = ~F.coalesce((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.lit(False))
    return found.select("id", (empty | F.coalesce("won", F.lit(False))).alias("kept"))
