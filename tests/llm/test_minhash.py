import random

import numpy as np
import pytest

from curatrix.llm import components, minhash
from curatrix.llm.common import table

from .helpers import components as plain_components
from .helpers import documents, shingles


def brute(rows, size, similarity):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and sets[b]]
    return sets, plain_components(ids, links)


def check(got, rows, size, similarity):
    sets, comp = brute(rows, size, similarity)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def copies(n, words=120, seed=0):
    """A text and copies with more and more words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = [" ".join(base)]
    for k in range(n - 1):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_table_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    check(minhash.op1_minhash_near_dedup(spark, sf).collect(), rows, 3, 85)


def test_edges_and_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = list(enumerate(copies(90) + ["", None, " \t\n", "One two", "one TWO", "one two three", "ß É", "a\x0bb\x0cc d e", "a b c d e"] + ["same text here again"] * 5))
    rows.append((len(rows), "long " + " ".join(f"t{i}" for i in range(30_000))))
    check(minhash.near_documents(documents(spark, rows), 3, 85).collect(), rows, 3, 85)


def test_empty_nulls_and_repeated_rows(spark):
    assert minhash.near_documents(documents(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_documents(documents(spark, rows)).collect())
    assert got == [(-1, None, True), (-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = minhash.keep(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns and kept.count() == 4


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == plain_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounds_miss_few():
    """Pairs at the similarity itself pass the sequential test."""
    rng = np.random.default_rng(0)
    most = minhash.bounds(0.85)
    differ = np.cumsum(rng.binomial(minhash.BATCH, (1 - 0.85) / 2, (20_000, len(most))), axis=1)
    assert (differ <= most).all(axis=1).mean() > 0.999
    far = np.cumsum(rng.binomial(minhash.BATCH, (1 - 0.3) / 2, (2_000, len(most))), axis=1)
    assert (far <= most).all(axis=1).mean() < 0.01
