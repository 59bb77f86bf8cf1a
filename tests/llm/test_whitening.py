import math

import numpy as np
import pytest

from curatrix.llm import whitening
from curatrix.llm.common import table


def plain(rows, components=4):
    """Of (vec_id, vector) rows: n, the deviations, eigenvalues, and whitened values, by plain matrix products."""
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in sound), default=0)
    x = [tuple(math.floor(256 * c) for c in v) + (0,) * (width - len(v)) for _, v in sound]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    centred = np.array(fit, dtype=np.float64) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    top = np.argsort(-values, kind="stable")[:components]
    real = values[top] > 1e-12 * values.max()
    y = (np.array(x) - np.array(sums) / n) @ vectors[:, top]
    return [i for i, _ in sound], n, deviation, values[top], values.sum(), real, y / np.sqrt(np.where(real, values[top], np.nan))


def held(got, rows, components=4):
    ids, n, deviation, values, trace, real, y = plain(rows, components)
    got = [r.asDict() for r in got.collect()]
    assert len(got) == len(ids) * len(values)
    assert {r["n"] for r in got} == {n}
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["component"], r["deviation"]) for r in got), key=key) == sorted(((i, k + 1, d) for i, d in zip(ids, deviation) for k in range(len(values))), key=key)
    assert len({r["identity_error"] for r in got}) == 1
    if real.any():
        assert got[0]["identity_error"] <= 1e-4
    for k in range(len(values)):
        own = {(r["vec_id"], r["deviation"]): r for r in got if r["component"] == k + 1}
        ours = np.array([own[i, d]["whitened"] if real[k] else np.nan for i, d in zip(ids, deviation)])
        if real[k]:
            alone = k == 0 or values[k - 1] - values[k] > 1e-6 * values[0]
            alone = alone and (k + 1 == len(values) or values[k] - values[k + 1] > 1e-6 * values[0])
            assert alone and min(np.abs(ours - y[:, k]).max(), np.abs(ours + y[:, k]).max()) < 1e-6
            assert all(abs(r["explained"] - values[k] / trace) < 1e-9 for r in own.values())
        else:
            assert all(r["whitened"] is None for r in own.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, n long, whitened double")


def test_real_vectors_by_any_tiles(spark, sf):
    src = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in src.collect()]
    held(whitening.op12_embedding_whitening(spark, sf), rows)
    for tile, size in ((5, 37), (64, 4096), (1000, 1)):
        held(whitening.whiten(src.repartition(7), tile=tile, rows=size), rows)


def test_nulls_copies_and_lengths(spark):
    rand = np.random.default_rng(3)
    rows = [(i, (rand.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).tolist()) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(400)]  # copies don't count
    rows += [(501, None), (502, [1.0, None, 2.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, []), (506, [1.5]), (3, rows[3][1]), (None, rows[4][1]), (507, [-0.0] * 6)]
    held(whitening.whiten(frame(spark, rows), tile=4), rows)


@pytest.mark.parametrize("rows", [[(1, [2.0, 3.0])], [(1, [2.0]), (2, [3.0])], [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0, 5.0])]])
def test_few_vectors_and_no_variance(spark, rows):
    held(whitening.whiten(frame(spark, rows)), rows)


def test_large_numbers_are_exact(spark):
    rows = [(i, [1e7 * i, -3e6 * i + i * i]) for i in range(50)]
    ids, n, deviation, *_ = plain(rows)
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).filter("component = 1").collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in zip(ids, deviation)} and None in got.values()


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        got = whitening.whiten(frame(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_batches_are_bounded_by_bytes(spark):
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 256 << 20
