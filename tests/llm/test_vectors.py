import math

import numpy as np

from curatrix.llm import vectors
from curatrix.llm.common import table

from .helpers import components


def brute(rows):
    good = [(i, l, np.array(v, dtype=np.float64)) for i, l, v in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, n = [], {i: 0 for i, _, _ in rows}
    for k, (a, la, x) in enumerate(good):
        for b, lb, y in good[k + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    return n, components([i for i, _, _ in rows], links)


def check(got, rows):
    n, comp = brute(rows)
    assert {r["vec_id"]: r["n_links"] for r in got} == n
    assert {r["vec_id"]: r["component_id"] for r in got} == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def made(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, l, "z") for i, l, v in rows], "vec_id long, embedding array<float>, label int, kept string")


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, i = [], 0
    for g in range(6):
        c = rng.normal(size=32)
        for k in range(60 if g == 0 else 5):
            rows.append((i, g % 3, np.float32(c + rng.normal(size=32) * 0.08 * (1 + k % 3)).tolist()))
            i += 1
    rows += [(i + k, 0, np.float32(rng.normal(size=32)).tolist()) for k in range(40)]
    i += 40
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("inf")] + [1.0] * 31, [float("nan")] * 32]
    rows += [(i + k, 1, v) for k, v in enumerate(odd)]
    i += len(odd)
    rows += [(i, None, rows[0][2]), (i + 1, 0, rows[0][2]), (i + 2, 0, rows[0][2]), (i + 3, 1, [1e300 if k == 0 else 0.0 for k in range(32)][:0] or [3.0] * 32), (i + 4, 1, [6.0] * 32)]
    check(vectors.near_vectors(made(spark, rows), block=16).collect(), rows)


def test_table(spark, sf):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    check(vectors.op10_embedding_near_dedup(spark, sf).collect(), rows)


def test_empty(spark):
    assert vectors.near_vectors(made(spark, [])).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    z = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    a, b = vectors.bucket_keys(x), vectors.bucket_keys(z)
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.999
