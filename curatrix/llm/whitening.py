"""Operator 12: embedding whitening from a tiled covariance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stage, table, tidy

#: Dimensions of a column block; a tile is the product of two blocks.
TILE = 32
#: Vectors of a row block at most.
ROWS = 4096
#: Components that are returned.
COMPONENTS = 4
#: Each entry is multiplied by this before it is rounded down.
GRID = 256
#: Eigenvalues below this share of the largest one are zero to double precision.
RANK = 1e-12


def grid(vector: Column) -> Column:
    """The entries as whole numbers, floor(256 * c); null where the vector or an entry is null or not finite."""
    entries = vector.cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(entries, lambda c: F.floor(c * GRID).cast("long")))


def matrix_of(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column as whole numbers, shorter ones filled up by zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def packed(x: np.ndarray) -> tuple[bytes, int]:
    """An array's bytes in the smallest kind of whole number that holds it, and the bytes of one."""
    most = int(max(x.max(initial=0), -(x.min(initial=0) + 1)))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1))
    return np.ascontiguousarray(x).astype(f"<i{size}").tobytes(), size


def unpacked(data: bytes, size: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{size}").reshape(rows, -1)


def row_blocks(fit: DataFrame, width: int, rows: int) -> DataFrame:
    """(row_block, n, size, data, sums): the distinct vectors x in blocks of rows, written, so that their numbers stay."""
    import pyarrow as pa

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                x = matrix_of(b.column(0).slice(at, rows), width)
                data, size = packed(x)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([size], pa.int32()), pa.array([data], pa.binary()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "size", "data", "sums"])

    made = fit.mapInArrow(tidy(cut), "n long, size int, data binary, sums array<long>")
    return stage(made.withColumn("row_block", F.monotonically_increasing_id()), "rowblocks")


def covariance(blocks: DataFrame, n: int, sums: np.ndarray, tile: int) -> np.ndarray:
    """The covariance (divisor n) of the vectors in row blocks, tile by tile.

    Row blocks are cut into column blocks, which are shuffled by row block so that
    each two of them meet; a pair of column blocks is a tile key, and its product,
    centred before it is multiplied, is added to the task's sum of that tile. The
    sums are shuffled by tile key and added. To the driver comes one matrix, whose
    size is the square of the dimension, whatever the number of vectors.
    """
    import pyarrow as pa

    width = len(sums)
    mean = sums / n

    def columns(batches):
        for b in batches:
            for block, size, rows, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                x = unpacked(data, size, rows)
                for k in range(0, width, tile):
                    part = np.ascontiguousarray(x[:, k : k + tile])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([k // tile], pa.int32()), pa.array([size], pa.int32()), pa.array([rows], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["row_block", "k", "size", "n", "data"])

    cut = blocks.select("row_block", "size", "n", "data").mapInArrow(tidy(columns), "row_block long, k int, size int, n long, data binary")
    left = cut.select("row_block", F.col("k").alias("i"), "size", "n", F.col("data").alias("a"))
    right = cut.select("row_block", F.col("k").alias("j"), F.col("data").alias("b"))
    pairs = left.join(right, "row_block").filter("i <= j").select("i", "j", "size", "n", "a", "b")

    def multiplied(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, size, rows, one, other in zip(*(b.column(k).to_pylist() for k in range(6))):
                a = unpacked(one, size, rows) - mean[i * tile : (i + 1) * tile]
                c = a if i == j else unpacked(other, size, rows) - mean[j * tile : (j + 1) * tile]
                product = a.T @ c
                total[i, j] = total[i, j] + product if (i, j) in total else product
        for (i, j), product in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([product.ravel().tolist()], pa.list_(pa.float64()))], names=["i", "j", "product"])

    tiles = pairs.mapInArrow(tidy(multiplied), "i int, j int, product array<double>")
    cells = tiles.select("i", "j", F.posexplode("product").alias("place", "v")).groupBy("i", "j", "place").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda c: c["v"]).alias("product"))
    out = np.zeros((width, width))
    for r in whole.collect():  # a row for each two column blocks
        a, c = r["i"] * tile, r["j"] * tile
        part = np.array(r["product"]).reshape(min(tile, width - a), -1) / n
        out[a : a + part.shape[0], c : c + part.shape[1]] = part
        out[c : c + part.shape[1], a : a + part.shape[0]] = part.T
    return out


def measured_error(blocks: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors less the identity, from the vectors themselves."""
    import pyarrow as pa

    count = basis.shape[1]
    if not count:
        return None

    def moments(batches):
        first, second = np.zeros(count), np.zeros((count, count))
        for b in batches:
            for size, rows, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                y = (unpacked(data, size, rows) - mean) @ basis
                first += y.sum(axis=0)
                second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((first, second.ravel())).tolist()], pa.list_(pa.float64()))], names=["m"])

    parts = blocks.select("size", "n", "data").mapInArrow(tidy(moments), "m array<double>")
    sums = parts.select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # count * (count + 1) numbers
    m = np.array([v for _, v in sorted((r["k"], r["v"]) for r in sums)])
    middle = m[:count] / n
    found = m[count:].reshape(count, count) / n - np.outer(middle, middle)
    return float(np.abs(found - np.eye(count)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, rows: int = ROWS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of each sound vector and component.

    Rows whose vector is null or holds null or non-finite entries are dropped; a
    vector shorter than the longest counts zeros in the missing dimensions. The
    entries become x = floor(256 * c), and the covariance, mean and eigenvectors are
    those of each distinct x taken once, so copies change nothing. Repeated rows
    and null ids give their own rows. There are as many components as dimensions
    at most. Where an eigenvalue is zero to double precision whitened is null, and
    identity_error leaves that component out; where the trace is zero explained is
    null. deviation is null if it exceeds a long; entries beyond 2^40 are beyond
    the whole numbers used here. Further columns are dropped; an empty table, or
    one of empty vectors, gives an empty result. To the driver come sums for each dimension
    and the covariance, to the tasks the mean and a few eigenvectors.
    """
    import pyarrow as pa

    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), grid(F.col("embedding")).alias("x")).filter("x IS NOT NULL")
    width = sound.agg(F.max(F.size("x")).alias("w")).collect()[0]["w"] or 0
    if not width:
        return vectors.sparkSession.createDataFrame([], names)
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    blocks = row_blocks(sound.select(filled.alias("x")).distinct(), width, rows)
    n = blocks.agg(F.sum("n").alias("n")).collect()[0]["n"]
    by = {r["k"]: int(r["s"]) for r in blocks.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # one for each dimension
    sums = [by[k] for k in range(width)]
    mean = np.array([s / n for s in sums])
    v = covariance(blocks, n, np.array(sums, dtype=np.float64), tile)
    values, vectors_ = np.linalg.eigh(v)
    count = min(components, width)
    top = values[::-1][:count]
    trace = float(np.trace(v))
    real = [k for k in range(count) if top[k] > RANK * max(top[0], 0)]
    basis = vectors_[:, ::-1][:, real] / np.sqrt(top[real])
    error = measured_error(blocks, mean, basis, n)
    drop(blocks)
    shares = [float(top[k] / trace) if trace > 0 else None for k in range(count)]
    # below this the sum of squares stays within 64 bits
    safe = np.sqrt(2.0**62 / width) / n

    def rows_of(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column(1), width)
            whole = np.abs(x - mean).max() < safe and all(abs(s) < 1 << 62 for s in sums) and int(np.abs(x).max()) * n < 1 << 62
            if whole:
                deviation = ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
                deviation = [d if d < 1 << 63 else None for d in exact]
            y = (x - mean) @ basis
            ids = b.column(0)
            for k in range(count):
                own = pa.array(y[:, real.index(k)]) if k in real else pa.nulls(len(x), pa.float64())
                same = lambda value, kind: pa.array([value] * len(x), kind)
                yield pa.RecordBatch.from_arrays([ids, same(k + 1, pa.int32()), same(n, pa.int64()), pa.array(deviation, pa.int64()), own, same(shares[k], pa.float64()), same(error, pa.float64())], names=[f.split(" ")[0] for f in names.split(", ")])

    return sound.mapInArrow(tidy(rows_of), names)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() over all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
