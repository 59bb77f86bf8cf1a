"""What the operators share: tables in the shared folder, words, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the contracts' words: space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_own: dict[str, str] = {}


#: Bits of the map that tells most rows from those that are to go, a table of at most so many / 64 rows.
GONE_BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in a local session that doesn't name any."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="curatrix-")
    return _own["dir"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def without(docs: DataFrame, key, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key (a list of long columns) isn't among the rows of gone (its columns, in that order).

    Whole rows are hardly shuffled: a bit map of the hashes of what is to go, of a
    fixed size, lets most rows stay at once; the others, those that are to go and
    a few by chance, are joined. Rows with a null in the key stay.
    """
    names = [f"_gone{k}" for k in range(len(key))]
    gone = stage(gone.toDF(*names).dropna().distinct(), "gone")
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(GONE_BITS))
    bit = F.pmod(F.col("_at"), F.lit(64)).cast("int")
    words = gone.select(place(names).alias("_at")).select(F.floor(F.col("_at") / 64).cast("int").alias("_word"), bit.alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    # the row is one column, so that no name in it can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[k.alias(f"_key{i}") for i, k in enumerate(key)])
    keyed = keyed.withColumn("_at", place([f"_key{i}" for i in range(len(key))]))
    marked = keyed.join(F.broadcast(words), F.floor(F.col("_at") / 64).cast("int") == F.col("_word"), "left")
    hit = F.coalesce(F.getbit(F.col("_bits"), bit) == 1, F.lit(False))
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & (F.col(f"_key{i}") == F.col(n))
    stay = marked.filter(~hit).select("_row")
    return stay.unionByName(marked.filter(hit).join(gone, same, "left_anti").select("_row")).select("_row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches, size: int, column: str = "text"):
    """Arrow batches cut so that one holds about size bytes of the column; a longer text comes alone."""
    for batch in batches:
        col = batch.column(column)
        start, total = 0, 0
        lengths = np.array([0 if not v.is_valid else len(v.as_buffer() or b"") for v in col], dtype=np.int64)
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, on an array of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at once; arrays of eight bytes for each are the most that hashing holds.
STRIDE = 1 << 19
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64),) * 2


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for a stride of bytes; longer tables are made anew and not kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, STRIDE + 1)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        made = tuple(np.concatenate(([np.uint64(1)], np.full(size - 1, b))).cumprod(dtype=np.uint64) for b in (_BASE, inverse))
    if size == STRIDE + 1:
        _powers = made
    return made


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte array begin and end."""
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[0::2], edge[1::2]


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over random numbers of its bytes, from differences of one running sum.

    Spans must be in order. They are taken a stride of bytes at a time, so that
    memory grows with the spans and not with the bytes between them; a span
    longer than a stride is taken alone.
    """
    out = np.empty(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):
        begin = int(first[at])
        to = max(at + 1, int(np.searchsorted(last, begin + STRIDE, side="right")))
        part = raw[begin : int(last[to - 1])]
        powers, inverses = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[part] * powers[: len(part)], out=total[1:])
            a, b = first[at:to] - begin, last[at:to] - begin
            out[at:to] = mix((total[b] - total[a]) * inverses[a])
        at = to
    return out


def words_per_text(texts: list[bytes | None], first: np.ndarray) -> np.ndarray:
    """How many words each text has, when the texts are joined by one space."""
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.diff(np.searchsorted(first, ends, side="left"), prepend=0)


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of every text, in order, and how many words each text has; no Python object is made for a word."""
    joined = b" ".join(t or b"" for t in texts)
    if lower:
        joined = joined.translate(_LOWER)
    raw = np.frombuffer(joined, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    first, last = word_spans(raw)
    return span_hashes(raw, first, last), words_per_text(texts, first)


class Memory:
    """Numbers, from 0 on, of 64-bit keys in the order they were added.

    A large sorted part and a small one; the small one is merged into the large
    one when it has a quarter of its size, so that a key is moved a few times only.
    """

    def __init__(self):
        self.size = 0
        self.parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32))] * 2

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that aren't known."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, number in self.parts:
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[place] == keys
                out[hit] = number[place[hit]]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that aren't known."""
        (large, a), small = self.parts[0], self._merged(self.parts[1], (keys, np.arange(self.size, self.size + len(keys), dtype=np.uint32)))
        self.size += len(keys)
        if 4 * len(small[0]) > len(large):
            self.parts = [self._merged((large, a), small), self.parts[1]]
            self.parts[1] = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32))
        else:
            self.parts = [(large, a), small]

    @staticmethod
    def _merged(a, b):
        keys = np.concatenate((a[0], b[0]))
        by = np.argsort(keys, kind="stable")
        return keys[by], np.concatenate((a[1], b[1]))[by]


class Growing:
    """An array to append to, with room to spare so that it is seldom copied."""

    def __init__(self, dtype):
        self.room, self.size = np.zeros(1024, dtype=dtype), 0

    def append(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            room = np.zeros(max(need, len(self.room) * 3 // 2), dtype=self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : need] = values
        self.size = need

    @property
    def data(self) -> np.ndarray:
        return self.room[: self.size]


def tidy(rows):
    """Wraps a function of Arrow batches: when a task ends, its worker gives free memory back to the system."""

    def run(*batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from rows(*batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
