"""Operator 8: tokenise, cut and pack whole documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Growing, Memory, as_bytes, chunks, span_hashes, stage, table, tidy, word_spans, words_per_text

SEQUENCE = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Words that one worker remembers, at about 40 bytes each; when full the memory starts anew.
REMEMBERED = 1_500_000
#: Bytes of text that are encoded at once; a longer text comes alone.
AT_ONCE = 1 << 20
#: Pieces of one length that are ranked in one window.
PART = 1 << 16
_workers: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts through a memory of words.

    The vocabulary's rules never join across ASCII white space, so the ids of a
    text are those of its words in order. A final point or comma after an ASCII
    letter is a token of its own, so such a word shares its stem's entry. The
    memory numbers word hashes beside one array of ids; a chunk of texts is
    looked up and laid out by array operations.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        #: For words of letters in normal form and lower case, where the normaliser and the split have nothing to do.
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = None
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.full.get_vocab_size()
        self.closes = np.array([(self.full.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.marks = {ord(m): self.full.encode(m, add_special_tokens=False).ids[0] for m in ".,"}
        self._forget()

    def _forget(self) -> None:
        self.words, self.at, self.n, self.flat = Memory(), Growing(np.uint32), Growing(np.uint32), Growing(np.uint32)

    def _lean(self, words: list[str]) -> list[np.ndarray] | None:
        ids = np.array(self.lean.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cut = np.flatnonzero(self.closes[ids]) + 1
        if len(cut) != len(words):
            return None
        return np.diff(cut, prepend=0), ids

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        import unicodedata

        plain, odd = [], []
        for k, w in enumerate(words):
            s = w.decode()
            (plain if s.isalpha() and s == s.lower() and (w.isascii() or unicodedata.is_normalized("NFC", s)) else odd).append((k, s))
        order, sizes, ids = [], [], []
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            if (got := self._lean([s for _, s in part])) is None:
                odd += part
                continue
            order += [k for k, _ in part]
            sizes.append(got[0])
            ids.append(got[1])
        for at in range(0, len(odd), 1024):
            part = odd[at : at + 1024]
            got = [np.array(e.ids, dtype=np.uint32) for e in self.full.encode_batch_fast([s for _, s in part], add_special_tokens=False)]
            order += [k for k, _ in part]
            sizes.append(np.array([len(x) for x in got], dtype=np.int64))
            ids += got
        n = np.concatenate(sizes)
        self.words.add(hashes[order])
        self.at.append(self.flat.size + np.cumsum(n) - n)
        self.n.append(n)
        for part in ids:
            self.flat.append(part)

    @staticmethod
    def _folded(text: bytes | None) -> bytes:
        """With A-Z in lower case where that can't change the ids: where composing and lowering then commute."""
        import unicodedata

        low = (text or b"").lower()
        return low if low.isascii() or unicodedata.is_normalized("NFC", low.decode()) else text

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each text has."""
        if self.words.size > REMEMBERED:
            self._forget()
        folded = [self._folded(t) for t in texts]
        joined = b" ".join(folded)
        raw = np.frombuffer(joined, dtype=np.uint8)
        first, last = word_spans(raw) if len(raw) else (np.zeros(0, dtype=np.int64),) * 2
        if not len(first):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        mark, letter = raw[last - 1], raw[np.maximum(last - 2, 0)] | 32
        tail = ((mark == 44) | (mark == 46)) & (last - first > 1) & (letter >= 97) & (letter <= 122)
        last = last - tail
        unique, index, inverse = np.unique(span_hashes(raw, first, last), return_index=True, return_inverse=True)
        number = self.words.find(unique)
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn(unique[new], [joined[a:b] for a, b in zip(first[index[new]].tolist(), last[index[new]].tolist())])
            number[new] = self.words.find(unique[new])
        place = number[inverse]
        n = self.n.data[place].astype(np.int64) + tail
        ends = np.cumsum(n)
        out = self.flat.data[np.minimum(np.repeat(self.at.data[place] - (ends - n), n) + np.arange(ends[-1]), self.flat.size - 1)]
        for code, id_ in self.marks.items():
            out[ends[tail & (mark == code)] - 1] = id_
        upto = np.concatenate(([0], ends))[np.cumsum(words_per_text(folded, first))]
        return out, np.diff(upto, prepend=0)


def encoder(path: str) -> WordEncoder:
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize_pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty: its one piece holds the end id alone. Null ids
    stay null. Repeated rows give repeated pieces. Other columns are dropped.
    """
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces(batches):
        encode = encoder(path or vocabulary())
        end = np.array([END], dtype="<u4")
        for batch in chunks(batches, AT_ONCE):
            ids, (flat, counts) = batch.column(0).to_pylist(), encode(as_bytes(batch.column(1)))
            rows: list[tuple] = []
            at = 0
            for doc, n in zip(ids, counts.tolist()):
                coded = np.concatenate((flat[at : at + n], end)).astype("<u4").tobytes()
                at += n
                for k, start in enumerate(range(0, n + 1, sequence)):
                    part = coded[start * 4 : (start + sequence) * 4]
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], space: int) -> dict[int, int]:
    """The fullest sum of at most space from counts[length] copies of each length, as length: copies.

    Subset sums are bits of one integer. Copies join in groups of 1, 2, 4, ...;
    the sums before each group are kept, to walk back from the best.
    """
    sums, steps = 1, []
    mask = (1 << (space + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], space // length) if length <= space else 0
        group = 1
        while left > 0:
            take = min(group, left)
            left -= take
            group *= 2
            new = sums | (sums << (length * take)) & mask
            if new != sums:
                steps.append((sums, length, take))
                sums = new
                if sums >> space & 1:
                    left = -1
        if left < 0:
            break
    at, chosen = sums.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Bins as (length: copies, how many bins alike), from how many pieces have each length.

    Each bin takes the longest length left and the fullest feasible combination
    beside it. The same bin is removed as often as its pieces last, so there are
    about as many kinds of bins as lengths, however many pieces there are.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    kinds = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({k: v for k, v in left.items() if v > 0}, sequence - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        kinds.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return kinds


def intervals(kinds: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a bin, first bin, offset): which ranks of a length go where."""
    used: dict[int, int] = {}
    rows, bin_ = [], 0
    for chosen, times in kinds:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n, rank = chosen[length], used.get(length, 0)
            rows.append((length, rank, rank + n * times, n, bin_, offset))
            used[length] = rank + n * times
            offset += n * length
        bin_ += times
    return rows


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Packs every document: the pieces of tokenize_pieces with sequence_id and offset.

    The number of pieces of each length (at most `sequence` numbers) comes to the
    driver, which solves the bins. A piece's rank among those of its length is
    counted in parts of about PART rows, so a common length is no single task's
    work; parts follow a row's place in the written table, so that repeated rows
    are spread as well. The parts' sizes are the only other rows on the driver.
    """
    spark = docs.sparkSession
    written = stage(tokenize_pieces(docs, path, sequence), "pieces")
    counts = {r["length"]: r["count"] for r in written.groupBy("length").count().collect()}
    shares = spark.createDataFrame([(length, -(-n // PART)) for length, n in counts.items()], "length long, parts long")
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    pieces = written.withColumn("row", row).join(F.broadcast(shares), "length").withColumn("salt", F.pmod("row", "parts")).drop("row", "parts")
    sizes = pieces.groupBy("length", "salt").count().collect()  # at most sequence + rows / PART
    before, last, total = [], None, 0
    for r in sorted(sizes, key=lambda r: (r["length"], r["salt"])):
        total = total if r["length"] == last else 0
        before.append((r["length"], r["salt"], total))
        last, total = r["length"], total + r["count"]
    places = intervals(minimum_bin_slack(counts, sequence))
    before_df = spark.createDataFrame(before, "length long, salt long, before long")
    places_df = spark.createDataFrame(places, "length long, lo long, hi long, copies long, bin long, at long")
    from pyspark.sql import Window as W

    ranked = (
        pieces.withColumn("nth", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(F.broadcast(before_df), ["length", "salt"])
        .withColumn("rank", F.col("nth") + F.col("before"))
    )
    placed = ranked.join(F.broadcast(places_df.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents."""
    return pack(table(spark, sf_dir, "documents"))
