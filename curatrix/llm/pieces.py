"""Operator 3: SentencePiece models on the tokenizers library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Growing, Memory, as_bytes, chunks, span_hashes, table, tidy

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments that one worker remembers; when full the memory starts anew.
REMEMBERED = 1_500_000
AT_ONCE = 1 << 20
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_workers: dict[str, "PieceCoder"] = {}


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: bytes, or the raw integer of a fixed or variable number."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value = data[at : at + n]
            at += n
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield tag >> 3, value


class ModelFile:
    """What a SentencePiece model file says: pieces, scores, kinds, and how texts are normalised."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.model_type = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        self.unk = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else None

    @property
    def plain(self) -> bool:
        """Whether normalising only marks spaces, so that segments can be coded one by one."""
        return not self.charsmap and not self.squeeze and self.dummy_prefix and self.escape and USER not in self.kinds and not any(SPACE in p.lstrip(SPACE) for p in self.pieces)


def merges(model: ModelFile) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best piece first, as a BPE model of scores applies them."""
    usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER, UNUSED)}
    found = []
    for piece, i in usable.items():
        for cut in range(1, len(piece)):
            a, b = usable.get(piece[:cut]), usable.get(piece[cut:])
            if a is not None and b is not None:
                found.append((-model.scores[i], i, a, b))
    found.sort()
    return [(model.pieces[a], model.pieces[b]) for _, _, a, b in found]


def build(model: ModelFile):
    """A tokenizers.Tokenizer of the model: normaliser, space marker, scores or merges, byte fallback and decoder."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=model.unk, byte_fallback=model.byte_fallback)
    elif model.model_type == BPE:
        vocab = {p: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk] if model.unk is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    out.normalizer = normalizers.Sequence(steps)
    if not any(SPACE in p.lstrip(SPACE) for p in model.pieces):
        # No piece goes on over a space, so words can be cut before the model runs, and its cache then helps.
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    user = [p for p, k in zip(model.pieces, model.kinds) if k == USER]
    if user:
        out.add_tokens([AddedToken(p, normalized=False) for p in user])
    return out


class PieceCoder:
    """Encodes and decodes batches of texts on several threads, and holds both against the sentencepiece library.

    Where normalising only marks spaces, a text is a row of segments, spaces and
    then other characters, and no piece reaches over two. Distinct segments are
    coded once, checked once, and looked up by hash. Where a model's normaliser
    does more, whole texts are coded and checked.
    """

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = ModelFile(f.read())
        self.tokenizer = build(self.model)
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self._forget()

    def _forget(self) -> None:
        self.segments, self.at, self.n, self.good, self.flat = Memory(), Growing(np.uint32), Growing(np.uint32), Growing(np.int8), Growing(np.uint32)

    def checked(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """The tokenizers library's ids of texts; bit 0 of the flags: sentencepiece has the same, bit 1: decoding gives the text again."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # the batch is coded on several threads
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parity = np.array([a == b for a, b in zip(ours, self.judge.encode(texts, num_threads=1))])
        whole = np.array([a == b for a, b in zip(self.tokenizer.decode_batch(ours, skip_special_tokens=False), texts)])
        return ours, parity.astype(np.int8) | (whole.astype(np.int8) << 1)

    def _learn(self, hashes: np.ndarray, segments: list[bytes]) -> None:
        ids, flags = self.checked([s[1:].decode() for s in segments])
        for k, s in enumerate(segments):
            if s == b" ":  # a last space alone: coded without its prefix it would be an empty text
                ids[k] = [self.model.pieces.index(SPACE)]
        n = np.array([len(x) for x in ids], dtype=np.int64)
        self.segments.add(hashes)
        self.at.append(self.flat.size + np.cumsum(n) - n)
        self.n.append(n)
        self.good.append(flags)
        self.flat.append(np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(n.sum())))

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids end to end, how many each text has, and each text's flags as in checked()."""
        if not self.model.plain:
            ids, flags = self.checked([(t or b"").decode() for t in texts])
            return np.fromiter((i for x in ids for i in x), dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64), flags
        if self.segments.size > REMEMBERED:
            self._forget()
        # Each text begins with the prefix space. One that holds the space marker itself is one segment.
        rows = [b" " + t if t else b"" for t in texts]
        joined = b"".join(rows)
        raw = np.frombuffer(joined, dtype=np.uint8)
        if not len(raw):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64), np.full(len(texts), 3, dtype=np.int8)
        ends = np.cumsum([len(r) for r in rows])
        space = raw == 32
        begins = space.copy()  # a segment begins at a space after another character, or where a text begins
        begins[1:] &= ~space[:-1]
        starts = np.concatenate(([0], ends[:-1]))
        for k, r in enumerate(rows):
            if SPACE.encode() in r:
                begins[starts[k] : ends[k]] = False
        begins[starts[ends > starts]] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(raw))
        unique, index, inverse = np.unique(span_hashes(raw, first, last), return_index=True, return_inverse=True)
        number = self.segments.find(unique)
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn(unique[new], [joined[a:b] for a, b in zip(first[index[new]].tolist(), last[index[new]].tolist())])
            number[new] = self.segments.find(unique[new])
        place = number[inverse]
        n = self.n.data[place].astype(np.int64)
        total = np.cumsum(n)
        out = self.flat.data[np.repeat(self.at.data[place] - (total - n), n) + np.arange(total[-1])]
        upto = np.searchsorted(first, ends, side="left")
        counts = np.diff(np.concatenate(([0], total))[upto], prepend=0)
        flags = np.full(len(texts), 3, dtype=np.int8)
        some = np.diff(upto, prepend=0) > 0
        flags[some] = np.bitwise_and.reduceat(self.good.data[place], np.concatenate(([0], upto[:-1]))[some])
        return out, counts, flags

    def decode(self, rows: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(rows, skip_special_tokens=False)


def coder(path: str) -> PieceCoder:
    if path not in _workers:
        _workers[path] = PieceCoder(path)
    return _workers[path]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_crc32, parity, round_trip, and ids if asked for.

    ids are the rebuilt tokenizer's for the whole text, without begin or end
    marks; parity says that the sentencepiece library gives the same ids,
    round_trip that decoding gives the text again. Null and empty texts have no
    ids and both true. Other columns are dropped; repeated rows are coded alike.
    """
    import pyarrow as pa

    names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"] + ["ids"] * with_ids

    def rows(batches):
        code = coder(path or model_path())
        for batch in chunks(batches, AT_ONCE):
            flat, counts, flags = code(as_bytes(batch.column(1)))
            data = flat.astype("<u4").tobytes()
            ends = np.cumsum(counts) * 4
            crc = [zlib.crc32(data[e - 4 * n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
            columns = [batch.column(0), pa.array(counts), pa.array(crc, pa.int64()), pa.array(flags & 1 == 1), pa.array(flags & 2 == 2)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends // 4)).astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text, no ids the empty one."""
    import pyarrow as pa

    def rows(batches):
        code = coder(path or model_path())
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = code.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if x is not None else None for t, x in zip(texts, ids)], pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(tidy(rows), "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode() over all documents, ids as their checksum."""
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
