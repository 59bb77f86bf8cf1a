"""Operator 9: toxicity from averaged subword vectors and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, Growing, Memory, as_bytes, chunks, mix, span_hashes, table, tidy, word_spans, words_per_text

#: Subword vectors, their length, and the lengths in bytes of the n-grams of a word with its boundaries.
BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
#: Most labelled documents of each class that training reads, those of the smallest hashes.
TRAIN_ROWS = 1_500
EPOCHS = 8
BATCH = 150
#: How strongly a text's score leans to its highest words: 0 is their mean, large is their maximum. The plain mean of a
#: text, and the mean of windows of its words, miss too many toxic texts: the README has the figures.
SHARP = 4.0
#: Share of a text's words that each training step leaves out, so that every telling word has to tell by itself.
LEFT_OUT = 0.5
THRESHOLD = 0.7
#: Words that one worker remembers.
REMEMBERED = 2_000_000
AT_ONCE = 1 << 20
_workers: dict[str, "WordScores"] = {}


def grams(words: list[bytes], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every word, and how many each word has; a word itself is its last one. In parts, to bound memory."""
    found = [_grams(words[k : k + part]) for k in range(0, len(words), part)]
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"".join(b"<" + w + b">" for w in words)
    raw = np.frombuffer(joined, dtype=np.uint8)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    left = end[word] - np.arange(len(raw))  # bytes up to the word's end
    code = _BYTE[raw]
    at, ids = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            rolled = np.zeros(max(0, len(raw) - n + 1), dtype=np.uint64)
            for k in range(n):
                rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + code[k : len(raw) - n + 1 + k])
            here = np.flatnonzero(left[: len(rolled)] >= n)
            at.append(word[here])
            ids.append((rolled[here] + np.uint64(n)) % np.uint64(BUCKETS))
    whole = span_hashes(raw, end - size, end) % np.uint64(BUCKETS)
    at.append(np.arange(len(words)))
    ids.append(whole)
    at, ids = np.concatenate(at), np.concatenate(ids).astype(np.int32)
    order = np.argsort(at, kind="stable")
    return ids[order], np.bincount(at, minlength=len(words)).astype(np.int32)


def _lowered(text: bytes | None) -> bytes:
    if not text:
        return b""
    return text.lower() if text.isascii() else text.decode().lower().encode()


def distinct_words(texts: list[bytes | None]):
    """Of texts laid end to end: distinct words as bytes, their hashes, and the word number of every word; words in each text."""
    low = [_lowered(t) for t in texts]
    joined = b" ".join(low)
    raw = np.frombuffer(joined, dtype=np.uint8)
    first, last = word_spans(raw) if len(raw) else (np.zeros(0, dtype=np.int64),) * 2
    if not len(first):
        return [], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    unique, index, inverse = np.unique(span_hashes(raw, first, last), return_index=True, return_inverse=True)
    return (joined, first[index], last[index]), unique, inverse, words_per_text(low, first)


def pooled(z: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each text's word scores, weighted towards the high ones; 0 for a text without words."""
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        top = np.maximum.reduceat(z, starts)
        w = np.exp(SHARP * (z - np.repeat(top, counts[some])))
        out[some] = np.add.reduceat(w * z, starts) / np.add.reduceat(w, starts)
    return out


class Model:
    """score: the scalar of each bucket (its vector times the difference of the two classes' weights); bias; slope and shift of the output."""

    def __init__(self, score: np.ndarray, bias: float, slope: float, shift: float):
        self.score, self.bias, self.slope, self.shift = score, bias, slope, shift


def train(texts: list[bytes | None], labels: np.ndarray, seed: int = 7) -> Model:
    """Vectors and softmax weights together, by Adagrad on the labels of whole texts.

    A word is the average of its subword vectors; its softmax logits are linear in
    it; a text's logit leans to its highest words, so that three words in a
    thousand still tell, and the gradient goes to the words that made it.
    """
    rng = np.random.default_rng(seed)
    parts, _, inverse, counts = distinct_words(texts)
    if not len(labels) or not len(inverse) or labels.min() == labels.max():
        p = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 0.0, float(np.log(p / (1 - p))) if 0 < p < 1 else -5.0)
    joined, first, last = parts
    ids, size = grams([joined[a:b] for a, b in zip(first.tolist(), last.tolist())])
    begin = np.cumsum(size, dtype=np.int64) - size
    del parts, joined, first, last
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    hist_v, hist_w, hist_b = np.full((BUCKETS, 1), 1e-6, dtype=np.float32), 1e-6, 1e-6
    ends = np.cumsum(counts)
    bags = [np.unique(inverse[e - c : e]) for e, c in zip(ends, counts)]
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    usable = np.array([k for k, b in enumerate(bags) if len(b)])

    def forward(docs):
        chosen = []
        for k in docs:
            some = bags[k][rng.random(len(bags[k])) >= LEFT_OUT]
            chosen.append(some if len(some) else bags[k])
        words = np.concatenate(chosen)
        n = np.array([len(b) for b in chosen])
        distinct, back = np.unique(words, return_inverse=True)
        s = size[distinct]
        flat = np.repeat(begin[distinct] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        g = ids[flat]
        v = np.add.reduceat(vectors[g], np.cumsum(s) - s, axis=0) / s[:, None]
        diff = weights[1] - weights[0]
        z = (v @ diff + bias[1] - bias[0])[back]
        return words, n, distinct, back, s, g, v, diff, z

    for epoch in range(EPOCHS):
        rate = 0.3 * (1 - epoch / EPOCHS) + 0.02
        sharp = SHARP * min(1.0, (epoch + 0.5) / (EPOCHS / 2))  # at first all words learn, later those that stand out
        order = rng.permutation(usable)
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            words, n, distinct, back, s, g, v, diff, z = forward(docs)
            starts = np.cumsum(n) - n
            w = np.exp(sharp * (z - np.repeat(np.maximum.reduceat(z, starts), n)))
            w /= np.repeat(np.add.reduceat(w, starts), n)
            doc_z = np.add.reduceat(w * z, starts)
            p = 1 / (1 + np.exp(-doc_z))
            d_doc = (p - labels[docs]) * weight[docs] / len(docs)
            d_word = np.repeat(d_doc, n) * w * np.clip(1 + sharp * (z - np.repeat(doc_z, n)), -1, 3)
            d_distinct = np.bincount(back, d_word, minlength=len(distinct))
            d_diff = v.T @ d_distinct
            d_bias = d_distinct.sum()
            per_gram = np.repeat(d_distinct / s, s)
            touched, where = np.unique(g, return_inverse=True)
            d_v = np.bincount(where, per_gram, minlength=len(touched))[:, None] * diff[None, :]
            hist_v[touched] += (d_v**2).mean(axis=1, keepdims=True)
            vectors[touched] -= (rate * d_v / np.sqrt(hist_v[touched])).astype(np.float32)
            hist_w += float((d_diff**2).mean())
            hist_b += float(d_bias**2)
            step = (0.5 * rate * d_diff / np.sqrt(hist_w)).astype(np.float32)
            weights[1] -= step
            weights[0] += step
            bias[1] -= 0.5 * rate * d_bias / np.sqrt(hist_b)
            bias[0] += 0.5 * rate * d_bias / np.sqrt(hist_b)
    score = vectors @ (weights[1] - weights[0])
    model = Model(score.astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    # The output's slope and shift: a logistic regression on the texts' logits, classes weighed alike.
    del vectors, hist_v, ids, bags
    scores = WordScores(model)
    z = np.concatenate([text_logits(texts[k : k + 200], scores) for k in range(0, len(texts), 200)])
    slope, shift = 1.0, 0.0
    mu, sd = z.mean(), z.std() + 1e-9
    x = (z - mu) / sd
    for _ in range(300):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        d = (p - (labels * 0.98 + 0.01)) * weight / len(labels)
        slope -= 2.0 * float((d * x).sum())
        shift -= 2.0 * float(d.sum())
    return Model(model.score, model.bias, slope / sd, shift - slope * mu / sd)


class WordScores:
    """Scores of words, remembered by their hashes."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.z = Memory(), Growing(np.float64)

    def __call__(self, parts, hashes: np.ndarray) -> np.ndarray:
        if self.words.size > REMEMBERED:
            self.words, self.z = Memory(), Growing(np.float64)
        number = self.words.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            joined, first, last = parts
            ids, size = grams([joined[a:b] for a, b in zip(first[new].tolist(), last[new].tolist())])
            self.z.append(np.add.reduceat(self.model.score[ids].astype(np.float64), np.cumsum(size, dtype=np.int64) - size) / size + self.model.bias)
            number[new] = self.words.size + np.arange(len(new))
            self.words.add(hashes[new])
        return self.z.data[number]


def text_logits(texts: list[bytes | None], scores: WordScores) -> np.ndarray:
    parts, hashes, inverse, counts = distinct_words(texts)
    if not len(inverse):
        return np.full(len(texts), scores.model.bias)
    z = pooled(scores(parts, hashes)[inverse], counts)
    return np.where(counts > 0, z, scores.model.bias)


def is_held_out(fold: int = 3, which: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == which, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[bytes | None], np.ndarray]:
    """Whole texts and labels of at most `rows` labelled documents of each class outside the held-out fold; of an id's several texts, the greatest."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~is_held_out())
    picked = [known.filter(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_toxic").alias("_toxic")).orderBy("doc_id").collect()
    return [r["text"].encode() if r["text"] is not None else None for r in got], np.array([r["_toxic"] for r in got], dtype=np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row; null and empty texts get the score of no words."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((model.score, model.bias, model.slope, model.shift))
    token = uuid.uuid4().hex

    def scored(batches):
        if token not in _workers:
            _workers.clear()
            _workers[token] = WordScores(Model(*shared.value))
        words = _workers[token]
        for batch in chunks(batches, AT_ONCE):
            z = text_logits(as_bytes(batch.column(1)), words)
            p = 1 / (1 + np.exp(-np.clip(words.model.slope * z + words.model.shift, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(scored), "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Trained on labelled rows outside the held-out fold alone (at most TRAIN_ROWS
    of each class); only texts are inputs. A null doc_id is not held out. Without
    labels of both classes the score is their base rate. Repeated rows are scored
    alike; other columns are dropped.
    """
    model = train(*training_rows(docs, labels))
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity() of all documents, learnt from their labels."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
