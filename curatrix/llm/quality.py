"""Operator 2: document quality by hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, drop, mix, stage, table, tidy, without, word_hashes

#: Most labelled documents of each class that the classifier reads, those of the smallest hashes.
TRAIN_ROWS = 4_000
#: A document is kept if its posterior probability of good quality is at least this.
THRESHOLD = 0.5
#: Documents' worth of evidence that a site's prior may weigh at most: groups with more documents still differ from their parent.
STRONGEST = 1_000.0
#: Buckets of the hashed words and word pairs, and neutral ones that are added to each text's own.
BUCKETS = 1 << 16
NEUTRAL = 20
AT_ONCE = 1 << 20
FEATURES = ("ngrams", "symbols", "upper", "exclaim", "bars", "digits", "distinct", "runs", "word_length", "dup_lines", "log_words", "low_ends")
_SYMBOLS = b"#*$%&<>@^~=_\\{}[]"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def counters(text: bytes | None) -> tuple[float, ...]:
    """Shares that tell prose from junk; all are 0 without words."""
    words = text.split() if text else []
    if not words:
        return (0.0,) * (len(FEATURES) - 1)
    size, n = len(text), len(words)

    def share(chars: bytes) -> float:
        return 1.0 - len(text.translate(None, chars)) / size

    lines = [line for line in text.split(b"\n") if line.strip()]
    runs = sum(a == b for a, b in zip(words, words[1:]))
    return (
        min(1.0, 10 * share(_SYMBOLS)), share(_UPPER), min(1.0, 10 * share(b"!?")), min(1.0, 10 * share(b"|")), min(1.0, 5 * share(_DIGITS)),
        (len(set(words)) / n) ** 0.5, runs / n, min(3.0, sum(map(len, words)) / n / 6), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n) / 6,
        min(1.0, 5 * share(b".,")),
    )


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and of every pair of successive words of every text, and the text of each."""
    hashes, counts = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    follows = np.flatnonzero(text[1:] == text[:-1])
    with np.errstate(over="ignore"):
        pairs = mix(hashes[follows] * np.uint64(0x9E3779B97F4A7C15) + hashes[follows + 1])
    return (np.concatenate((hashes, pairs)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((text, text[follows]))


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """For each bucket the log ratio of its smoothed shares in good and in bad documents; counts is (2, BUCKETS), bad first."""
    share = np.log(counts + 1.0) - np.log(counts.sum(axis=1, keepdims=True) + counts.shape[1])
    return share[1] - share[0]


def featured(docs: DataFrame, columns: list[str], counts: np.ndarray, own: str | None = None) -> DataFrame:
    """The given columns of docs and f, the list of its text's features.

    The first feature is the mean log ratio of the text's words and pairs. own
    names a column with the class whose counts hold the text itself: they are
    taken out then, so that a training text isn't judged by itself.
    """
    import pyarrow as pa

    src = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def rows(batches):
        counts_ = shared.value
        ratios, totals = log_ratios(counts_), counts_.sum(axis=1) + counts_.shape[1]
        for whole in batches:
            for b in chunks([whole], AT_ONCE, "_text"):
                texts = as_bytes(b.column(len(columns)))
                at, text = grams(texts)
                if own is None:
                    sums = np.bincount(text, ratios[at], minlength=len(texts))
                else:
                    sums = np.zeros(len(texts))
                    for k, kind in enumerate(b.column(columns.index(own)).to_pylist()):
                        unique, n = np.unique(at[text == k], return_counts=True)
                        mine = counts_[:, unique].astype(np.float64)
                        mine[kind] -= n
                        size = totals.astype(np.float64)
                        size[kind] -= n.sum()
                        share = np.log(mine + 1.0) - np.log(size)[:, None]
                        sums[k] = ((share[1] - share[0]) * n).sum()
                first = sums / (np.bincount(text, minlength=len(texts)) + NEUTRAL)
                f = [(r, *counters(t)) for r, t in zip(first.tolist(), texts)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(f, pa.list_(pa.float64()))], names=[*columns, "f"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*columns).schema)
    return src.mapInArrow(tidy(rows), f"{schema}, f array<double>")


def class_counts(labelled: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the labelled texts (text, _quality) of each class."""
    import pyarrow as pa

    def rows(batches):
        held = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in chunks(batches, AT_ONCE):
            at, text = grams(as_bytes(b.column(0)))
            kind = b.column(1).to_numpy().astype(np.int64)
            held += np.bincount(kind[text] * BUCKETS + at, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        kind, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kind * BUCKETS + at), pa.array(held[kind, at])], names=["b", "n"])

    found = labelled.select(F.col("text").cast("string").alias("text"), F.col("_quality").cast("int")).mapInArrow(tidy(rows), "b long, n long")
    out = np.zeros(2 * BUCKETS, dtype=np.int64)
    got = found.groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most one row a bucket and class
    out[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(2, BUCKETS)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[list[float], float]:
    """Logistic regression by Newton's method with a small penalty, classes weighed alike; weights and intercept."""
    if not len(y) or y.min() == y.max():
        return [0.0] * len(FEATURES), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    x1 = np.column_stack((x, np.ones(len(x))))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), 0.05)
    penalty[-1] = 1e-6
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (weight * (p - y)) + penalty * w
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and classes of the labelled documents, and their class counts. Repeated rows of one text are read once."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = [known.filter(f"quality = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_quality")
    joined = stage(joined.distinct(), "labelled")
    counts = class_counts(joined)
    got = featured(joined, ["doc_id", "_quality"], counts, own="_quality").collect()  # at most 2 x rows documents, a dozen numbers each
    drop(joined)
    got.sort(key=lambda r: (r["doc_id"], r["f"]))
    return np.array([r["f"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["_quality"] for r in got], dtype=np.int64), counts


def _strength(mean: float, between: float) -> float:
    """How many documents the parent's mean weighs, from the variance of the groups' true means (a Beta prior's size)."""
    spread = mean * (1 - mean)
    if between <= 0 or spread <= 0:
        return STRONGEST
    return min(STRONGEST, max(1.0, spread / between - 1))


def _between(groups: DataFrame, mean: Column | float) -> float:
    """The variance between groups beyond what their sizes explain, by moments, each group weighed alike up to 50 documents."""
    w = F.least(F.col("n"), F.lit(50)).cast("double")
    r = groups.filter("n >= 2").agg(F.sum(w * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("a"), F.sum(w).alias("w"), F.sum(w * F.col("v") / F.col("n")).alias("noise")).collect()[0]
    return (r["a"] - r["noise"]) / r["w"] if r["w"] else 0.0


def evidence(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and p, the classifier's probability from the text alone."""
    x, y, counts = training_rows(docs, labels)
    weights, intercept = fit(x, y)
    z = sum((F.col("f")[k] * w for k, w in enumerate(weights)), F.lit(intercept))
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return featured(docs, columns, counts).withColumn("p", 1 / (1 + F.exp(-z))).drop("f")


def posteriors(scored: DataFrame) -> DataFrame:
    """Adds to rows with _host, _path and p: host_p, path_p, prior_p and posterior.

    The sums of p by path and host are grouped aggregates. A host's mean is
    shrunk towards the mean of all, a path's towards its host's, each by the
    strength that the spread of the groups implies; a site of few documents stays
    near its parent. Both means leave the document itself out, so that its own
    evidence is counted once. A document's odds are those of its text times what
    its path adds over the global prior.
    """
    one = F.count(F.lit(1))
    paths = stage(scored.groupBy("_host", "_path").agg(one.alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = stage(paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()[0]
    prior = min(0.999, max(0.001, total["s"] / total["n"])) if total["n"] else 0.5

    def variance(df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)))

    host_k = _strength(prior, _between(variance(hosts), prior))
    host_post = hosts.select(F.col("_host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + host_k * prior) / (F.col("n") + host_k)).alias("mean"))
    with_host = stage(variance(paths).join(host_post, F.col("_host").eqNullSafe(F.col("h"))).drop("h"), "path_hosts")
    path_k = _strength(prior, _between(with_host, F.col("mean")))
    group = stage(with_host.select(F.col("_host").alias("gh"), F.col("_path").alias("gp"), "n", "s", "host_n", "host_s"), "groups")
    joined = scored.join(group, F.col("_host").eqNullSafe(F.col("gh")) & F.col("_path").eqNullSafe(F.col("gp"))).drop("gh", "gp")
    joined = joined.withColumn("host_p", (F.col("host_s") - F.col("p") + host_k * prior) / (F.col("host_n") - 1 + host_k))
    path_p = (F.col("s") - F.col("p") + path_k * F.col("host_p")) / (F.col("n") - 1 + path_k)

    def logit(c: Column) -> Column:
        c = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
        return F.log(c / (1 - c))

    odds = logit(F.col("p")) + logit(F.col("path_p")) - math.log(prior / (1 - prior))
    return joined.withColumn("path_p", path_p).withColumn("prior_p", F.lit(prior)).withColumn("posterior", 1 / (1 + F.exp(-odds))).drop("n", "s", "host_n", "host_s")


def _named(docs: DataFrame, host: str, path: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_p, host_p, path_p, prior_p, posterior, kept.

    A site is the host column, a path the host and path columns together; nulls
    are groups of their own. Null, empty and wordless texts have all features 0.
    Repeated rows count as documents and get the same posterior. A posterior equal
    to the threshold is kept. An empty table gives an empty result. Other columns
    are dropped.
    """
    scored = stage(evidence(_named(docs, host, path), labels, ["doc_id", "_host", "_path"]), "evidence")
    out = posteriors(scored)
    return out.select("doc_id", F.col("p").alias("text_p"), "host_p", "path_p", "prior_p", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns.

    A row is known by two hashes of its id, text, host and path, so that each is
    kept or not by its own verdict: equal rows alike, and rows of one id with
    different texts, or without an id, each for itself. An empty table gives an
    empty result.
    """
    own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(f"\0{k}")) for k, c in enumerate(("doc_id", "text", host, path))]
    key = [F.xxhash64(*own), F.xxhash64(F.lit(1), *own)]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), key[0].alias("_k0"), key[1].alias("_k1"))
    scored = stage(evidence(named, labels, ["_k0", "_k1", "_host", "_path"]), "evidence")
    return without(docs, key, posteriors(scored).filter(F.col("posterior") < threshold).select("_k0", "_k1"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() over all documents, hosts by source and paths by language."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
