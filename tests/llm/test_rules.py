import math
import random
import re

import xxhash

from curatrix.llm import rules
from curatrix.llm.common import table

from .helpers import WORD, documents


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def features(text):
    """Buckets of words and of each word with its successor, as Spark hashes them."""
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall(text or "")]
    step = lambda value, seed: xxhash.xxh64(value.to_bytes(8, "little"), seed=seed).intdigest()
    pairs = [step(h[i + 1], step(h[i], 42)) if i + 1 < len(h) else step(h[i], 42) for i in range(len(h))]
    return [x & (rules.BUCKETS - 1) for x in h + pairs]


def test_base_figures_and_verdict(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    raw, target = [1] * rules.BUCKETS, [1] * rules.BUCKETS
    found = {i: features(t) for i, t in texts.items()}
    for i, f in found.items():
        for b in f:
            raw[b] += 1
            target[b] += i in good
    ratio = [round(math.log(t / sum(target)) - math.log(r / sum(raw)), 3) for r, t in zip(raw, target)]
    rows = rules.op4_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        f = found[r["doc_id"]]
        llr = sum(ratio[b] for b in f) / (len(f) + rules.NEUTRAL) if f else None
        assert (r["llr"] is None and llr is None) or abs(r["llr"] - llr) < 1e-5
        assert r["kept"] == (not want[-1] and llr is not None and llr >= rules.THRESHOLD)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e a b c d e x"), (5, "# * $ % & | < >"), (6, "l1\nl1\n\n \nl1"), (7, "w " * 50_000), (7, "w " * 50_000), (None, "one two three four five six seven eight nine ten")]
    docs = documents(spark, rows)
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.quality_rules(docs, None).collect()))
    assert got == sorted((i or 0, *base(t)) for i, t in rows)
    assert rules.keep(docs, None).columns == docs.columns and rules.keep(docs, None).count() == 1
    assert rules.quality_rules(documents(spark, []), None).count() == 0


def test_junk_of_new_words_among_a_large_vocabulary(spark):
    rng = random.Random(3)
    made = lambda prefix, size: f"{prefix}{rng.randrange(size)}"
    clean = [(i, " ".join(made("w", 20_000) for _ in range(80))) for i in range(1000)]
    junk = [(i, " ".join(made("q", 10**9) for _ in range(80))) for i in range(5000, 5050)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in rules.quality_rules(documents(spark, clean + junk), labels).collect()}
    assert sum(kept[i] for i, _ in junk) == 0 and sum(kept[i] for i, _ in clean) == len(clean)


def test_every_trusted_document_is_fitted(spark):
    """30,000 trusted documents among 40,000, with ids far apart and negative ones."""
    ids = spark.range(40_000).selectExpr("id AS i", "(id - 15000) * 1000000007 AS doc_id")
    docs = ids.selectExpr("doc_id", "IF(i < 30000, 'a', 'b') AS text")
    labels = ids.selectExpr("doc_id", "CAST(i < 30000 AS INT) AS quality")
    ratios, size = rules.log_ratios(docs, labels), rules.MOST_BUCKETS
    want = math.log(30_001 / (60_000 + size)) - math.log(30_001 / (80_000 + size))
    lost = math.log(1 / (60_000 + size)) - math.log(10_001 / (80_000 + size))
    assert len(ratios) == size and sorted(ratios)[:2] == [round(lost, 3)] * 2 and max(ratios) == round(want, 3)
