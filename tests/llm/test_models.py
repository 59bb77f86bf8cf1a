"""Classifiers, extraction, encoding, sharding and the language model."""

import math
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from curatrix.llm import language_model, pages, pieces, quality, sharding, toxicity
from curatrix.llm.common import table

from .helpers import documents, fold


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_keeps_clean_and_rejects_junk(spark, sf):
    got = {r["doc_id"]: r for r in quality.op2_quality_classifier(spark, sf).collect()}
    assert len(got) == table(spark, sf, "documents").count()
    lab = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    right = [got[i]["kept"] == bool(q) for i, q in lab.items()]
    assert np.mean(right) > 0.95
    assert np.mean([got[i]["kept"] for i, q in lab.items() if q]) > 0.97


def test_quality_shrinks_small_sites(spark):
    prose = "The river runs along the old road and the people walk there in the evening."
    junk = "$$$ ### @@@ !!! $$$ ### BUY NOW ||| $$$ ### @@@ !!! NOW NOW"
    rows = [(i, prose if i % 4 else junk, "en", "big" if i < 80 else f"s{i}", 1) for i in range(100)] + [(200, None, None, None, None), (201, "", "en", "big", 0), (5, prose, "en", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = labelled(spark, [(i, int(i % 4 > 0), 0) for i in range(100)])
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["kept"] and not by[0]["kept"]
    assert abs(by[81]["path_p"] - by[81]["host_p"]) <= abs(by[81]["text_p"] - by[81]["host_p"]) + 1e-9
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == len(rows)


def test_posteriors_leave_each_document_out(spark):
    """Thousands of tiny sites, against numpy."""
    rng = np.random.default_rng(1)
    n = 4000
    host, path = rng.integers(0, 1500, n), rng.integers(0, 3, n)
    host[:800] = 7
    p = np.clip(rng.beta(2, 2, 1500)[host] * 0.6 + rng.random(n) * 0.4, 0.01, 0.99)
    rows = [(i, None if h == 3 else f"h{h}", f"p{q}", float(v)) for i, (h, q, v) in enumerate(zip(host, path, p))]
    got = quality.posteriors(spark.createDataFrame(rows, "i long, _host string, _path string, p double")).orderBy("i").collect()
    assert len(got) == n
    prior = p.mean()

    def sums(key):
        _, at = np.unique(key, return_inverse=True)
        return np.bincount(at), np.bincount(at, p), np.bincount(at, p * p), at

    def strength(count, s, q, mean):
        var, w = np.maximum(q / count - (s / count) ** 2, 0), np.minimum(count, 50.0)
        some = count >= 2
        between = (w * (s / count - mean) ** 2)[some].sum() - (w * var / count)[some].sum()
        return quality._strength(prior, between / w[some].sum())

    hn, hs, hq, h_at = sums(host)
    hk = strength(hn, hs, hq, prior)
    gn, gs, gq, g_at = sums(host * 10 + path)
    host_of = np.zeros(len(gn), dtype=np.int64)
    host_of[g_at] = h_at
    gk = strength(gn, gs, gq, ((hs + hk * prior) / (hn + hk))[host_of])
    host_p = ((hs[h_at] - p) + hk * prior) / (hn[h_at] - 1 + hk)
    path_p = ((gs[g_at] - p) + gk * host_p) / (gn[g_at] - 1 + gk)
    logit = lambda v: np.log(np.clip(v, 1e-4, 1 - 1e-4) / (1 - np.clip(v, 1e-4, 1 - 1e-4)))
    want = 1 / (1 + np.exp(-(logit(p) + logit(path_p) - math.log(prior / (1 - prior)))))
    assert np.allclose([r["host_p"] for r in got], host_p) and np.allclose([r["path_p"] for r in got], path_p)
    assert np.allclose([r["posterior"] for r in got], want)


def test_quality_of_held_out_labels(spark, sf):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    learnt = labels.filter(F.pmod(F.col("doc_id"), F.lit(2)) == 0)
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, learnt).collect()}
    held = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] % 2 and r["quality"] is not None]
    assert np.mean([got[i] == bool(q) for i, q in held]) > 0.95


def test_quality_keeps_rows_by_their_own_verdict(spark):
    prose = "The river runs along the old road and the people walk there in the evening number"
    junk = "$$$ ### @@@ !!! $$$ ### BUY NOW ||| $$$ ### @@@ !!! NOW NOW"
    rows = [(i, f"{prose} {i}." if i % 2 else f"{junk} {i}", "en", "s", "x", 1) for i in range(60)] + [(1, junk, "en", "s", "y", 2), (None, junk, "en", "s", "x", 3), (None, f"{prose}.", "en", "s", "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row string, _at int")
    kept = quality.keep(docs, labelled(spark, [(i, i % 2, 0) for i in range(60)]))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["_at"]) for r in kept.collect()) == sorted([(i, 1) for i in range(1, 60, 2)] + [(-1, 4)])


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(0)
    plain = [f"{a}{b}" for a in ("ta", "me", "ro", "li", "sun", "go") for b in ("ra", "ne", "tol", "mi", "vas", "der")]
    bad = ["zorkish", "blaggard", "grumphole", "snivelrat"]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(600, "tara blagggard ."), (601, ""), (602, None), (603, "Zorkishh?"), (1, rows[1][1])]
    got = toxicity.toxicity(documents(spark, rows), labelled(spark, labels)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (fold(i, 3) == 1) for i, r in by.items())
    held = [i for i in range(500) if fold(i, 3) == 1]
    assert np.mean([by[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert by[600]["score"] > by[601]["score"] and by[603]["score"] > by[602]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert toxicity.toxicity(documents(spark, []), labelled(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<article><h1>A &amp; B</h1><p>First   line<br>goes <b>on</b> &lt;here&gt;.<p>Second&nbsp;one.</p><ul><li>A first point.<li>A second point</ul></article>
<div class="comments"><div class="comment"><p>Nice post!</p></div></div><form><label>Name</label></form><footer>&copy; us"""


def test_blocks():
    assert [t for _, t, _ in pages.blocks(PAGE)] == ["Home", "Buy now", "A & B", "First line goes on <here>.", "Second one.", "A first point.", "A second point", "Nice post!", "Name", "© us"]
    assert pages.blocks(None) == [] and pages.blocks("") == [] and [t for _, t, _ in pages.blocks("plain <b>text")] == ["plain text"]


def test_extraction(spark, sf):
    src = table(spark, sf, "pages")
    extra = spark.createDataFrame([(900, "u", PAGE), (901, "u", None), (902, None, ""), (None, "u", PAGE)], "page_id long, url string, html string")
    got = pages.extract(src.select("page_id", "url", "html").unionByName(extra), training=src).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == src.count() + 4
    assert by[900]["text"] == "A & B\n\nFirst line goes on <here>.\n\nSecond one.\n\nA first point.\n\nA second point"
    assert by[901]["text"] == "" and by[902]["n_chars"] == 0
    for r in src.collect():
        inside = [t for p, t, _ in pages.blocks(r["html"]) if pages.path_label(p)]
        assert by[r["page_id"]]["text"] == "\n\n".join(inside) and by[r["page_id"]]["n_chars"] == len(by[r["page_id"]]["text"])


BROKEN = [
    ("<p>if a < b then stop here", ["if a < b then stop here"]),
    ("<article><p>5 < 6 and more</p><p>tail a < b c", ["5 < 6 and more", "tail a < b c"]),
    ("<p title=it's>one</p><p>two isn't</p><p>three</p>", ["one", "two isn't", "three"]),
    ('<p class="x>hello</p>', ["hello"]),
    ("<svg/><p>after</p>", ["after"]),
    ("<noscript>q<p>kept", ["q", "kept"]),
    ("<!-- a > b --><p>z</p><!--><p>y</p>", ["z", "y"]),
    ("<script>if(a<b)</script><p>ok</p></><? x ><!DOCTYPE html><p>end</p>", ["ok", "end"]),
    ("<p>a <b c", ["a <b c"]),
    ('<p data-x = "a > b" hidden>in</p>', ["in"]),
]


def test_broken_markup():
    for html, want in BROKEN:
        assert [t for _, t, _ in pages.blocks(html)] == want, html
    assert pages.blocks('<div class=nav id="q r"><p>u')[0][0] == ("div", "c:nav", "i:q", "i:r", "p")


def test_hostile_pages_take_linear_time():
    import time

    for html in ("<a " * 400_000, "<script " * 100_000, "<a b=\"'>" * 150_000, "<!-- " * 300_000 + ">", "<svg>" * 300_000, "<" * 1_500_000, "<div>" * 200_000 + "x", "<a>" * 200_000, "<p>" + "word " * 1_000_000):
        began = time.time()
        pages.blocks(html)
        assert time.time() - began < 10, html[:20]


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = pages.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = pages.padded([rng.normal(size=(5, pages.PATH + pages.WORDS + pages.EXTRA)).astype(np.float32), rng.normal(size=(3, pages.PATH + pages.WORDS + pages.EXTRA)).astype(np.float32)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)
    grad, _ = model.gradients(x, mask, y)

    def loss():
        p = model.forward(x, mask)[0]
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    for name in ("wx", "wh", "b", "wo"):
        at = tuple(rng.integers(s) for s in model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-3
        up = loss()
        model.p[name][at] = old - 1e-3
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-3 - grad[name][at]) < 1e-3


def test_pieces_equal_sentencepiece(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    odd = [(1000 + k, t) for k, t in enumerate(["", None, "  two  spaces ", "a▁b ▁ c", "line\nbreak\t\x0b", "日本語 😀", " ", "<s> x", "▁", "x" * 3000])]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    coded = pieces.encode(docs)
    got = {r["doc_id"]: r for r in coded.collect()}
    for i, t in texts.items():
        assert got[i]["ids"] == sp.encode(t or ""), t
    assert all(r["parity"] for r in got.values())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded).collect()}
    for i, t in texts.items():
        if got[i]["round_trip"]:
            assert back[i] == (t or "")
    assert np.mean([r["round_trip"] for r in got.values()]) > 0.98
    assert pieces.encode(docs.limit(0)).count() == 0


def test_unigram_model_file():
    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload

    def text(number, value):
        return field(number, 2, bytes([len(value)]) + value)

    import struct

    def piece(s, score, kind):
        return text(1, text(1, s.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    byte_pieces = b"".join(piece(f"<0x{b:02X}>", 0.0, 6) for b in range(256))
    data = piece("<unk>", 0.0, 2) + byte_pieces + piece("▁ab", -1.0, 1) + piece("▁a", -2.0, 1) + piece("b", -2.5, 1) + piece("c", -3.0, 1)
    trainer = text(2, field(3, 0, bytes([1])) + bytes([35 << 3 & 0x7F | 0x80, 2, 1]))
    model = pieces.ModelFile(data + trainer + text(3, field(4, 0, b"\x00")))
    assert model.model_type == pieces.UNIGRAM and model.byte_fallback and model.plain
    t = pieces.build(model)
    assert t.encode("ab c", add_special_tokens=False).tokens[0] == "▁ab"
    assert t.decode(t.encode("abé", add_special_tokens=False).ids) == "abé"


def test_shards_fit(spark, sf):
    docs = table(spark, sf, "documents")
    for limit in (2_000, 20_000, 10**9):
        got = sharding.shards(docs, limit=limit).collect()
        assert len(got) == docs.count()
        size = {}
        for r in got:
            size.setdefault(r["shard"], []).append(r["n_bytes"])
        assert all(sum(v) <= limit or len(v) == 1 for v in size.values())
        if limit < 10**9:  # a split shard's parent was too large
            whole = {}
            for r in got:
                whole.setdefault((r["depth"] - 1, r["prefix"] >> 1), 0)
            h = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", sharding.key_hash(F.col("doc_id")), F.coalesce(F.octet_length("text"), F.lit(0))).collect()}
            for d, p in whole:
                if d >= 0:
                    assert sum(s for k, s in h.values() if k >> (sharding.BITS - d) == p) > limit


def test_shards_of_one_key(spark):
    rows = [(1, "x" * 100)] * 60 + [(2, "y" * 5000), (None, "z"), (3, None), (4, "")]
    got = sharding.shards(documents(spark, rows).repartition(5), limit=1000).collect()
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 12  # parts share their links: 6,000 bytes by half a shard
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append(r["n_bytes"])
    assert len(got) == len(rows) and all(sum(v) <= 1000 or len(v) == 1 for v in size.values())
    assert sharding.shards(documents(spark, [])).count() == 0


def test_language_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(5000, None), (5001, ""), (5002, "the THE unseenword"), (5002, "the THE unseenword"), (None, "the")], "doc_id long, text string"))
    rows = docs.collect()
    import re

    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    count = {}
    for r in rows:
        if r["doc_id"] is None or fold(r["doc_id"], 5) != 1:
            for w in toks(r["text"]):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    got = language_model.language_model_scores(docs).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        w = toks(texts[r["doc_id"]])
        base = sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in count for x in w)
        assert r["base_score"] == pytest.approx(base, abs=1e-6 * len(w) + 1e-9) and r["score"] < 0
        assert r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"], 5) == 1)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def stirling(c, t, d):
    """The weight of all seatings of c customers at t tables, by recursion."""
    if c == t == 0:
        return 1.0
    return 0.0 if t < 1 or t > c else stirling(c - 1, t - 1, d) + (c - 1 - d * t) * stirling(c - 1, t, d)


def test_seats_are_drawn_from_their_distribution():
    rng = np.random.default_rng(0)
    d, x, n = 0.6, 0.8, 40_000
    for c in (1, 2, 3, 7):
        want = np.array([x**t * stirling(c, t, d) for t in range(1, c + 1)])
        got = np.bincount(language_model.seated(np.full(n, c), np.full(n, x), d, rng), minlength=c + 1)[1:] / n
        assert np.abs(got - want / want.sum()).max() < 0.015
    # beyond EXACT the limit has nearly the mean of the exact distribution before it
    for x in (0.3, 20.0, 3000.0):
        below = language_model.seated(np.full(4000, language_model.EXACT), np.full(4000, x), d, rng).mean()
        above = language_model.seated(np.full(4000, language_model.EXACT + 1), np.full(4000, x), d, rng).mean()
        assert abs(above - below) < 0.1 * below, (x, below, above)
    assert language_model.seated(np.array([0]), np.array([1.0]), d, rng)[0] == 0


def plain_model(texts, d, d0, theta, sweeps, burn_in, seed=0):
    """A seat-by-seat Gibbs sampler with table sizes, and its averaged predictive probabilities."""
    rng = random.Random(seed)
    seen = [(u, w) for t in texts for u, w in zip([0, *t], t)]
    types = len({w for _, w in seen})
    rooms, root = {}, {}

    def p_root(w, m, tables):
        own = root.get(w, [])
        return (max(sum(own) - d0 * len(own), 0) + (theta + d0 * tables) / (types + 1)) / (theta + m)

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    def sit(sizes, fresh, dd):
        k = rng.choices(range(len(sizes) + 1), [n - dd for n in sizes] + [fresh])[0]
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    totals = lambda: (sum(map(sum, root.values())), sum(map(len, root.values())))

    def enter(u, w):
        m, tables = totals()
        room = rooms.setdefault(u, {})
        if sit(room.setdefault(w, []), (theta + d * sum(map(len, room.values()))) * p_root(w, m, tables), d):
            sit(root.setdefault(w, []), (theta + d0 * tables) / (types + 1), d0)

    for u, w in seen:
        enter(u, w)
    kept = []
    for number in range(sweeps):
        for u, w in seen:
            if leave(rooms[u][w]):
                leave(root[w])
            enter(u, w)
        if number >= burn_in:
            m, tables = totals()
            kept.append(({u: ({w: (sum(s), len(s)) for w, s in r.items()}, sum(map(sum, r.values())), sum(map(len, r.values()))) for u, r in rooms.items()}, {w: p_root(w, m, tables) for w in root}, p_root(None, m, tables)))

    def p(u, w):
        out = 0.0
        for r, p0, unknown in kept:
            dishes, c, t = r.get(u, ({}, 0, 0))
            n, own = dishes.get(w, (0, 0))
            out += (max(n - d * own, 0) + (theta + d * t) * p0.get(w, unknown)) / (theta + c)
        return out / len(kept)

    return p


def test_language_model_against_a_plain_sampler(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(6)]
    rows = [(i, " ".join(rng.choices(words, [8, 5, 3, 2, 1, 1], k=rng.randint(2, 8)))) for i in range(24)]
    learnt = [r[1].split() + [None] for r in rows if fold(r[0], 5) != 1]
    pairs, followed = {}, {}
    for t in learnt:
        for u, w in zip([0, *t], t):
            pairs[u, w] = pairs.get((u, w), 0) + 1
            followed.setdefault(w, set()).add(u)
    many = lambda values, k: sum(v == k for v in values)
    discount = lambda values: language_model._discount(many(values, 1), many(values, 2))
    d, d0 = discount(list(pairs.values())), discount([len(v) for v in followed.values()])
    p = plain_model(learnt, d, d0, language_model.THETA, 1200, 100)
    rows.append((10_001, "w0 unseen w1"))
    got = language_model.language_model_scores(documents(spark, rows), burn_in=2, samples=10, part_bytes=200).collect()
    for r, (i, text) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        t = text.split() + [None]
        want = sum(math.log10(p(u, w)) for u, w in zip([0, *t], t))
        assert r["score"] == pytest.approx(want, rel=0.05), (i, text)


def test_language_model_empty(spark):
    assert language_model.language_model_scores(documents(spark, [])).count() == 0


def test_blobs():
    arrays = [np.arange(5, dtype=np.int64) - 2, np.zeros(0, dtype=np.uint64), np.array([2**63], dtype=np.uint64), np.array([1, 2], dtype=np.uint8)]
    back = language_model.unpack(language_model.pack(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back)) and len(back) == 4


def test_language_model_tells_every_context(spark):
    """Each word always follows the same one: only a context for every preceding word can say so."""
    rng = random.Random(1)
    after = {f"a{k}": f"b{k}" for k in range(300)}
    rows = [(i, " ".join(x for _ in range(40) for k in [rng.randrange(300)] for x in (f"a{k}", after[f"a{k}"]))) for i in range(300)]
    got = language_model.language_model_scores(documents(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    # half of the tokens are one of 300 words, half are told by the word before them
    mean = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert mean > -1.5, mean
