"""Queries that SQL can't state, against plain Python over their whole tables; and rows of edge cases for the same functions."""

import hashlib
import json
import re
import textwrap
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from curatrix.functions import layout, strings, urls
from curatrix.operators import clean, sampling
from curatrix.plans import catalog

EDGES = [None, "", " ", "a", "ﬁne Ünïcode ½ № ①", "  two\t\twords\n", "ein Satz, ein Satz, ein Satz", "日本語 テキスト", "x" * 5000, "A b a B a b c", "to be or to be or to be"]


def table(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def both(spark, sf, query, source, column, key, plain, function, *seeds):
    """The query's rows, and the function's over EDGES, equal the plain version's."""
    got = {r[0]: r[1] for r in catalog.QUERIES[query](spark, sf).collect()}
    rows = table(spark, sf, source, key, column)
    assert got == {k: plain(t, str(k)) for k, t in rows} and len(rows) > 20
    edges = spark.createDataFrame(list(enumerate(EDGES)), "i int, t string")
    args = ["t"] + ([F.col("i").cast("string")] if seeds else [])
    assert {r["i"]: r["o"] for r in edges.select("i", function(*args).alias("o")).collect()} == {i: plain(t, str(i)) for i, t in enumerate(EDGES)}


def stream(seed):
    """The numbers that the digests of `seed|0`, `seed|1`, ... give, four bytes each."""
    return (int(hashlib.sha256(f"{seed}|{k // 8}".encode()).hexdigest()[k % 8 * 8 : k % 8 * 8 + 8], 16) / 2**32 for k in range(10**9))


def test_long_texts_go_to_python_a_few_at_a_time():
    """An Arrow batch has 10,000 texts whatever their length, so its memory has no bound."""
    made = [strings.ascii_fold, strings.nfkc_spaces, strings.segment_words(["a"]), layout.phrase_lines(), layout.char_spread(), layout.inner_spaces(), layout.without_repeats, urls.data_links, urls.anchors, clean.json_cleaner()]
    assert {f.evalType for f in made} == {PythonEvalType.SQL_BATCHED_UDF}


def test_f10(spark, sf):
    def plain(t, _):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) < 128).strip()

    both(spark, sf, "F10_ascii_fold", "documents", "text", "doc_id", plain, strings.ascii_fold)


def test_f11(spark, sf):
    def plain(t, _):
        return None if t is None else " ".join(unicodedata.normalize("NFKC", t).split())

    both(spark, sf, "F11_nfkc_spaces", "documents", "text", "doc_id", plain, strings.nfkc_spaces)


def test_h1_phrases(spark, sf):
    def plain(t, seed):
        if t is None:
            return None
        words, lines, draw = t.split(" "), [], stream(seed)
        while words:
            k = int(2 + next(draw) * 4)
            lines.append(" ".join(words[:k]))
            words = words[k:]
        return "\n".join(lines)

    both(spark, sf, "H1_phrase_lines", "documents", "text", "doc_id", plain, layout.phrase_lines(), "seed")


def test_h1_spread(spark, sf):
    def plain(t, seed):
        """Each line is the shortest run that ends with a space and has as many characters as were drawn."""
        if t is None:
            return None
        least = int(10 + next(stream(seed)) * 9)
        return re.sub(r"(?s)(.{%d,}? )" % (least - 1), r"\1" + "\n", t)

    both(spark, sf, "H1_char_spread", "documents", "text", "doc_id", plain, layout.char_spread(), "seed")


def test_h2(spark, sf):
    def plain(t, seed):
        if t is None:
            return None
        draw = stream(seed)

        def word(m):
            w = m.group()
            if len(w) < 3 or next(draw) >= 0.3:
                return w
            out = w[0]
            for c in w[1:]:
                out += " " + c if c.isalpha() and next(draw) < 0.3 else c
            return out

        return re.sub(r"\S+", word, t)

    both(spark, sf, "H2_inner_spaces", "documents", "text", "doc_id", plain, layout.inner_spaces(), "seed")


def test_h4(spark, sf):
    def plain(t, _):
        return None if t is None else textwrap.wrap(" ".join(t.split()), 40, break_long_words=False, break_on_hyphens=False)

    both(spark, sf, "H4_wrap", "benchmark", "text", "item_id", plain, lambda t: layout.wrap(F.col(t), 40))


def once_without_repeats(words):
    size = 2
    while size <= len(words) // 2:
        i = 0
        while i + 2 * size <= len(words):
            if [w.lower() for w in words[i : i + size]] == [w.lower() for w in words[i + size : i + 2 * size]]:
                words = words[: i + size] + words[i + 2 * size :]
            else:
                i += 1
        size += 1
    return words


def test_h6(spark, sf):
    def plain(t):
        if t is None:
            return None
        words = t.split()
        for _ in range(3):
            words = once_without_repeats(words)
        return " ".join(words)

    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    got = [tuple(r) for r in catalog.QUERIES["H6_without_repeats"](spark, sf).select("conv_id", "turn", "text").collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(((c, n, plain(t)) for c, n, t in rows), key=order)
    edges = spark.createDataFrame(list(enumerate(EDGES)), "i int, t string").select("i", layout.without_repeats("t").alias("o"))
    assert {r["i"]: r["o"] for r in edges.collect()} == {i: plain(t) for i, t in enumerate(EDGES)}


ANCHOR = re.compile(r'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', re.S | re.I)
PAGE = '<p><a class="x" href="data.csv?v=1">All <b>rows</b></a><a href="/b">Download the .csv</a><a href="">none</a><A HREF="data.csv?v=1">again</A><a href="http://o/p.CSV"></a></p>'


def links(html, base):
    """Address and text of every anchor in which no markup hides."""
    return [(h.strip(), urljoin(base, h), re.sub(r"<[^>]*>", "", t).strip()) for h, t in ANCHOR.findall(html or "") if h.strip()]


def csv_links(html, base):
    found = links(html, base)
    offered = [(u, t) for _, u, t in found if re.search(r"download.*\.csv", t, re.I)]
    named = [(u, t) for h, u, t in found if re.search(r"\.csv(\?|$)", h, re.I)]
    out = {}
    for u, t in offered + named:
        out.setdefault(u, t or "CSV")
    return list(out.items())


def test_r5_and_r6(spark, sf):
    rows = table(spark, sf, "pages", "page_id", "url", "html")
    clean_of = lambda h: re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", h)
    got = sorted(tuple(r) for r in catalog.QUERIES["R5_anchor_parser"](spark, sf).collect())
    want = sorted((p, u) for p, base, h in rows for u in dict.fromkeys(u for _, u, _ in links(clean_of(h), base)))
    assert got == want and len(got) > len(rows)
    data = {r["page_id"]: [(x["url"], x["label"]) for x in r["links"]] for r in catalog.QUERIES["R6_data_links"](spark, sf).collect()}
    assert data == {p: csv_links(clean_of(h), base) for p, base, h in rows}
    df = spark.createDataFrame([(PAGE, "http://h/p/"), ("", "http://h"), (None, None)], "h string, u string")
    found = df.select(urls.anchors("h", "u").alias("a"), urls.data_links("h", "u").alias("d")).collect()
    assert [r["a"] for r in found] == [["http://h/p/data.csv?v=1", "http://h/b", "http://o/p.CSV"], [], []]
    assert [[(x["url"], x["label"]) for x in r["d"]] for r in found] == [[("http://h/b", "Download the .csv"), ("http://h/p/data.csv?v=1", "All rows"), ("http://o/p.CSV", "CSV")], [], []]


def stripped(text):
    """Opening phrases, one at a time, until none is left."""
    while True:
        text = text.lstrip()
        m = next(filter(None, (re.match(f"(?i)(?:{p}){clean.PHRASE_TAIL}", text) for p in clean.PHRASES)), None)
        if m is None:
            return text
        text = text[m.end() :]


def test_c11_json(spark, sf):
    def walk(x):
        return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else [walk(v) for v in x] if isinstance(x, list) else stripped(x).strip() if isinstance(x, str) else x

    rows = table(spark, sf, "events", "event_id", "props")
    got = {r[0]: r[1] for r in catalog.QUERIES["C11_json"](spark, sf).collect()}
    assert {k: json.loads(v) for k, v in got.items() if v is not None} == {k: walk(json.loads(t)) for k, t in rows if t is not None} and len(got) == len(rows)
    said = [{"value": "Sure! OK, great. The cat", "n": [1, "Certainly: yes ", {"deep": "Here you go - x"}], "none": None}, "Of course, no problem, a", [], 5]
    texts = [json.dumps(x) for x in said] + ["no json", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clean.json_cleaner()("t").alias("o"))
    out = {r["i"]: r["o"] for r in df.collect()}
    assert [json.loads(out[i]) for i in range(4)] == [walk(x) for x in said] and [out[i] for i in (4, 5, 6)] == texts[4:]
    assert walk(said[0])["value"] == "The cat"


def test_c11_conversations(spark, sf):
    def plain(t):
        if t is None:
            return None
        t = stripped(re.sub(clean.IMAGE_TO_QUESTION, r"\1", t))
        t = re.sub(clean.HINT, "", re.sub(clean.ANSWER, "", t))
        t = re.sub(clean.OPTIONS, " ", re.sub(clean.QUESTION, " ", t)).strip().strip(clean.QUOTES)
        assert "<image>" not in t  # such texts are tested with the token rules
        t = re.sub(r"\n{3,}", "\n\n", t)
        t = re.sub(r"\n\n(?=(?:[A-Za-z]|[0-9]+)[.)]?(?:\s|$))", "\n", t)
        return re.sub(r"[ \t]{2,}", " ", t).replace("*", "")

    turns = {}
    for c, n, t in table(spark, sf, "conversations", "conv_id", "turn", "text"):
        turns.setdefault(c, []).append((n, t))
    got = {r["id"]: r["said"] for r in catalog.QUERIES["C11_conversations"](spark, sf).collect()}
    assert {c: sorted(map(str, said)) for c, said in got.items()} == {c: sorted(str(plain(t)) for _, t in rows) for c, rows in turns.items()}
    for c, rows in turns.items():
        if len({n for n, _ in rows}) == len(rows):
            assert got[c] == [plain(t) for _, t in sorted(rows)]


@pytest.mark.parametrize("k", [1, 3, 9])
def test_draws_of_a_small_pool(spark, k):
    """Every draw gets a row, of fewer than k too; an empty pool gives none."""
    pool = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), (None,)], "p string")
    got = {r["draw"]: r["p"] for r in sampling.with_replacement(pool, "p", k, 300).collect()}
    assert sorted(got) == list(range(300)) and len(set(got.values())) == min(k, 4)
    assert sampling.with_replacement(pool.limit(0), "p", k, 300).count() == 0
