"""Plain models of the contracts, without any of the library's code."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = WORD.findall(lowered(text))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def documents(spark, rows):
    """doc_id and text with the other columns of documents, and some that clash with computed names."""
    full = [(i, t, "en", "src0", len(t or ""), "x", 1, 2.0) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int, score double")
