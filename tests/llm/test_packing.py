import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from curatrix.llm import packing

from .helpers import documents

ODD = ["", None, " ", "Hello, World.", "It's a.b, c", "é J̌ İx", "ﬁne Été. naïve,", "<|endoftext|> x<|endoftext|>y", "a b c", "x" * 9000, "1234 5,6", "don't, we'll. é.", "tab\tnew\nline\x0b\x0c\r"]


def expected(text, t):
    return t.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check(spark, rows, sequence):
    t = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(documents(spark, rows), sequence=sequence).collect()
    want = []
    for i, text in rows:
        ids = expected(text, t)
        for k, s in enumerate(range(0, len(ids), sequence)):
            want.append((i, k, s, len(ids[s : s + sequence]), zlib.crc32(np.array(ids[s : s + sequence], dtype="<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by), sum(w[3] for w in want)


def test_pieces_and_places(spark):
    rng = random.Random(0)
    rows = list(enumerate(ODD)) + [(100 + k, " ".join(rng.choice(["alpha", "Beta,", "gamma.", "été"]) for _ in range(rng.randint(0, 120)))) for k in range(150)]
    rows += [(7, "twice"), (7, "twice"), (None, "no id"), (None, None)]
    bins, tokens = check(spark, rows, 64)
    assert bins <= -(-tokens // 64) + 1


def test_a_common_length_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 8)
    rows = [(k, "the same words in all") for k in range(150)] + [(9, "repeated row")] * 60 + [(None, "no id")] * 40 + [(k, "one") for k in range(200, 240)]
    bins, tokens = check(spark, rows, 32)
    assert bins <= -(-tokens // 32) * 1.2


def test_empty(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_minimum_bin_slack_is_complete():
    rng = random.Random(5)
    for _ in range(30):
        space = rng.randint(5, 60)
        counts = {k: rng.randint(1, 9) for k in rng.sample(range(1, space + 1), rng.randint(1, min(space, 12)))}
        kinds = packing.minimum_bin_slack(dict(counts), space)
        used = {}
        for chosen, times in kinds:
            assert times >= 1 and sum(k * n for k, n in chosen.items()) <= space
            for k, n in chosen.items():
                used[k] = used.get(k, 0) + n * times
        assert used == counts


def test_fullest_is_the_best():
    rng = random.Random(6)
    for _ in range(60):
        counts = {k: rng.randint(1, 4) for k in rng.sample(range(1, 30), 5)}
        space = rng.randint(1, 70)
        reach = {0}
        for k, n in counts.items():
            reach = {r + k * m for r in reach for m in range(n + 1)}
        chosen = packing.fullest(counts, space)
        assert all(counts[k] >= n for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(r for r in reach if r <= space)
