"""Operator 7: a hierarchical Pitman-Yor language model, seated by Gibbs sweeps, and scores of whole texts.

Every preceding word of the training fold (and the start of a text) has a
restaurant of its own; all share the root, whose base is uniform over the words
and one unknown word. Work is dealt to three kinds of owners, which send each
other blobs of arrays: parts own contexts with their pairs, word parts own words
with their root seats, chunks own some megabytes of texts. An owner is a group of
a grouped map, and every step is a table in the shared folder, so that a lost
executor costs its tasks only. A chunk asks for its distinct pairs and words
once, and scores its texts from the answers.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, drop, mix, stage, table, tidy, word_hashes

#: Sweeps that only settle the seats, and sweeps whose predictive probabilities are averaged.
BURN_IN, SAMPLES = 1, 3
THETA = 1.0
#: Bytes of text in a chunk (a longer text is a chunk by itself), and for each part.
CHUNK, PART = 10 << 20, 12 << 20
#: Contexts that are split by their followers, the most frequent words of so many documents; results don't depend on it.
SPLIT, SPLIT_ROWS = 1_000, 2_000
#: The number of tables of up to so many customers is drawn from its exact distribution, of more from its limit.
EXACT = 1024
END, START = (int(mix(np.array([k], dtype=np.uint64))[0]) for k in (0xE0D, 0x57A7))
#: Kinds of rows.
REQUEST, WORDS, TEXTS, COUNTS, ACTIVE, MET, WORD_STATE, ROOT, SUMS, PAIR_ANSWER, WORD_ANSWER, TOTAL = range(12)
ROW = "dst long, src long, kind int, v double, blob binary"
#: Numbers of the totals that come to the driver; split contexts have two each from FIRST_SPLIT on.
ONES, TWOS, TOKENS, TYPES, CUSTOMERS, TABLES, ROOT_ONES, ROOT_TWOS, FIRST_SPLIT = range(9)
_stirling: dict[float, np.ndarray] = {}


def held_out(fold: int = 5, which: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == which, F.lit(False))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words with one end after each text, and how many tokens each text has."""
    hashes, counts = word_hashes(texts)
    return np.insert(hashes, np.cumsum(counts), np.uint64(END)), counts + 1


# Blobs


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, by byte planes, so that small numbers take little room."""
    import pyarrow as pa

    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    raw = b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(blob[8:], decompressed_size=struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)
    (count,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(count):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        at += struct.calcsize("<2sQ")
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * dtype.itemsize, offset=at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; narrow() then makes them small."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as they need."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def wide(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64)


def from_steps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint64 if a.dtype == np.uint64 else np.int64)


def _rows(rows):
    import pyarrow as pa

    dst, src, kind, v, blob = zip(*rows) if rows else ([],) * 5
    return pa.table({"dst": pa.array(dst, pa.int64()), "src": pa.array(src, pa.int64()), "kind": pa.array(kind, pa.int32()), "v": pa.array(v, pa.float64()), "blob": pa.array(blob, pa.binary())})


def _got(group) -> dict[int, dict[int, bytes]]:
    """The blobs of a group by kind and sender, senders in order."""
    out: dict[int, dict[int, bytes]] = {}
    src, kind, blob = group.column("src").to_pylist(), group.column("kind").to_pylist(), group.column("blob")
    for k in sorted(range(len(src)), key=lambda k: src[k]):
        out.setdefault(kind[k], {})[src[k]] = blob[k].as_py()
    return out


def _own(p: int) -> int:
    return 3 * p


def _word_owner(q: int) -> int:
    return 3 * q + 1


def _total(key: int, v: float):
    return (key, 0, TOTAL, float(v), None)


# Seats


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: row c, column t is the weight of all seatings of c customers at t tables."""
    if d not in _stirling:
        _stirling.clear()
        out = np.full((most + 1, most + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(most + 1)
        for c in range(1, most):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.log(np.maximum(c - d * t[1 : c + 2], 1e-300)) + out[c, 1 : c + 2])
        _stirling[d] = out
    return _stirling[d]


def seated(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers, drawn with weight x^t times the weight of all seatings at t tables.

    Given a Gamma variable g of shape theta / d + T for a restaurant of T tables,
    x is d g P(dish | parent), and the dishes of a restaurant are independent: to
    draw g and then all t is a Gibbs step that unseats and reseats all customers
    of each dish at once. The distribution is exact up to EXACT customers. Beyond,
    t - 1 is drawn from a Poisson distribution, its limit for many customers, with
    the mean of the saddle point.
    """
    t = np.minimum(c, 1).astype(np.int64)
    r = rng.random(len(c))
    log_x = np.log(x)
    table_ = log_stirling(d)
    order = np.argsort(c, kind="stable")
    values, first = np.unique(c[order], return_index=True)
    last = np.append(first[1:], len(c))
    for v, a, b in zip(values.tolist(), first.tolist(), last.tolist()):
        if v < 2:
            continue
        if v > EXACT:
            break
        width = max(1, (1 << 19) // v)
        for k in range(a, b, width):
            own = order[k : min(b, k + width)]
            w = log_x[own, None] * np.arange(1, v + 1) + table_[v, 1 : v + 1]
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[own] = 1 + np.minimum((w < (r[own] * w[:, -1])[:, None]).sum(axis=1), v - 1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        low, high = np.zeros(len(many)), np.ones(len(many))
        for _ in range(50):  # z (1 - z)^(d - 1) = c / x
            z = (low + high) / 2
            small = z * np.maximum(1 - z, 1e-300) ** (d - 1) < c[many] / x[many]
            low, high = np.where(small, z, low), np.where(small, high, z)
        mean = x[many] * (1 - (1 - z) ** d) / d
        t[many] = np.clip(1 + rng.poisson(mean), 1, c[many])
    return t


def _discount(one: float, two: float) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


# Chunks


class Layout:
    """How pairs and words are dealt out: a part by the context's hash, and for split contexts by the follower's too."""

    def __init__(self, parts: int, split: dict[int, int]):
        self.parts = parts
        self.split = np.array(sorted(split), dtype=np.uint64)
        self.ways = np.array([split[k] for k in sorted(split)], dtype=np.int64)

    def number(self, u: np.ndarray) -> np.ndarray:
        """The number of each split context, -1 for the others."""
        if not len(self.split):
            return np.full(len(u), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.split, u), len(self.split) - 1)
        return np.where(self.split[at] == u, at, -1)


def _pairs(word: np.ndarray, counts: np.ndarray, start: int, owner: np.ndarray, salt: np.ndarray, ways: np.ndarray, parts: int):
    """Of a chunk's word numbers in order: its distinct pairs as (context, word, part), ordered by part, context and word, and the pair of each token."""
    context = np.concatenate((word[:1], word[:-1]))
    context[np.cumsum(counts) - counts] = start
    code, back = np.unique(context * len(owner) + word, return_inverse=True)
    u, w = code // len(owner), code % len(owner)
    part = np.where(ways[u] > 1, (owner[u] + salt[w] % np.maximum(ways[u], 1)) % parts, owner[u])
    by = np.argsort(part, kind="stable")
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    return u[by], w[by], part[by], rank[back]


def _bounds(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin and end."""
    first = np.flatnonzero(np.diff(sorted_, prepend=sorted_[:1] - 1)) if len(sorted_) else np.zeros(0, dtype=np.int64)
    return first, np.append(first[1:], len(sorted_)).astype(np.int64)


def chunk_rows(docs: DataFrame, layout: Layout) -> DataFrame:
    """A row for each chunk of docs (doc_id, text, train): its texts as word numbers, and apart from them the words' hashes."""
    parts = layout.parts

    def made(number: int, ids: list, texts: list, train: list):
        import pyarrow as pa

        w, n = tokens(texts)
        vocabulary, word = np.unique(np.append(w, np.uint64(START)), return_inverse=True)
        start, word = int(word[-1]), word[:-1]
        split = layout.number(vocabulary)
        ways = np.where(split >= 0, layout.ways[split], 0) if len(layout.ways) else np.zeros(len(vocabulary), dtype=np.int64)
        owner, salt = vocabulary % np.uint64(parts), (vocabulary >> np.uint64(44)) & np.uint64(0xFFFF)
        often = np.argsort(-np.bincount(word, minlength=len(vocabulary)), kind="stable")
        place = np.empty(len(often), dtype=np.int64)
        place[often] = np.arange(len(often))
        null = np.array([i is None for i in ids], dtype=np.uint8)
        own_ids = np.array([i or 0 for i in ids], dtype=np.int64)
        blob = pack(own_ids, null, narrow(n), narrow(often), narrow(place[word]), narrow(owner), narrow(salt), narrow(ways), narrow(np.array([start])))
        row = _rows([(3 * number + 2, 3 * number + 2, TEXTS, 0.0, blob)])
        return row.append_column("words", pa.array([pack(steps(vocabulary), np.array(train, dtype=np.uint8))], pa.binary())).to_batches()

    def rows(batches):
        from pyspark import TaskContext

        number, ids, texts, train, size = TaskContext.get().partitionId() << 24, [], [], [], 0
        for batch in batches:
            for i, t, learn in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                if size and size + len(t or b"") > CHUNK:
                    yield from made(number, ids, texts, train)
                    number, ids, texts, train, size = number + 1, [], [], [], 0
                ids.append(i)
                texts.append(t)
                train.append(learn)
                size += len(t or b"") + 1
        if ids:
            yield from made(number, ids, texts, train)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("train").cast("boolean").alias("train"))
    return src.mapInArrow(tidy(rows), ROW + ", words binary")


def _chunk(batch, k: int):
    """A chunk's word hashes, the words and counts of its texts, which tokens are learnt, and what _pairs takes besides."""
    _, _, counts, often, place, owner, salt, ways, start = unpack(batch.column("blob")[k].as_py())
    vocabulary, train = unpack(batch.column("words")[k].as_py())
    counts = wide(counts)
    return from_steps(vocabulary), wide(often)[place], counts, np.repeat(train, counts), (int(start[0]), wide(owner), wide(salt), wide(ways))


def pair_requests(chunks_: DataFrame, parts: int) -> DataFrame:
    """Each chunk's distinct pairs and how often they are learnt, to the parts that own them."""

    def made(batch, k):
        vocabulary, word, n, learnt, dealt = _chunk(batch, k)
        u, v, part, back = _pairs(word, n, *dealt, parts)
        c = np.bincount(back, learnt, minlength=len(u)).astype(np.int64)
        for a, b in zip(*_bounds(part)):
            runs, ends = _bounds(u[a:b])
            known, at = np.unique(v[a:b], return_inverse=True)
            yield (_own(int(part[a])), batch.column("dst")[k].as_py(), REQUEST, 0.0, pack(steps(vocabulary[u[a:b][runs]]), narrow(ends - runs), steps(vocabulary[known]), narrow(at), narrow(c[a:b])))

    return _each(chunks_, made)


def word_requests(chunks_: DataFrame) -> DataFrame:
    """Each chunk's words and how often they are learnt, to the word parts that own them."""

    def made(batch, k):
        vocabulary, word, n, learnt, (_, owner, _, _) = _chunk(batch, k)
        seen = np.bincount(word, learnt, minlength=len(vocabulary)).astype(np.int64)
        by = np.argsort(owner, kind="stable")
        for a, b in zip(*_bounds(owner[by])):
            own = by[a:b]
            yield (_word_owner(int(owner[own[0]])), batch.column("dst")[k].as_py(), WORDS, 0.0, pack(steps(vocabulary[own]), narrow(seen[own])))

    return _each(chunks_, made)


def _each(chunks_: DataFrame, made) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _rows(list(made(batch, k))).to_batches()

    return chunks_.mapInArrow(tidy(rows), ROW)


# Owners of contexts


def gather_pairs(layout: Layout):
    """A part merges its requests: counts of all its pairs for the answers, pairs of two customers or more for the sweeps, and words met."""
    parts = layout.parts

    def run(group):
        got = _got(group)[REQUEST]
        dst = group.column("dst")[0].as_py()
        us, ws, cs, sizes = [], [], [], []
        for blob in got.values():
            du, runs, dw, at, c = unpack(blob)
            us.append(np.repeat(from_steps(du), wide(runs)))
            ws.append(from_steps(dw)[at])
            cs.append(wide(c))
            sizes.append(len(c))
        u, w, c = (np.concatenate(x) for x in (us, ws, cs))
        del us, ws, cs
        by = np.lexsort((w, u))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (u[by][1:] != u[by][:-1]) | (w[by][1:] != w[by][:-1])
        pair = np.empty(len(by), dtype=np.int64)
        pair[by] = np.cumsum(new) - 1
        u, w = u[by][new], w[by][new]
        c = np.bincount(pair, c, minlength=len(u)).astype(np.int64)
        runs, ends = _bounds(u)
        maps, at = [], 0
        for size in sizes:  # a chunk's pairs are in order, so their places rise
            maps.append(narrow(steps(pair[at : at + size])))
            at += size
        room = np.repeat(np.arange(len(runs)), ends - runs)
        number = layout.number(u[runs])
        hot = np.flatnonzero(number >= 0)
        out = [(dst, dst, COUNTS, 0.0, pack(narrow(c), narrow(ends - runs), np.array(list(got), dtype=np.int64), hot, number[hot], *maps))]
        active = np.flatnonzero(c > 1)
        customers = np.bincount(room, c, minlength=len(runs)).astype(np.int64)
        single = np.bincount(room, c == 1, minlength=len(runs)).astype(np.int64)
        seen = np.flatnonzero(c > 0)
        known, at = np.unique(w[seen], return_inverse=True)
        one = np.bincount(at, c[seen] == 1, minlength=len(known)).astype(np.int64)
        more = np.bincount(at, c[seen] > 1, minlength=len(known)).astype(np.int64)
        owner = (known % np.uint64(parts)).astype(np.int64)
        by = np.argsort(owner, kind="stable")
        place = np.full(len(known), -1, dtype=np.int64)
        mine = by[more[by] > 0]
        place[mine] = np.arange(len(mine))
        for a, b in zip(*_bounds(owner[by])):
            own = by[a:b]
            out.append((_word_owner(int(owner[own[0]])), dst, MET, 0.0, pack(steps(known[own]), narrow(one[own]), narrow(more[own]))))
        of_active = place[at[np.searchsorted(seen, active)]]
        owners, sizes_ = np.unique(owner[mine], return_counts=True)
        out.append((dst, dst, ACTIVE, 0.0, pack(narrow(steps(active)), narrow(room[active]), narrow(of_active), narrow(c[active]), narrow(np.ones(len(active), dtype=np.int64)), narrow(np.zeros(len(active), dtype=np.int64)), narrow(customers), narrow(single), hot, number[hot], owners, sizes_)))
        out += [_total(ONES, (c == 1).sum()), _total(TWOS, (c == 2).sum())]
        for h, k in zip(hot.tolist(), number[hot].tolist()):
            out += [_total(FIRST_SPLIT + 2 * k, customers[h]), _total(FIRST_SPLIT + 2 * k + 1, (c[runs[h] : ends[h]] > 0).sum())]
        return _rows(out)

    return run


def sweep(number: int, keep: bool, d: float, d0: float, root: tuple[float, float, float], split_g: np.ndarray):
    """A part draws the tables of its pairs anew, given the root's seats; keep adds them to the samples."""
    customers0, tables0, types = root

    def run(group):
        got = _got(group)
        dst = group.column("dst")[0].as_py()
        active, room, word, c, t, total, customers, single, hot, split, owners, sizes, *kept = unpack(got[ACTIVE][dst])
        c, t, single = wide(c), wide(t), wide(single)
        seats = [unpack(b) for b in got.get(ROOT, {}).values()]
        rng = np.random.default_rng([number, dst])
        if len(c):
            m, t0 = (np.concatenate([s[k] for s in seats]).astype(np.float64) for k in (0, 1))
            p0 = (np.maximum(m - d0 * t0, 0) + (THETA + d0 * tables0) / (types + 1)) / (THETA + customers0)
            tables = single + np.bincount(room, t, minlength=len(single)).astype(np.int64)
            g = rng.standard_gamma(THETA / d + tables)
            g[hot] = split_g[split]
            t = seated(c, d * np.maximum(g[room], 1e-12) * p0[word], d, rng)
            total = wide(total) + t * keep
        tables = single + np.bincount(room, t, minlength=len(single)).astype(np.int64)
        if keep:
            kept.append(narrow(tables))
        out = [(dst, dst, ACTIVE, 0.0, pack(active, room, word, narrow(c), narrow(t), narrow(total), customers, narrow(single), hot, split, owners, sizes, *kept))]
        sums = np.bincount(word, t, minlength=int(sizes.sum())).astype(np.int64)
        ends = np.cumsum(sizes)
        for q, a, b in zip(owners.tolist(), (ends - sizes).tolist(), ends.tolist()):
            out.append((_word_owner(q), dst, SUMS, 0.0, pack(narrow(sums[a:b]))))
        for h, k in zip(hot.tolist(), split.tolist()):
            out.append(_total(FIRST_SPLIT + 2 * k + 1, tables[h]))
        return _rows(out)

    return run


def answer_pairs(samples: int, split: dict[int, list[float]]):
    """A part answers each chunk: customers and tables, over all samples, of its pairs, and of its contexts in each sample."""

    def run(group):
        got = _got(group)
        dst = group.column("dst")[0].as_py()
        c, sizes, chunks_, _, _, *maps = unpack(got[COUNTS][dst])
        active, _, _, _, _, total, customers, _, hot, number, _, _, *tables = unpack(got[ACTIVE][dst])
        c, customers, tables = wide(c), wide(customers), [wide(x) for x in tables]
        for h, k in zip(hot.tolist(), number.tolist()):  # a split context's totals are those of all its parts
            customers[h] = split[k][0]
            for x, y in zip(tables, split[k][1:]):
                x[h] = y
        t = samples * (c == 1)
        t[from_steps(active)] = total
        room = np.repeat(np.arange(len(sizes)), wide(sizes))
        out = []
        for chunk, map_ in zip(chunks_.tolist(), maps):
            at = from_steps(map_)
            rooms = room[at]
            rooms = rooms[_bounds(rooms)[0]]
            out.append((chunk, dst, PAIR_ANSWER, 0.0, pack(narrow(c[at]), narrow(t[at]), narrow(customers[rooms]), *[narrow(x[rooms]) for x in tables])))
        return _rows(out)

    return run


# Owners of words


def gather_words(group):
    """A word part merges what chunks and parts have of its words: tokens, and the tables that the contexts begin with."""
    got = _got(group)
    dst = group.column("dst")[0].as_py()
    asked = {s: unpack(b) for s, b in got.get(WORDS, {}).items()}
    met = {s: unpack(b) for s, b in got.get(MET, {}).items()}
    lists = [from_steps(x[0]) for x in (*asked.values(), *met.values())]
    known = np.unique(np.concatenate(lists))
    c, one, more = (np.zeros(len(known), dtype=np.int64) for _ in range(3))
    maps, met_maps = [], []
    for words, x in zip(lists, asked.values()):
        at = np.searchsorted(known, words)
        c[at] += wide(x[1])
        maps.append(narrow(steps(at)))
    for words, x in zip(lists[len(asked) :], met.values()):
        at = np.searchsorted(known, words)
        one[at] += wide(x[1])
        more[at] += wide(x[2])
        met_maps.append(narrow(steps(at[x[2] > 0])))
    m = one + more
    t0 = np.minimum(m, 1)
    out = [(dst, dst, WORD_STATE, 0.0, pack(narrow(c), narrow(one), np.array(list(asked), dtype=np.int64), np.array(list(met), dtype=np.int64), *maps, *met_maps))]
    out += [_total(TOKENS, c.sum()), _total(TYPES, (c > 0).sum()), _total(CUSTOMERS, m.sum()), _total(TABLES, t0.sum()), _total(ROOT_ONES, (m == 1).sum()), _total(ROOT_TWOS, (m == 2).sum())]
    return _rows(out + _to_parts(dst, met, met_maps, m, t0))


def _to_parts(dst: int, met, met_maps, m: np.ndarray, t0: np.ndarray):
    return [(p, dst, ROOT, 0.0, pack(narrow(m[at]), narrow(t0[at]))) for p, map_ in zip(met, met_maps) if len(at := from_steps(map_))]


def reseat_root(number: int, keep: bool, d0: float, x: float):
    """A word part adds up the tables of its words' contexts and draws the root's tables; keep adds both to the samples."""

    def run(group):
        got = _got(group)
        dst = group.column("dst")[0].as_py()
        c, one, asked, met, *rest = unpack(got[WORD_STATE][dst])
        met_maps, kept = rest[len(asked) : len(asked) + len(met)], rest[len(asked) + len(met) :]
        m = wide(one)
        where = dict(zip(met.tolist(), met_maps))
        for p, blob in got.get(SUMS, {}).items():
            m[from_steps(where[p])] += wide(unpack(blob)[0])
        t0 = np.zeros(len(m), dtype=np.int64)
        some = np.flatnonzero(m > 0)
        t0[some] = seated(m[some], np.full(len(some), x), d0, np.random.default_rng([number, dst]))
        if keep:
            kept += [narrow(m), narrow(t0)]
        out = [(dst, dst, WORD_STATE, 0.0, pack(c, one, asked, met, *rest[: len(asked) + len(met)], *kept)), _total(CUSTOMERS, m.sum()), _total(TABLES, t0.sum())]
        return _rows(out + _to_parts(dst, met.tolist(), met_maps, m, t0))

    return run


def answer_words(group):
    """A word part answers each chunk: tokens, and customers and tables in the root in each sample, of its words."""
    dst = group.column("dst")[0].as_py()
    c, one, asked, met, *rest = unpack(_got(group)[WORD_STATE][dst])
    kept = rest[len(asked) + len(met) :]
    return _rows([(chunk, dst, WORD_ANSWER, 0.0, pack(narrow(c[at]), *[narrow(x[at]) for x in kept])) for chunk, map_ in zip(asked.tolist(), rest) if len(at := from_steps(map_))])


# The model


def score_chunk(parts: int, d: float, d0: float, roots: list[tuple[float, float]], n: float, types: float):
    """A chunk scores its texts: log10 of the averaged predictive probability of every token, summed by text."""
    import pyarrow as pa

    samples = len(roots)

    def run(group):
        got = _got(group)
        ids, null, counts, often, place, owner, salt, ways, start = unpack(next(iter(got[TEXTS].values())))
        word, counts, owner = wide(often)[place], wide(counts), wide(owner)
        u, w, part, back = _pairs(word, counts, int(start[0]), owner, wide(salt), wide(ways), parts)
        pairs = [unpack(b) for b in got[PAIR_ANSWER].values()]
        by_pair = [np.concatenate([x[k] for x in pairs]).astype(np.float64) for k in range(3 + samples)]
        # answers hold a context once for each part
        first = np.flatnonzero((np.diff(u, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        room = np.repeat(np.arange(len(first)), np.diff(first, append=len(u)))
        words = [unpack(b) for b in got[WORD_ANSWER].values()]
        by = np.argsort(owner, kind="stable")
        by_word = np.zeros((1 + 2 * samples, len(owner)))
        for k in range(1 + 2 * samples):
            by_word[k, by] = np.concatenate([x[k] for x in words])
        size = THETA + by_pair[2][room]
        p = (samples * by_pair[0] - d * by_pair[1]) / size
        for k, (customers, tables) in enumerate(roots):
            p0 = (np.maximum(by_word[1 + 2 * k] - d0 * by_word[2 + 2 * k], 0) + (THETA + d0 * tables) / (types + 1)) / (THETA + customers)
            p += (THETA + d * by_pair[3 + k][room]) / size * p0[w]
        log_p = np.log10(p / samples)
        base = np.log10((by_word[0] + 0.5) / (n + 0.5 * (types + 1)))
        begin = np.cumsum(counts) - counts
        sums = [np.add.reduceat(x, begin) for x in ((by_word[0][word] > 0).astype(np.int64), base[word], log_p[back])]
        return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_tokens": pa.array(counts), "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return run


def layout_of(docs: DataFrame, part_bytes: int = PART) -> Layout:
    """Parts by the size of all texts; the most frequent words of a bounded sample are split. Only the dealing depends on it."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")).alias("n")).collect()[0]["n"] or 0
    parts = max(1, -(-size // part_bytes))
    split: dict[int, int] = {}
    if parts > 1:
        ids = docs.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SPLIT_ROWS)
        sample = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select(F.col("text").cast("string").alias("text"))

        def rows(batches):
            import pyarrow as pa

            for batch in batches:
                w, n = np.unique(tokens(as_bytes(batch.column(0)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

        counts = sample.mapInArrow(rows, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
        whole = counts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 1
        for r in counts.orderBy(F.desc("n"), "w").limit(SPLIT).collect():
            ways = min(parts, round(4 * parts * r["n"] / whole))
            if ways > 1:
                split[r["w"] & 0xFFFFFFFFFFFFFFFF] = ways
    return Layout(parts, split)


def language_model_scores(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, part_bytes: int = PART) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id) mod 5 is not 1 (a null id is not
    held out) and scores all. A null or empty text is one token, its end. With
    nothing to learn from, every word is the unknown one. Repeated rows are rows
    of their own and score alike; an empty table gives an empty result. Other
    columns are dropped.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("train", ~held_out())
    layout = layout_of(src, part_bytes)
    kind = F.col("kind")

    def step(rows: DataFrame, run, name: str) -> DataFrame:
        return stage(rows.groupBy("dst").applyInArrow(tidy_group(run), ROW), name)

    def totals(rows: DataFrame) -> dict[int, float]:
        return {r["dst"]: r["v"] for r in rows.filter(kind == TOTAL).groupBy("dst").agg(F.sum("v").alias("v")).collect()}  # at most 8 + 2 SPLIT rows

    def released(*tables: DataFrame) -> None:
        drop(*tables)
        spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver's collector finds their plans

    texts = stage(chunk_rows(src, layout), "chunks")
    parts = step(pair_requests(texts, layout.parts), gather_pairs(layout), "pairs")
    released()
    words = step(word_requests(texts).unionByName(parts.filter(kind == MET)), gather_words, "words")
    released()
    of_pairs, of_words = totals(parts), totals(words)
    types, n = of_words.get(TYPES, 0.0), of_words.get(TOKENS, 0.0)
    d, d0 = _discount(of_pairs.get(ONES, 0), of_pairs.get(TWOS, 0)), _discount(of_words.get(ROOT_ONES, 0), of_words.get(ROOT_TWOS, 0))
    counts, active = parts.filter(kind == COUNTS), parts
    split = {k: [of_pairs.get(FIRST_SPLIT + 2 * k, 0.0)] for k in range(len(layout.split))}
    tables = np.array([of_pairs.get(FIRST_SPLIT + 2 * k + 1, 0.0) for k in split])
    roots: list[tuple[float, float]] = []
    for number in range(burn_in + samples):
        keep = number >= burn_in
        rng = np.random.default_rng([number, 1 << 40])
        root = of_words.get(CUSTOMERS, 0.0), of_words.get(TABLES, 0.0)
        split_g = rng.standard_gamma(THETA / d + tables)
        new = step(active.filter(kind == ACTIVE).unionByName(words.filter(kind == ROOT)), sweep(number, keep, d, d0, (*root, types), split_g), "seats")
        x = d0 * max(1e-12, rng.standard_gamma(THETA / d0 + root[1])) / (types + 1)
        again = step(words.filter(kind == WORD_STATE).unionByName(new.filter(kind == SUMS)), reseat_root(number, keep, d0, x), "words")
        of_parts, of_words = totals(new), totals(again)
        released(words, *([active] if number else []))
        active, words = new, again
        tables = np.array([of_parts.get(FIRST_SPLIT + 2 * k + 1, 0.0) for k in split])
        if keep:
            roots.append((of_words.get(CUSTOMERS, 0.0), of_words.get(TABLES, 0.0)))
            for k in split:
                split[k].append(tables[k])
    to_chunks = step(counts.unionByName(active.filter(kind == ACTIVE)), answer_pairs(samples, split), "answers")
    words_answers = step(words.filter(kind == WORD_STATE), answer_words, "answers")
    released(parts, active, words)
    scored = texts.drop("words").unionByName(to_chunks).unionByName(words_answers).groupBy("dst").applyInArrow(score_chunk(layout.parts, d, d0, roots, n, types), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def tidy_group(run):
    """Wraps a function of one group: its worker gives free memory back afterwards."""

    def wrapped(group):
        return next(tidy(lambda g: iter([run(g)]))(group))

    return wrapped


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language_model_scores() over all documents."""
    return language_model_scores(table(spark, sf_dir, "documents"))
