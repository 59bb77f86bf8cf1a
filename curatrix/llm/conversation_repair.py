"""Operator 11: conversation structure repair by Dial's shortest paths and a walk along tight arcs."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stage, table, tidy

#: Rows of a conversation that one block holds at most, as a power of two; longer ones are joined from their blocks.
BLOCK_BITS = 12
#: What an edit costs; a truncated row that isn't deleted adds CUT.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: States by what has been put out: nothing, a first system turn, a user turn last, an assistant turn last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a made turn leads, and what its role is: user turns first and after assistants, assistants after users.
MADE = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
FAR = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
_EXTRA = {"-": 0, "t": CUT}


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept turn with that initial; None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def to_go(marks: str, ends: list[int], last: bool) -> list[int]:
    """Costs from each node (rows done, state), at 4 * rows + state, to the end of a block whose exits cost `ends`.

    marks has two letters for each row: the role's initial (u, a, s or x) and its
    fault (b blank, d duplicate, t truncated, - none). Dial's algorithm against
    the arcs: bucket d holds the nodes at distance d; as costs are small whole
    numbers, the buckets are walked in order and no heap is needed. Turns may be
    inserted before each row, after the last one only in a last block.
    """
    n = len(marks) // 2
    cost = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = []

    def reach(node: int, d: int) -> None:
        if d < cost[node]:
            cost[node] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append(node)

    base = min(ends)
    for state, d in enumerate(ends):
        if d < FAR:
            reach(4 * n + state, d - base)
    d = 0
    while d < len(buckets):
        for node in buckets[d]:  # which a kept row, at no cost, may still lengthen
            if cost[node] != d:
                continue
            i, state = divmod(node, 4)
            made = [s for s in range(4) if MADE[s] == state]
            if i < n or last:
                for s in made:
                    reach(4 * i + s, d + INSERT)
            if i:
                initial, fault = marks[2 * i - 2], marks[2 * i - 1]
                reach(node - 4, d + DELETE)
                if fault in _EXTRA:
                    for s in made:
                        reach(4 * i - 4 + s, d + REROLE + _EXTRA[fault])
                    for s in range(4):
                        if kept_state(s, initial) == state:
                            reach(4 * i - 4 + s, d + _EXTRA[fault])
        d += 1
    return [c if c >= FAR else c + base for c in cost]


def walk(marks: str, cost: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least letters along tight arcs from a state before the first row, and the state that they end in.

    A letter leads from a node to one node only, so the least tight letter at each
    node gives the least audit.
    """
    n, i, out = len(marks) // 2, 0, []
    while i < n or last and cost[4 * n + state]:
        left = cost[4 * i + state]
        if i < n and cost[4 * i + 4 + state] + DELETE == left:
            out.append("D")
            i += 1
            continue
        if cost[4 * i + MADE[state]] + INSERT == left:
            out.append("I")
            state = MADE[state]
            continue
        extra = _EXTRA[marks[2 * i + 1]]
        kept = kept_state(state, marks[2 * i])
        if kept is not None and cost[4 * i + 4 + kept] + extra == left:
            out.append("K")
            state = kept
        else:
            out.append("R")
            state = MADE[state]
        i += 1
    return "".join(out), state


#: Costs of ending in each state: the turns must be none, or end with an assistant's.
ACCEPT = [0, FAR, FAR, 0]


def _whole(marks: str) -> tuple[int, str]:
    cost = to_go(marks, ACCEPT, True)
    return cost[EMPTY], walk(marks, cost, EMPTY, True)[0]


_often = lru_cache(maxsize=1 << 16)(_whole)


def whole(marks: str) -> tuple[int, str]:
    """Cost and audit of a conversation; those of short ones are remembered, as few differ."""
    return _often(marks) if len(marks) <= 64 else _whole(marks)


def illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def arranged(rows: DataFrame) -> DataFrame:
    """Rows in order, written: conv, at, turn, role, text, initial, fault, said.

    Rows are dealt by ranges of (conversation, turn, role, text), so the longest
    conversation is as many tasks' work as it has rows for; rows that agree in all
    are told apart by their place in the input. `at` grows in that order. Of long
    roles and texts 64 characters and a hash take part, which keeps equal ones together.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = rows.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("initial", F.when(initial.isin("u", "a", "s"), initial).otherwise(F.lit("x")))
    rows = rows.withColumn("fault", F.when(bare == "", F.lit("b")).when(F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit("-")).otherwise(F.lit("t")))
    rows = rows.withColumn("said", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)))
    rows = rows.withColumn("_place", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text"), F.col("_place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")
    return stage(rows.withColumn("at", F.monotonically_increasing_id()), "turns")


def blocks(rows: DataFrame, block_bits: int) -> DataFrame:
    """(conv, block, marks): the marks of neighbouring rows of a conversation, in order, at most 2^block_bits rows."""
    first = rows.groupBy("conv", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    marked = rows.select("conv", "at", "initial", "fault").join(first, "at", "left")  # by place, so copies are no hot key
    fault = F.when(F.col("fault") == "b", F.lit("b")).when(F.col("first").isNull(), F.lit("d")).otherwise(F.col("fault"))
    marked = marked.select("conv", "at", F.shiftright("at", block_bits).alias("block"), F.concat("initial", fault).alias("mark"))
    held = F.array_sort(F.collect_list(F.struct("at", "mark")))
    return marked.groupBy("conv", "block").agg(F.array_join(F.transform(held, lambda x: x["mark"]), "").alias("marks"))


_RESULT = "conv string, cost long, audit string, blank long, duplicate long, truncated long, illegal long"


def _figures(marks: str) -> list[int]:
    faults = marks[1::2]
    return [faults.count("b"), faults.count("d"), faults.count("t"), illegal(marks[0::2])]


def repair_plans(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(conv, cost, audit, blank, duplicate, truncated, illegal) of the conversations of arranged rows.

    A conversation within one block is solved at once. A longer one is solved
    block by block: the costs between the states before and after each block (four
    runs), from these the costs to go after each block, then the four walks through
    each block, of which the conversation's own are joined. What one task holds of
    a conversation is a few numbers for each block, and four letters a row for the
    audit, which is one value of the result.
    """
    import pyarrow as pa

    def table_of(rows: list, names: str) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
        fields = [f.strip().split(" ") for f in names.split(",")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    def solved(batches):
        for b in batches:
            if b.num_rows:
                yield table_of([(c, *whole(m), *_figures(m)) for c, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], _RESULT)

    across = "conv string, block long, last boolean, costs array<long>"

    def crossed(batches):
        for b in batches:
            out = []
            for conv, block, end, marks in zip(*(b.column(k).to_pylist() for k in range(4))):
                runs = [ACCEPT] if block == end else [[0 if s == t else FAR for s in range(4)] for t in range(4)]
                out.append((conv, block, block == end, [c for ends in runs for c in to_go(marks, ends, block == end)[:4]]))
            if out:
                yield table_of(out, across)

    after = "conv string, block long, ends array<long>"

    def gone(group: pa.Table) -> pa.Table:
        own = sorted(group.to_pylist(), key=lambda r: r["block"], reverse=True)
        out, ends = [], ACCEPT
        for r in own:
            out.append((r["conv"], r["block"], ends))
            c = r["costs"]
            ends = c if r["last"] else [min(min(FAR, c[4 * t + s] + ends[t]) for t in range(4)) for s in range(4)]
        return pa.Table.from_batches([table_of(out, after)])

    walks = "conv string, block long, begin long, blank long, duplicate long, truncated long, illegal long, edge string, pieces array<string>, exits array<long>"

    def walked(batches):
        for b in batches:
            out = []
            for conv, block, end, marks, ends in zip(*(b.column(k).to_pylist() for k in range(5))):
                cost = to_go(marks, ends, block == end)
                ways = [walk(marks, cost, s, block == end) if cost[s] < FAR else ("", s) for s in range(4)]
                out.append((conv, block, cost[EMPTY], *_figures(marks), marks[0] + marks[-2], [w for w, _ in ways], [s for _, s in ways]))
            if out:
                yield table_of(out, walks)

    def joined(group: pa.Table) -> pa.Table:
        own = sorted(group.to_pylist(), key=lambda r: r["block"])
        audit, state = [], EMPTY
        for r in own:
            audit.append(r["pieces"][state])
            state = r["exits"][state]
        sums = [sum(r[k] for r in own) for k in ("blank", "duplicate", "truncated", "illegal")]
        sums[3] += sum(illegal(a["edge"][1] + b["edge"][0]) for a, b in zip(own, own[1:]))
        return pa.Table.from_batches([table_of([(own[0]["conv"], own[0]["begin"], "".join(audit), *sums)], _RESULT)])

    cut = stage(blocks(rows, block_bits), "blocks")
    spans = cut.groupBy("conv").agg(F.count(F.lit(1)).alias("parts"), F.max("block").alias("end"))
    of = stage(cut.join(spans, "conv"), "spans")
    drop(cut)
    short = of.filter("parts = 1").select("conv", "marks").mapInArrow(tidy(solved), _RESULT)
    long = of.filter("parts > 1").select("conv", "block", "end", "marks")
    if not long.limit(1).count():
        return short
    ends = long.mapInArrow(tidy(crossed), across).groupBy("conv").applyInArrow(gone, after)
    pieces = long.join(ends, ["conv", "block"]).select("conv", "block", "end", "marks", "ends").mapInArrow(tidy(walked), walks)
    return short.unionByName(pieces.groupBy("conv").applyInArrow(joined, _RESULT))


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations, turn by turn: conv, seq, edit, role, text; in order within a part, each in one part.

    Rows stream by behind their conversation's audit; no conversation is held.
    """
    import pyarrow as pa

    names = ["conv", "seq", "edit", "role", "text"]
    head = plans.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    src = rows.select("conv", "at", "role", "text").unionByName(head).repartition("conv").sortWithinPartitions("conv", "at")

    def turns(batches):
        out, size = [], 0
        conv, audit, at, seq, state = None, "", 0, 0, EMPTY

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 1 else pa.string()) for k in range(5)], names=names)

        def inserted():
            nonlocal at, seq, state
            while at < len(audit) and audit[at] == "I":
                out.append((conv, seq, "I", ROLE[state], ""))
                at, seq, state = at + 1, seq + 1, MADE[state]

        for b in batches:
            for c, place, role, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if place < 0:
                    conv, audit, at, seq, state = c, text, 0, 0, EMPTY
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        now = role if edit == "K" else ROLE[state]
                        state = kept_state(state, role[:1]) if edit == "K" else MADE[state]
                        out.append((conv, seq, edit, now, text))
                        seq, size = seq + 1, size + len(text)
                inserted()
                if len(out) >= 10_000 or size >= 4 << 20:
                    yield full()
                    out, size = [], 0
        if out:
            yield full()

    return src.mapInArrow(tidy(turns), "conv string, seq long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the rows of repaired_rows(), whose parts hold whole conversations in order.

    The digest of one conversation is of one text, which is fed to it turn by turn.
    """
    import pyarrow as pa

    def hashed(batches):
        conv, held, out = None, None, []
        for b in batches:
            for c, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                said = f"{role}:{text}".encode()
                if c != conv:
                    if conv is not None:
                        out.append((conv, held.hexdigest()))
                    conv, held = c, hashlib.sha256(said)
                else:
                    held.update(b"\n" + said)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(2)], names=["conv", "repaired_sha256"])
                out = []
        if conv is not None:
            out.append((conv, held.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(2)], names=["conv", "repaired_sha256"])

    return turns.select("conv", "role", "text").mapInArrow(tidy(hashed), "conv string, repaired_sha256 string")


def repair(rows: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(reports, turns) of conversations (conv_id, turn, role, text).

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    turns: conv, seq, edit, role, text of the repaired conversations.

    Rows are taken by turn, null turns first, those of one turn by role and text.
    Null roles and texts are one space, so such a text is blank and such a role
    must be changed; a null conv_id is a conversation of its own. Repeated rows are
    duplicates of the first. Texts may have any length. Other columns are dropped;
    an empty table gives empty results.
    """
    src = arranged(rows)
    plans = stage(repair_plans(src, block_bits), "plans")
    turns = repaired_rows(src, plans)
    spans = src.groupBy("conv").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("kinds"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("kinds"), F.lit(0).cast("long"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    reports = plans.join(spans, "conv").join(digests(turns), "conv", "left")
    reports = reports.select(_conv_id(), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
    return reports, turns


def _conv_id() -> Column:
    return F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by a rule: a crc32 of conv_id and turn drops, empties, strips, repeats or re-labels a row."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20)).cast("int")
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of repair() on damaged conversations, for every conv_id; one without rows has zeros and empty texts."""
    src = table(spark, sf_dir, "conversations")
    reports, _ = repair(damaged(src))
    every = src.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    reports = reports.withColumnRenamed("conv_id", "_id")
    out = every.join(reports, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    texts = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], *[F.coalesce(c, F.lit(t)).alias(c) for c, t in texts.items()])
