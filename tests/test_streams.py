"""Streams over several batches, resumed and late; votes against plain loops."""

import itertools
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curatrix.functions import layout
from curatrix.plans import queries_streams
from curatrix.sources import scratch
from curatrix.streaming import rolling, run, votes

ROWS = "key string, ts long, content string, seq long, control string"


def feed(spark, path, batches, schema):
    """One file for each batch, taken in their order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def by_loop(rows, span):
    """What each row leaves held: one list, taken through for every row."""
    held, shut, out = [], False, []
    for _, ts, content, seq, control in sorted(rows, key=lambda r: r[3]):
        if control in ("reset", "begin"):
            held, shut = [], shut or control == "begin"
        elif control == "end":
            shut = False
        elif shut:
            continue
        else:
            held = [(t, c) for t, c in [*held, (ts, content)] if t >= ts - span]
        out.append((seq, len(held)))
    return out


def test_buffer_over_batches_equals_loop(spark, tmp_path):
    draw = random.Random(3)
    rows = []
    for seq in range(240):
        control = draw.choices([None, "reset", "begin", "end"], [40, 1, 1, 3])[0]
        late = draw.choice([0, 0, 0, 45, 90])
        rows.append((draw.choice("ab"), 5 * seq - late, f"w{seq}", seq, control))
    got = run.settled(rolling.rolling(feed(spark, f"{tmp_path}/in", [rows[k : k + 60] for k in range(0, 240, 60)], ROWS), 60), "t").collect()
    for key in "ab":
        assert sorted((r["seq"], r["held"]) for r in got if r["key"] == key) == by_loop([r for r in rows if r[0] == key], 60)


def test_reset_that_arrives_after_its_successors(spark, tmp_path):
    """A segment that comes after a reset with a larger seq is dropped; one that came before with a larger seq stays."""
    batches = [[("k", 1, "a", 1, None), ("k", 2, "c", 5, None)], [("k", 0, None, 3, "reset")], [("k", 3, "b", 2, None), ("k", 4, "d", 6, None)]]
    got = run.settled(rolling.rolling(feed(spark, f"{tmp_path}/in", batches, ROWS), 60), "t").orderBy("seq").collect()
    assert [(r["seq"], r["held"], r["text"]) for r in got] == [(1, 1, None), (3, 1, "c"), (5, 2, "a c"), (6, 2, "c d")]


def test_shown_text_over_the_whole_table(spark, sf):
    ev = pd.read_parquet(f"{sf}/events.parquet").sort_values("event_id")
    ev["ms"] = ev["ts"].astype("datetime64[us]").astype("int64") // 1000 - (ev["event_id"] % 7 == 0) * queries_streams.LATE
    want = {}
    for user, part in ev.groupby("user_id"):
        held = []
        for ms, word in zip(part["ms"], part["event_type"]):
            held = [(t, w) for t, w in [*held, (ms, word)] if t >= ms - queries_streams.DAY]
        want[str(user)] = layout._without_repeats(layout._without_repeats(layout._without_repeats(" ".join(w for _, w in held))))
    assert {r["key"]: r["text"] for r in queries_streams.st3(spark, sf).collect()} == want


def test_timed_buffer_empties_without_a_new_row(spark, tmp_path):
    """Another key's row moves the clock; the timers of the first key drop what it holds."""
    batches = [[("a", 1_000, "x", 1, None), ("a", 2_000, "y", 2, None)], [("b", 61_500, "z", 3, None)], [("b", 200_000, "z", 4, None)]]
    rows = feed(spark, f"{tmp_path}/in", batches, ROWS).withColumn("clock", F.timestamp_millis("ts")).withWatermark("clock", "0 seconds")
    got = run.settled(rolling.timed(rows, 60_000, "clock"), "t").collect()
    assert sorted((r["what"], r["at"], r["held"]) for r in got if r["key"] == "a") == [("added", 1_000, 1), ("added", 2_000, 2), ("expired", 61_001, 1), ("expired", 62_001, 0)]
    # the clock is the watermark of the batch before, so the last row still meets the one before it, which goes afterwards
    assert sorted((r["what"], r["at"], r["held"]) for r in got if r["key"] == "b") == [("added", 61_500, 1), ("added", 200_000, 2), ("expired", 121_501, 1)]


def test_processing_time_buffer_empties(spark, tmp_path):
    rows = feed(spark, f"{tmp_path}/in", [[("a", 0, "x", 1, None)]], ROWS)
    with run.state_store(spark):
        q = rolling.timed(rows, 300).writeStream.format("memory").queryName("clocked").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("clocked").count() < 2:
            time.sleep(0.3)
    finally:
        q.stop()
    assert [(r["what"], r["held"]) for r in spark.table("clocked").orderBy("at").collect()] == [("added", 1), ("expired", 0)]


def test_replies_out_of_order(spark, tmp_path):
    schema = "key string, request long, reply string"
    batches = [[("k", 1, None), ("k", 2, None)], [("k", 1, "stale")], [("k", 2, "right")], [("k", 3, "next"), ("k", 2, "late"), ("j", 1, "own")]]
    got = run.settled(rolling.latest_replies(feed(spark, f"{tmp_path}/in", batches, schema)), "t").collect()
    assert sorted(tuple(r) for r in got) == [("j", 1, "own"), ("k", 2, "right"), ("k", 3, "next")]


def test_polling_killed_between_write_and_commit(spark, tmp_path):
    """The batch that was written but not committed is written again in its place; what comes later is added."""
    schema = "id long"
    stream = feed(spark, f"{tmp_path}/in", [[(k,)] for k in range(3)], schema)
    target, state = f"{tmp_path}/out", f"{tmp_path}/cp"

    def die(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run.poll(stream, run.BatchFolders(target, die), state).awaitTermination()
    sink = run.BatchFolders(target)
    assert sorted(r[0] for r in sink.table(spark, schema).collect()) == [0, 1]
    run.poll(stream, sink, state).awaitTermination()
    spark.createDataFrame([(3,)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    run.poll(stream, sink, state).awaitTermination()
    assert sorted(r[0] for r in sink.table(spark, schema).collect()) == [0, 1, 2, 3]


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(run._PROVIDER, None)
    with run.state_store(spark):
        assert spark.conf.get(run._PROVIDER) == run._ROCKS
    assert spark.conf.get(run._PROVIDER, None) == before


def longest(flags):
    return max([len(list(g)) for f, g in itertools.groupby(flags) if f], default=0)


def test_merged_states_equal_the_whole(spark):
    draw = random.Random(1)
    cases = [[draw.choice([True, True, False, None]) for _ in range(draw.randrange(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, c, draw.randrange(0, len(c) + 1)) for i, c in enumerate(cases)], "i int, f array<boolean>, cut int")
    left, right = F.expr("slice(f, 1, cut)"), F.expr("slice(f, cut + 1, 20)")
    got = df.select("i", votes.of_flags(F.col("f")).alias("a"), votes.merged(votes.of_flags(left), votes.of_flags(right)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
    assert {r["i"]: (r["a"]["n"], r["a"]["yes"], r["a"]["best"]) for r in got} == {i: (len(c), sum(map(bool, c)), longest([bool(x) for x in c])) for i, c in enumerate(cases)}


@pytest.mark.parametrize("size,step,bits", [(3, 1, 2), (4, 6, 0), (5, 2, 12), (1, 1, 1)])
def test_sliding_votes_equal_loop(spark, size, step, bits, monkeypatch):
    """Slices of any length, ties in time, null flags and times, steps larger than windows."""
    draw = random.Random(size)
    rows = [(i, None if i == 7 else float(draw.randrange(-9, 15)), draw.choice([True, True, False, None])) for i in range(80)]
    monkeypatch.setattr(votes.slices, "__defaults__", (bits,))
    got = votes.sliding_votes(spark.createDataFrame(rows, "i int, s double, f boolean"), F.col("s"), F.col("f"), ["i"], size, step).collect()
    want = {}
    for start in range(-60, 60, step):
        flags = [bool(f) for _, i, f in sorted((s // 1, i, f) for i, s, f in rows if s is not None and start <= s < start + size)]
        if flags:
            want[start] = (sum(flags) >= 1, sum(flags) >= 2, 2 * sum(flags) > len(flags), all(flags), longest(flags) >= 2, longest(flags) >= 3)
    if size == step == 1 or step == 1:
        assert {r["start"]: tuple(r)[1:] for r in got} == want
    else:  # a slice spans several seconds, within which rows go by i
        assert {r["start"] for r in got} == set(want)
        assert {r["start"]: tuple(r)[1:5] for r in got} == {k: v[:4] for k, v in want.items()}


def test_empty_votes(spark):
    none = spark.createDataFrame([], "i int, s double, f boolean")
    assert votes.sliding_votes(none, F.col("s"), F.col("f"), ["i"], 2, 1).count() == 0
    assert votes.swept(none, F.col("s"), F.col("f"), F.col("f"), ["i"], [1, 2]).count() == 0


class Handle:
    """State variables and timers in memory, counting what is asked of them."""

    def __init__(self):
        self.timers, self.registered, self.calls = set(), 0, 0

    def getValueState(self, name, schema):  # noqa: N802
        return Handle.Value(self)

    def getMapState(self, name, *schemas):  # noqa: N802
        return Handle.Map(self)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.registered += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    class Value:
        def __init__(self, handle):
            self.handle, self.value = handle, None

        def _asked(self):
            self.handle.calls += 1

        def exists(self):
            self._asked()
            return self.value is not None

        def get(self):
            self._asked()
            return self.value

        def update(self, value):
            self._asked()
            self.value = value

        def clear(self):
            self._asked()
            self.value = None

    class Map:
        def __init__(self, handle):
            self.handle, self.values = handle, {}

        def containsKey(self, key):  # noqa: N802
            self.handle.calls += 1
            return key in self.values

        def getValue(self, key):  # noqa: N802
            self.handle.calls += 1
            return self.values[key]

        def updateValue(self, key, value):  # noqa: N802
            self.handle.calls += 1
            self.values[key] = value

        def removeKey(self, key):  # noqa: N802
            self.handle.calls += 1
            del self.values[key]


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def timed_batch(buffer, handle, rows, now):
    """One batch of a key: its rows (seq, ts, content), then the timers that the clock has passed."""
    out = []
    if rows:
        frame = pd.DataFrame([(s, t, c) for s, t, c in rows], columns=["seq", "ts", "content"])
        out += [tuple(r)[1:] for f in buffer.handleInputRows(("k",), iter([frame]), Clock(now)) for r in f.itertuples(index=False)]
    for at in sorted(t for t in handle.timers if t <= now):
        handle.timers.discard(at)
        out += [("expired", None, r[3], r[4]) for f in buffer.handleExpiredTimer(("k",), Clock(now), Clock(at)) for r in f.itertuples(index=False)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_timed_buffer_equals_loop(seed, monkeypatch):
    """Chunks of any fill, late rows, equal stamps, batches without rows."""
    monkeypatch.setattr(rolling.TimedBuffer, "CHUNK", 5, raising=False)
    monkeypatch.setattr(rolling.TimedBuffer, "SMALL", 2, raising=False)
    draw, buffer, handle = random.Random(seed), rolling.TimedBuffer(50, True), Handle()
    buffer.init(handle)
    held, seq, now = [], 0, 0
    for _ in range(60):
        rows = [(seq + i, now + draw.randrange(-60, 40), draw.choice([None, "x"])) for i in range(draw.choice([0, 1, 2, 13]))]
        seq += len(rows)
        want = []
        for s, t, _ in rows:
            held.append(t + 51)
            want.append(("added", s, t, len(held)))
        for at in sorted({e for e in held if e <= now}):
            held = [e for e in held if e != at]
            want.append(("expired", None, at, len(held)))
        assert timed_batch(buffer, handle, rows, now) == want
        now += draw.choice([0, 5, 30])


def test_timed_buffer_asks_for_state_by_chunk():
    buffer, handle = rolling.TimedBuffer(10_000, True), Handle()
    buffer.init(handle)
    got = timed_batch(buffer, handle, [(i, 7 * i, "x") for i in range(2000)], 0) + timed_batch(buffer, handle, [], 10**6)
    assert len(got) == 4000 and got[-1] == ("expired", None, 7 * 1999 + 10_001, 0)
    assert handle.calls < 40 and handle.registered < 5 and not handle.timers
