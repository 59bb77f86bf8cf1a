"""Rolling buffers over streams: by arrival, with resets, and by the clock."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import layout

#: What a control row does: forget what came before it; the same, and drop what follows until the end row.
RESET, BEGIN, END = "reset", "begin", "end"
HELD = "key string, seq long, ts long, held long, text string"


def millis(ts: str) -> Column:
    """A time stamp without zone as milliseconds since 1970."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def micros(ts: str) -> Column:
    """A time stamp without zone as microseconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


class RollingBuffer(StatefulProcessor):
    """Adds each segment and then drops those older than its time less the span (the bound itself stays).

    The arriving segment sets the bound, not the newest one: a late segment is
    kept and drops nothing more. Within a batch rows are taken by seq.

    Segments that don't come late wait in order of time, each under a place of its
    own, so adding is one write and dropping is taking from the head: a segment is
    written once and removed once, and one that comes and goes within a batch is
    never written. Late ones, told by an earlier time than the newest, lie apart,
    and are looked through only when a bound passes the oldest of them.

    Control rows have an order with segments by seq, whichever batch brings them: a
    reset forgets segments before it and drops those that are to come yet with a
    smaller seq; after begin, segments are dropped until end.

    One row per segment and control row tells how many are held; the last one of a
    batch has their joined text too, as the buffer is shown once a batch.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "head long, tail long, newest long, late long, oldest long, reset long, closed long")
        self.queue = handle.getMapState("queue", "place long", "seq long, ts long, content string")
        self.late = handle.getMapState("late", "seq long", "ts long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        known = self.meta.get() if self.meta.exists() else None
        head, tail, newest, late, oldest, reset, closed = known or (0, 0, -(1 << 62), 0, 1 << 62, -(1 << 62), -1)
        waiting: deque = deque()
        first = None  # the segment at the head, once it has been looked at
        out = []

        def taken(place: int) -> tuple:
            got = self.queue.getValue((place,))
            return int(got[0]), int(got[1]), got[2]

        def settle() -> None:
            nonlocal tail
            for seg in waiting:
                self.queue.updateValue((tail,), seg)
                tail += 1
            waiting.clear()

        for seq, ts, content, control in zip(new["seq"].tolist(), new["ts"].tolist(), new["content"], new["control"]):
            if control in (RESET, BEGIN):
                if seq > reset:
                    reset, first = seq, None
                    settle()
                    stay = [s for s in (taken(p) for p in range(head, tail)) if s[0] > seq]
                    for p in range(head, tail):
                        self.queue.removeKey((p,))
                    waiting.extend(stay)
                    head = tail
                    stay_late = {int(k[0]): v for k, v in self.late.iterator() if int(k[0]) > seq} if late else {}
                    if late:
                        self.late.clear()
                        for k, v in stay_late.items():
                            self.late.updateValue((k,), v)
                    late, oldest = len(stay_late), min((int(v[0]) for v in stay_late.values()), default=1 << 62)
                    newest = max((s[1] for s in waiting), default=-(1 << 62))
                if control == BEGIN:
                    closed = max(closed, seq)
            elif control == END:
                if seq > closed:
                    reset, closed = max(reset, seq), -1
            elif seq < reset or 0 <= closed < seq:
                continue
            else:
                if ts >= newest:
                    waiting.append((seq, ts, content))
                    newest = ts
                else:
                    self.late.updateValue((seq,), (ts, content))
                    late, oldest = late + 1, min(oldest, ts)
                bound = ts - self.span
                while head < tail:
                    first = first or taken(head)
                    if first[1] >= bound:
                        break
                    self.queue.removeKey((head,))
                    head, first = head + 1, None
                if head == tail:
                    while waiting and waiting[0][1] < bound:
                        waiting.popleft()
                if oldest < bound:
                    old = [(int(k[0]), int(v[0])) for k, v in self.late.iterator()]
                    for k, t in old:
                        if t < bound:
                            self.late.removeKey((k,))
                    left = [t for _, t in old if t >= bound]
                    late, oldest = len(left), min(left, default=1 << 62)
            out.append((key[0], seq, ts, tail - head + len(waiting) + late, None))
        settle()
        self.meta.update((head, tail, newest, late, oldest, reset, closed))
        if out:
            held = [taken(p) for p in range(head, tail)]
            held += [(int(k[0]), int(v[0]), v[1]) for k, v in self.late.iterator()] if late else []
            out[-1] = (*out[-1][:4], " ".join(c for _, _, c in sorted(held) if c))
        yield pd.DataFrame(out, columns=["key", "seq", "ts", "held", "text"])

    def close(self) -> None:
        pass


def segments(stream: DataFrame, key: str, ts: Column, content: str, seq: str, control: Column | None = None) -> DataFrame:
    """A stream's rows as a buffer takes them; control names what a row does where it isn't a segment. Rows without ts or seq are left out."""
    kind = F.lit(None).cast("string") if control is None else control.cast("string")
    return stream.select(F.col(key).cast("string").alias("key"), ts.cast("long").alias("ts"), F.col(content).cast("string").alias("content"), F.col(seq).cast("long").alias("seq"), kind.alias("control")).dropna(subset=["ts", "seq"])


def rolling(rows: DataFrame, span: int, *controls: DataFrame) -> DataFrame:
    """key, seq, ts, held, text: the rolling buffer of each key of segments(), and of streams of control rows beside it."""
    for c in controls:
        rows = rows.unionByName(c)
    return rows.groupBy("key").transformWithStateInPandas(RollingBuffer(span), HELD, "Append", "None")


def shown(buffers: DataFrame) -> DataFrame:
    """The buffers' texts as they are shown: repeated word sequences dropped."""
    return buffers.filter("text IS NOT NULL").withColumn("text", layout.without_repeats("text"))


class TimedBuffer(StatefulProcessor):
    """A buffer that empties by itself: a timer drops each segment when the clock passes its stamp by more than the span.

    The clock is that of the stream's time mode. By processing time a segment's
    stamp is the time of its batch; by event time it is the row's own time and the
    clock is the watermark.

    Segments lie in chunks, in order of their expiry. A key has one timer, at its
    earliest expiry; when it fires, all that the clock has passed goes at once and
    the timer moves on. So state is asked for once for each chunk that a batch
    touches and not for each segment. A batch's segments join the last chunk while
    that is small, so no batch rewrites much more than it brings or drops.
    """

    #: Segments of a chunk, and those up to which it takes more.
    CHUNK, SMALL = 1024, 128

    def __init__(self, span: int, event_time: bool):
        self.span, self.event_time = span, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "held long, timer long, chunks array<long>, least array<long>, last long")
        self.due = handle.getMapState("due", "chunk long", "expiry array<long>, text array<string>")

    def _known(self) -> tuple[int, int, list[int], list[int], int]:
        """Segments held, the timer (-1: none), the chunks by number with the least expiry of each, and how many the last chunk has."""
        held, timer, chunks, least, last = self.meta.get() or (0, -1, [], [], 0)
        return int(held), int(timer), [int(c) for c in chunks], [int(x) for x in least], int(last)

    def _chunk(self, number: int) -> list[tuple[int, str | None]]:
        expiry, text = self.due.getValue((number,))
        return list(zip([int(x) for x in expiry], text))

    def _settle(self, held: int, timer: int, chunks: list[int], least: list[int], last: int) -> None:
        """Keeps what is known and sets the timer to the earliest expiry."""
        if not held:
            self.meta.clear()
            return
        if min(least) != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = min(least)
            self.handle.registerTimer(timer)
        self.meta.update((held, timer, chunks, least, last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held, timer, chunks, least, last = self._known()
        stamps = new["ts"].tolist() if self.event_time else [timerValues.getCurrentProcessingTimeInMs()] * len(new)
        added = sorted(zip([s + self.span + 1 for s in stamps], new["content"]), key=lambda a: a[0])
        number = chunks[-1] + 1 if chunks else 0
        if chunks and last <= self.SMALL:
            number = chunks.pop()
            least.pop()
            added = sorted(self._chunk(number) + added, key=lambda a: a[0])
        for at in range(0, len(added), self.CHUNK):
            part = added[at : at + self.CHUNK]
            self.due.updateValue((number,), ([e for e, _ in part], [t for _, t in part]))
            chunks.append(number)
            least.append(part[0][0])
            number, last = number + 1, len(part)
        self._settle(held + len(new), timer, chunks, least, last)
        yield pd.DataFrame({"key": key[0], "what": "added", "seq": new["seq"].tolist(), "at": stamps, "held": range(held + 1, held + len(new) + 1)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        held, timer, chunks, least, last = self._known()
        gone: dict[int, int] = {}
        stay: list[tuple[int, int]] = []
        for number, first in zip(chunks, least):
            if first > now:
                stay.append((number, first))
                continue
            rows = self._chunk(number)
            for expiry, _ in rows:
                if expiry <= now:
                    gone[expiry] = gone.get(expiry, 0) + 1
            rest = [r for r in rows if r[0] > now]
            if rest:
                self.due.updateValue((number,), ([e for e, _ in rest], [t for _, t in rest]))
                stay.append((number, rest[0][0]))
                last = len(rest) if number == chunks[-1] else last
            else:
                self.due.removeKey((number,))
        out = []
        for expiry in sorted(gone):
            held -= gone[expiry]
            out.append((key[0], "expired", None, expiry, held))
        if stay and stay[-1][0] != chunks[-1]:
            last = self.CHUNK  # another chunk is the last one now; its size isn't known, so it takes no more
        # the timer that fired is gone
        self._settle(held, -1 if timer <= now else timer, [c for c, _ in stay], [x for _, x in stay], last)
        frame = pd.DataFrame(out, columns=["key", "what", "seq", "at", "held"])
        yield frame.astype({"seq": "Int64"})

    def close(self) -> None:
        pass


TIMED = "key string, what string, seq long, at long, held long"


def timed(rows: DataFrame, span: int, event_time: str | None = None) -> DataFrame:
    """key, what (added or expired), seq, at, held: buffers that empty by the clock.

    event_time names a column with a watermark, whose clock is the watermark;
    without it the clock is the time of processing.
    """
    mode = "EventTime" if event_time else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(TimedBuffer(span, bool(event_time)), TIMED, "Append", mode)


class LatestReply(StatefulProcessor):
    """Lets a reply through only if no newer request of its key has been seen, in whatever batch either comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "request long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        before = int(self.newest.get()[0]) if self.newest.exists() else None
        newest = max([*new["request"].tolist(), *([] if before is None else [before])])
        if newest != before:
            self.newest.update((newest,))
        said = new[(new["request"] == newest) & new["reply"].notna()]
        yield pd.DataFrame({"key": key[0], "request": said["request"], "reply": said["reply"]})

    def close(self) -> None:
        pass


def latest_replies(rows: DataFrame) -> DataFrame:
    """key, request, reply that aren't stale, from rows (key, request, reply); a row without reply only makes its request."""
    return rows.groupBy("key").transformWithStateInPandas(LatestReply(), "key string, request long, reply string", "Append", "None")


def latest_reply(df: DataFrame, key: str, request: str, reply: str) -> DataFrame:
    """The reply to the newest request of each key of a table; older replies are stale."""
    return df.groupBy(key).agg(F.max(request).alias(request), F.max_by(reply, request).alias(reply))


def of_kind(stream: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    return stream.filter(F.col(column) == kind)
