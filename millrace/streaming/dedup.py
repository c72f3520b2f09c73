"""The interval dedup rule over a stream.

The accepted times of an id are an entry of a state map, so a micro-batch reads and writes
the ids it holds and no others. Ids are dealt to ``BUCKETS`` groups by hash, as calls to
the state store are round trips: what a group needs, its timer too, is not paid per id. A
group's ids lie in pages of about ``PAGE``, and a micro-batch reads and writes a page once.
Only ids and times pass through the state operator: it marks which rows are accepted, and
the rows themselves meet their marks inside the micro-batch.

A copy less than one interval from a copy accepted earlier, before or after it in time,
is refused; so is one less than an interval after the copy accepted before it in its own
micro-batch. A delivered copy cannot be recalled: where copies arrive in order of time the
result is that of the batch operator; out of order, no two accepted copies are less than
an interval apart, and every refused copy is less than an interval from an accepted one.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import GROUP, interval_ms, with_cell

# what names a copy: one message may arrive several times under its number
MARK = ["org", "stream", "seq", "received_at"]

# groups that ids are dealt to; fixed for the life of a checkpoint
BUCKETS = 1024
# forgotten ids are removed from a group this often while ids are kept
SWEEPS = 8
# ids of a page, a value of the state store
PAGE = 128


class Pages:
    """The ids of a group with their times, asked like a map state by id. A page is read
    when first asked for and written by ``flush``. The number of pages is a power of two
    that follows the number of ids, so a page stays small however many ids there are, and
    what the dealing anew costs is shared by the ids that came."""

    def __init__(self, pages, size):
        self.pages, self.size = pages, size

    def open(self) -> None:
        """Turn to the group that the store is at."""
        self.read, self.stored, self.changed = {}, set(), set()
        self.n, self.ids = self.known = self.size.get() or (1, 0)

    def _page(self, number: int) -> dict:
        page = self.read.get(number)
        if page is None:
            found = self.pages.getValue((number,))
            if found:
                self.stored.add(number)
            page = self.read[number] = json.loads(found[0]) if found else {}
        return page

    def _number(self, id_: str) -> int:
        return crc32(id_.encode()) % self.n

    def getValue(self, key: tuple) -> tuple | None:
        return self._page(self._number(key[0])).get(key[0])

    def updateValue(self, key: tuple, value: tuple) -> None:
        number = self._number(key[0])
        page = self._page(number)
        self.ids += key[0] not in page
        page[key[0]] = value
        self.changed.add(number)

    def removeKey(self, key: tuple) -> None:
        number = self._number(key[0])
        self.ids -= self._page(number).pop(key[0], None) is not None
        self.changed.add(number)

    def iterator(self) -> Iterator[tuple]:
        for number in range(self.n):
            for id_, value in self._page(number).items():
                yield (id_,), value

    def _deal(self) -> None:
        entries = list(self.iterator())
        before, self.n = self.n, 1
        while self.ids > PAGE * self.n:
            self.n *= 2
        self.read = {number: {} for number in range(max(before, self.n))}
        self.changed = set(self.read)
        for (id_,), value in entries:
            self.read[self._number(id_)][id_] = value

    def flush(self) -> None:
        if self.ids > PAGE * self.n or 8 * self.ids < PAGE * self.n > PAGE:
            self._deal()
        for number in self.changed:
            page = self.read[number]
            if page:
                self.pages.updateValue((number,), (json.dumps(page),))   # one text costs Spark far less than lists
            elif number in self.stored:
                self.pages.removeKey((number,))
        if (self.n, self.ids) != tuple(self.known):
            self.size.update((self.n, self.ids))


class AcceptTimes(StatefulProcessor):
    """Marks the accepted copies of the ids of a group. An id's accepted times are kept
    while less than ``keep_ms`` older than the latest, and forgotten altogether when none
    was accepted for that long, by the clock of the micro-batches: a replay forgets later,
    and no copy is ever too late to be looked at. A group's timer removes what is
    forgotten, ``SWEEPS`` times in ``keep_ms`` at most."""

    def __init__(self, width_ms: int, keep_ms: int):
        self.width, self.keep = width_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        self.times = handle.getMapState("times", "id string", "at array<long>, until_ms long")
        self.sweep = handle.getValueState("sweep", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a group's rows of one micro-batch, which the trigger bounds
        by_id: dict[str, list[tuple]] = {}
        now = latest = None
        for row in rows:   # by position, as names are looked up one by one
            id_, org, stream, t, received_at, seq, now, *_ = row
            by_id.setdefault(id_, []).append((received_at, seq, t, org, stream))
        clock = timerValues.getCurrentWatermarkInMs()
        for id_, copies in by_id.items():
            accepted = self._accepted((id_,), copies, now, clock)
            yield from accepted
            if accepted:
                latest = now
        if latest is not None and self.sweep.get() is None:
            self._next_sweep(latest + self.keep)

    def _next_sweep(self, at_ms: int) -> None:
        self.store.registerTimer(at_ms)
        self.sweep.update((at_ms,))

    def _accepted(self, id_: tuple, rows: list[tuple], now: int, clock: int) -> list[Row]:
        held = self.times.getValue(id_)
        if held and held[1] <= clock:
            held = None   # forgotten, though not yet removed
        out: list[Row] = []
        known, fresh = sorted(held[0]) if held else [], []
        # an id's rows of one micro-batch, without their bodies
        for received_at, seq, t, org, stream in sorted(rows, key=lambda r: r[:2]):
            if fresh and t - fresh[-1] < self.width:
                continue
            i = bisect_left(known, t)
            if any(abs(t - x) < self.width for x in known[max(i - 1, 0):i + 1]):
                continue
            fresh.append(t)
            out.append(Row(org=org, stream=stream, seq=seq, received_at=received_at))
        if fresh:
            latest = max(known[-1:] + fresh)
            self.times.updateValue(id_, ([x for x in sorted(known + fresh) if x > latest - self.keep], now + self.keep))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock, first, gone = timerValues.getCurrentWatermarkInMs(), None, []
        for id_, (_, until) in self.times.iterator():
            if until <= clock:
                gone.append(tuple(id_))
            else:
                first = until if first is None else min(first, until)
        for id_ in gone:
            self.times.removeKey(id_)
        self.sweep.clear()
        if first is not None:
            self._next_sweep(max(first, clock + self.keep // SWEEPS))
        yield from ()

    def close(self) -> None:
        pass


class PagedAcceptTimes(AcceptTimes):
    """The same with a group's ids in pages, so that an id costs no call of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        self.times = Pages(handle.getMapState("pages", "page int", "times string"), handle.getValueState("size", "pages int, ids long"))
        self.sweep = handle.getValueState("sweep", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.times.open()
        yield from super().handleInputRows(key, rows, timerValues)
        self.times.flush()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.times.open()
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        self.times.flush()


def accepted_marks(rows: DataFrame, interval: str = "5 minutes", keep: str = "24 hours") -> DataFrame:
    """``MARK`` columns of the accepted rows of a stream. An id's accepted times are
    remembered for ``keep``, at least one interval; later copies are delivered."""
    width = interval_ms(interval)
    now = F.current_timestamp()   # one value for a micro-batch
    # one text that differs for different ids; parts that are null are left out of it
    light = (with_cell(rows).withColumn("id", F.to_json(F.struct(*GROUP)))
             .select("id", "org", "stream", "t", F.unix_micros("received_at").alias("received_at"), "seq",
                     F.unix_millis(now).alias("now_ms"), F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket"),
                     now.alias("now"))
             .withWatermark("now", "0 seconds").drop("now"))
    marks = light.groupBy("bucket").transformWithState(
        PagedAcceptTimes(width, max(interval_ms(keep), width)), "org string, stream string, seq long, received_at long", "Append", "EventTime")
    return marks.withColumn("received_at", F.timestamp_micros("received_at"))


def deliver(rows: DataFrame, marks: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch's accepted rows below ``path/accepted``, in place of what an
    earlier run of it has written."""
    chosen = rows.join(marks, MARK, "left_semi").dropDuplicates(MARK)
    chosen.write.mode("overwrite").partitionBy("org", "stream").parquet(f"{path}/accepted/batch={batch_id}")


def start_dedup(rows: DataFrame, path: str, checkpoint: str, trigger: dict, interval: str = "5 minutes",
                keep: str = "24 hours") -> StreamingQuery:
    """Deliver a stream's accepted rows below ``path``."""
    marks = accepted_marks(rows, interval, keep)
    both = rows.withColumn("_mark", F.lit(False)).unionByName(
        marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True)

    def take(df: DataFrame, batch_id: int) -> None:
        df = df.persist()   # the state operator must not run twice; its size is that of one micro-batch
        try:
            deliver(df.where("not _mark").drop("_mark"), df.where("_mark").select(*MARK), path, batch_id)
        finally:
            df.unpersist()

    return both.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()


_ROW = ("seq long, topic string, message_key string, message_id string, content_type string, "
        "body binary, received_at timestamp, org string, stream string")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """All accepted rows of all micro-batches."""
    return (spark.read.schema(_ROW + ", batch long").parquet(f"{path}/accepted").drop("batch"))
