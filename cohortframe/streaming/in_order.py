"""Streams whose events are judged one by one in the order of their time, subject by subject (STR-2, STR-5).

Events wait in state until the watermark has passed them, so a
batch may bring them in any order and up to `late` behind the newest one; later
ones are dropped, as with any watermark. A timer wakes a key for its
earliest waiting event, and once more when what it remembers can't matter any
longer, when that is forgotten. State lies in RocksDB: start such a stream
within `rocksdb_state`, or in a session that has it as its state store.

A call to state costs far more than an event. So subjects are dealt into
buckets, a key each (`InOrderByBucket`), and a bucket's events wait in parts by
time, of which a timer reads those that are due; a batch costs calls by the
buckets that it meets and work by its events and by the subjects of those
buckets. `InOrder` has a key for each subject."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
WAITING = "at long, event_id long, message string"
#: at is the time, in microseconds, of what is remembered.
REMEMBERED = "at long, message string"
#: Keys that subjects are dealt into, a number that a checkpoint keeps. The calls of a bucket take as long as some 10,000 subjects.
BUCKETS = 256
#: Into how many parts of time `late` is divided.
PARTS = 8
#: So many batches' events of a bucket and part of time lie side by side; they are then laid together.
BESIDE = 16


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, of which a batch writes what it changed, in partitions by the cores at hand, since
    each costs some tenths of a second a batch; the session's own settings come back afterwards."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, 4))
    settings = {PROVIDER: ROCKSDB, CHANGELOG: "true", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def microseconds(interval: str) -> int:
    """An interval of fixed length, such as "24 hours", in microseconds."""
    return int(pd.Timedelta(interval) / pd.Timedelta(1, "us"))


class InOrder(StatefulProcessor):
    """Emits those events that `passes(last, at, message)` says, in order of (time, event_id), last being (time, message) of what
    `remembers` held of earlier events (all of them, or those emitted), or None; `forget_us` after that it is forgotten."""

    def __init__(self, passes: Callable[[tuple | None, int, str], bool], remembers_all: bool, forget_us: int | None):
        self.passes, self.remembers_all, self.forget_us = passes, remembers_all, forget_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", REMEMBERED)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # timers count in milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            come = list(zip(batch["at"].tolist(), batch["event_id"].tolist(), [None if pd.isna(m) else m for m in batch["message"]], strict=True))
            if come:
                self.waiting.appendList(come)
                first = min(come)[0] if first is None else min(first, min(come)[0])
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((x for x in events if x[0] <= passed), key=lambda x: x[:2])
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, event_id, message in due:
            emitted = self.passes(last, at, message)
            if emitted:
                out.append((event_id, key[0], message))
            if emitted or self.remembers_all:
                last = (at, message)
        if due:
            left = [x for x in events if x[0] > passed]
            self.waiting.put(left) if left else self.waiting.clear()
            if left:
                self._wake(min(left)[0])
        if last is not None and self.forget_us is not None and last[0] + self.forget_us <= passed:
            self.last.clear()
        elif due:
            self.last.update(last)
            if self.forget_us is not None:
                self._wake(last[0] + self.forget_us)
        yield pd.DataFrame(out, columns=["event_id", "subject", "message"])

    def close(self) -> None:
        pass


class InOrderByBucket(InOrder):
    """As InOrder, for the subjects of a bucket; `part_us` is how long a part of time is."""

    def __init__(self, passes: Callable[[tuple | None, int, str], bool], remembers_all: bool, forget_us: int | None, part_us: int):
        super().__init__(passes, remembers_all, forget_us)
        self.part_us = part_us

    def init(self, handle) -> None:
        self.handle = handle
        # pickled: (subject, at, event_id, message) of events; subject to (at, message)
        self.waiting = handle.getMapState("waiting", "part long, n long", "data binary")
        self.last = handle.getValueState("last", "data binary")
        self.judged = set()  # in this batch: several timers of a bucket may have expired

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts: dict[int, list[tuple]] = {}
        for batch in rows:
            for e in zip(batch["subject"].tolist(), batch["at"].tolist(), batch["event_id"].tolist(), batch["message"].tolist(), strict=True):
                parts.setdefault(e[1] // self.part_us, []).append(e if isinstance(e[3], str) else (*e[:3], None))
        if parts:
            held: dict[int, list[int]] = {}
            for part, n in self.waiting.keys():
                held.setdefault(part, []).append(n)
            for part, events in parts.items():
                ns = held.get(part, [])
                if len(ns) >= BESIDE:
                    events = [e for n in sorted(ns) for e in pickle.loads(self.waiting.getValue((part, n))[0])] + events
                    for n in ns:
                        self.waiting.removeKey((part, n))
                self.waiting.updateValue((part, max(ns, default=0) + 1), (pickle.dumps(events),))
            self._wake(min(e[1] for e in parts[min(parts)]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.judged:
            return
        self.judged.add(key)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, then = [], []
        for part, n in sorted(tuple(k) for k in self.waiting.keys()):
            if part * self.part_us > passed:
                then.append(part * self.part_us)
                continue
            events = pickle.loads(self.waiting.getValue((part, n))[0])
            left = [e for e in events if e[1] > passed]
            then += [e[1] for e in left]
            if not left:
                self.waiting.removeKey((part, n))
            elif len(left) < len(events):
                self.waiting.updateValue((part, n), (pickle.dumps(left),))
            due += [e for e in events if e[1] <= passed] if left else events
        if then:
            self._wake(min(then))
        known = pickle.loads(self.last.get()[0]) if self.last.exists() else {}
        due.sort(key=itemgetter(1, 2))
        out = {"event_id": [], "subject": [], "message": []}
        for subject, at, event_id, message in due:
            emitted = self.passes(known.get(subject), at, message)
            if emitted:
                out["event_id"].append(event_id)
                out["subject"].append(subject)
                out["message"].append(message)
            if emitted or self.remembers_all:
                known[subject] = (at, message)
        if self.forget_us is not None:
            known = {s: x for s, x in known.items() if x[0] + self.forget_us > passed}
            if known:
                self._wake(max(x[0] for x in known.values()) + self.forget_us)
        if known:
            self.last.update((pickle.dumps(known),))
        elif self.last.exists():
            self.last.clear()
        if out["event_id"]:
            yield pd.DataFrame(out)


def judged_in_order(events: DataFrame, late: str, passes: Callable[[tuple | None, int, str], bool], remembers_all: bool, forget_us: int | None, buckets: int | None = BUCKETS) -> DataFrame:
    """The events (event_id, subject, message) of a stream with also ts, that InOrder emits; those without a time or subject are left out.
    Without buckets each subject has a key of its own."""
    timed = events.filter("ts is not null and subject is not null").select("event_id", "subject", "message", F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    schema = f"event_id long, subject {timed.schema['subject'].dataType.simpleString()}, message string"
    if buckets is None:
        return timed.groupBy("subject").transformWithStateInPandas(InOrder(passes, remembers_all, forget_us), schema, "Append", "EventTime")
    processor = InOrderByBucket(passes, remembers_all, forget_us, max(microseconds(late) // PARTS, 1_000_000))
    return timed.withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")
