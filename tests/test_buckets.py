"""Streams judged in order of time, many subjects to a key: against the key for each subject, and the processor by itself."""

import datetime
import random

import pandas as pd
import pytest

from cohortframe.streaming import in_order, jobs
from tests.test_state import streamed

MINUTE = 60_000_000
SCHEMA = "event_id long, subject long, message string, ts timestamp"


class Value:
    """A value's state, as a dictionary of one entry."""

    def __init__(self):
        self.v, self.calls = {}, 0

    def _call(self, f, *a):
        self.calls += 1
        return f(*a)

    exists = lambda self: self._call(lambda: bool(self.v))
    get = lambda self: self._call(self.v.get, 0)
    update = lambda self, v: self._call(self.v.__setitem__, 0, v)
    clear = lambda self: self._call(self.v.clear)
    keys = lambda self: self._call(lambda: iter(list(self.v)))
    getValue = lambda self, k: self._call(self.v.get, k)
    updateValue = lambda self, k, v: self._call(self.v.__setitem__, k, v)
    removeKey = lambda self, k: self._call(self.v.pop, k)


class Handle:
    def __init__(self):
        self.map, self.value, self.timers = Value(), Value(), []

    getMapState = lambda self, *a: self.map
    getValueState = lambda self, *a: self.value
    registerTimer = lambda self, t: self.timers.append(t)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def run(p, handle, batches, late_ms):
    """Batches of (subject, at, event_id, message) for one bucket: what is emitted, batch by batch; a watermark `late_ms` behind the newest event so far."""
    out, newest = [], 0
    for events in [*batches, []]:
        p.init(handle)
        wm = newest - late_ms if events else newest + late_ms
        if events:
            list(p.handleInputRows((0,), iter([pd.DataFrame(events, columns=["subject", "at", "event_id", "message"])]), Now(wm)))
            newest = max(newest, *(e[1] // 1000 for e in events))
        expired, handle.timers = [t for t in handle.timers if t <= wm], [t for t in handle.timers if t > wm]
        out.append([tuple(r) for _ in expired for d in p.handleExpiredTimer((0,), Now(wm), None) for r in d[["subject", "event_id"]].itertuples(index=False)])
    return out


def loops(events, gap):
    want, last = [], {}
    for s, at, i, m in sorted(events, key=lambda e: (e[1], e[2])):
        p = last.get(s)
        if p is None or p[1] is None or (m is not None and m != p[1]) or at - p[0] >= gap:
            want.append((s, i))
        last[s] = (at, m)
    return want


def test_many_small_batches_of_a_bucket():
    """Parts are laid together, events of later parts stay unread, the whole is that of a plain loop, and in the end nothing is held."""
    rng = random.Random(4)
    late, gap = 90 * MINUTE, 20 * MINUTE
    events = [(rng.randrange(30), 100 * MINUTE + rng.randrange(600 * MINUTE), i, rng.choice(["x", "y", None])) for i in range(3_000)]
    events.sort(key=lambda e: e[1] + rng.randrange(60 * MINUTE))
    batches = [events[i : i + 10] for i in range(0, len(events), 10)]
    p, handle = in_order.InOrderByBucket(lambda last, at, m: last is None or last[1] is None or (m is not None and m != last[1]) or at - last[0] >= gap, True, gap, late // in_order.PARTS), Handle()
    most, update = [0], handle.map.updateValue
    handle.map.updateValue = lambda k, v: (update(k, v), most.append(max(most[-1], len(handle.map.v))))
    got = run(p, handle, batches, late // 1000)
    assert sorted(x for b in got for x in b) == sorted(loops(events, gap))
    assert sum(map(bool, got)) > len(got) // 3  # not all at the end
    assert most[-1] <= (in_order.BESIDE + 1) * (in_order.PARTS * 160 // 90 + 2) < len(batches)
    assert not handle.map.v and (not handle.value.v or handle.timers)
    p.init(handle)
    list(p.handleExpiredTimer((0,), Now(10**9), None))
    assert not handle.value.v


def test_calls_grow_with_buckets_not_with_subjects():
    calls = {}
    for n in (10, 1_000):
        p, handle = in_order.InOrderByBucket(lambda last, at, m: last is None or m != last[1], True, None, 30 * MINUTE), Handle()
        events = [(s, 100 * MINUTE + s % 7 * MINUTE, s, "x") for s in range(n)]
        assert len(run(p, handle, [events], 1000)[-1]) == n
        calls[n] = handle.map.calls + handle.value.calls
    assert calls[10] == calls[1_000]


@pytest.mark.parametrize("kind", ["repeats", "idle", "refreshes"])
def test_buckets_equal_single_subjects_and_the_batch_form(spark, kind):
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, rng.randrange(40), rng.choice(["x", "y", None]), start + datetime.timedelta(minutes=rng.randrange(6_000), microseconds=rng.randrange(3))) for i in range(800)]
    events.sort(key=lambda e: e[3] + datetime.timedelta(minutes=rng.randrange(1_200)))
    end = [(9_999, 999, "end", start + datetime.timedelta(days=30))]
    files = [events[:300], events[300:600], events[600:], end]
    plan = {
        "repeats": lambda df, b: jobs.suppress_repeats_stream(df, "24 hours", buckets=b), "idle": lambda df, b: jobs.suppress_repeats_stream(df, "24 hours", "3 hours", buckets=b),
        "refreshes": lambda df, b: jobs.refreshes_stream(df, "12 hours", "24 hours", buckets=b),
    }[kind]
    df = spark.createDataFrame(events, SCHEMA)
    batch = jobs.refreshes_since_last(df, "12 hours") if kind == "refreshes" else jobs.suppress_repeats(df, idle="3 hours" if kind == "idle" else None)
    want = sorted((r.subject, r.event_id) for r in batch.collect())
    for buckets in (None, 3):
        assert [x for x in streamed(spark, lambda df: plan(df, buckets), files, SCHEMA) if x[0] != 999] == want


def test_settings_of_state_come_back(spark):
    keys = (in_order.PROVIDER, in_order.CHANGELOG, "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k, None) for k in keys]
    with in_order.rocksdb_state(spark):
        assert spark.conf.get(in_order.PROVIDER) == in_order.ROCKSDB
    assert [spark.conf.get(k, None) for k in keys] == before


def test_refreshes_of_a_bucket_against_loops():
    """Only what refreshed is remembered, until the interval after it is over; calls don't grow with the subjects."""
    rng = random.Random(6)
    late, gap = 60 * MINUTE, 45 * MINUTE
    calls = {}
    for n in (5, 500):
        events = [(rng.randrange(n), 100 * MINUTE + rng.randrange(300 * MINUTE), i, "x") for i in range(n * 20)]
        events.sort(key=lambda e: e[1] + rng.randrange(40 * MINUTE))
        want, last = [], {}
        for s, at, i, _ in sorted(events, key=lambda e: (e[1], e[2])):
            if s not in last or at - last[s] >= gap:
                want.append((s, i))
                last[s] = at
        p, handle = in_order.InOrderByBucket(lambda last, at, m: last is None or at - last[0] >= gap, False, gap, late // in_order.PARTS), Handle()
        got = run(p, handle, [events[i : i + n] for i in range(0, len(events), n)], late // 1000)
        assert sorted(x for b in got for x in b) == sorted(want)
        assert len(handle.value.v) == 0 or handle.timers
        calls[n] = handle.map.calls + handle.value.calls
    assert calls[500] < 4 * calls[5]  # of a hundred times the subjects and events


def test_a_bucket_remembers_without_idle():
    """What a subject said last counts however long ago; a message of null after it isn't another, and is remembered."""
    p, handle = in_order.InOrderByBucket(lambda last, at, m: last is None or last[1] is None or (m is not None and m != last[1]), True, None, 5 * MINUTE), Handle()
    day = 1440 * MINUTE
    batches = [[("a", MINUTE, 1, "x"), ("b", MINUTE, 2, "x")], [("a", 9 * day, 4, "y"), ("a", 8 * day, 3, "x"), ("b", 8 * day, 5, None)], [("b", 20 * day, 6, "x"), ("a", 20 * day, 7, "y")]]
    assert sorted(x for b in run(p, handle, batches, 60_000) for x in b) == [("a", 1), ("a", 4), ("b", 2), ("b", 6)]
    assert handle.value.v and not handle.map.v
