"""A polled source over several batches, and medians of groups that no task holds."""

import datetime
import os
import random
import statistics
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortframe.operators.aggregates import mean_mad
from cohortframe.operators.ordering import group_medians
from cohortframe.streaming import in_order, jobs


def put(folder, name, *lines):
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def state(spark, out):
    return sorted(tuple(r) for r in jobs.polled_elements(spark, out).collect())


def test_polled_source_over_batches(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    folder, check, out = (f"{base}/{x}" for x in ("in", "check", "out"))
    os.mkdir(folder)
    known = spark.createDataFrame([("a.txt", "/p/0", False), ("z.txt", "/p/9", False)], "source string, path string, withdrawn boolean")
    poll = lambda: jobs.poll_source(spark, folder, check, out, known)
    put(folder, "a.txt", "# paths", "/p/1", "", "/p/2")
    poll()
    assert state(spark, out) == [("a.txt", "/p/0", True), ("a.txt", "/p/1", False), ("a.txt", "/p/2", False), ("z.txt", "/p/9", False)]
    put(folder, "b.txt", "/p/3", "/p/1")
    poll()
    first = state(spark, out)
    assert ("a.txt", "/p/1", False) in first and ("a.txt", "/p/2", False) in first and ("b.txt", "/p/3", False) in first
    put(folder, "a.txt@2", "/p/2", "/p/0")
    poll()
    assert [x for x in state(spark, out) if x[0] == "a.txt"] == [("a.txt", "/p/0", False), ("a.txt", "/p/1", True), ("a.txt", "/p/2", False)]
    what = {(r.source, r.path): r.what for r in jobs.polled_changes(spark, out).filter("batch = 2").collect()}
    assert what == {("a.txt", "/p/0"): "returned", ("a.txt", "/p/1"): "withdrawn", ("a.txt", "/p/2"): "kept"}
    # the same content again, in another order; an earlier version; a list without elements; nothing at all
    put(folder, "a.txt@3", "/p/0", "/p/2")
    put(folder, "b.txt@0", "/p/7")
    put(folder, "z.txt", "# none")
    before = state(spark, out)
    poll()
    assert state(spark, out) == sorted([x for x in before if x[0] != "z.txt"] + [("z.txt", "/p/9", True)])
    poll()
    after = state(spark, out)
    # a batch that comes again changes nothing
    jobs.take_lists(spark, spark.createDataFrame([("a.txt", 9, "/p/8")], "source string, version long, path string"), 1, out)
    assert state(spark, out) == after
    # one that was stopped before its marker is done anew
    os.remove(f"{out}/done/3")
    jobs.take_lists(spark, spark.createDataFrame([("b.txt", 5, "/p/3")], "source string, version long, path string"), 3, out)
    assert ("b.txt", "/p/1", True) in state(spark, out)


def test_medians_against_python(spark):
    rng = np.random.default_rng(1)
    rows = [("one", float(x)) for x in rng.normal(size=5001)] + [("even", float(x)) for x in rng.integers(0, 5, 400)] + [("tied", 7.0)] * 999 + [("single", 3.0), (None, 1.0), (None, 4.0), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r.median for r in group_medians(df, ["k"], "v").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    mads = {r.sample: r.mad for r in mean_mad(df.select(F.col("k").alias("sample"), F.col("v").alias("log2_ratio"))).collect()}
    for k, v in groups.items():
        m = statistics.median(v)
        assert abs(mads[k] - statistics.median([abs(x - m) for x in v])) < 1e-12
    assert mads["null"] is None


def test_no_whole_group_median_in_the_library():
    import inspect

    from cohortframe.operators import aggregates

    assert "F.median" not in inspect.getsource(aggregates)


def test_nearest_labelled_is_what_walks_find(spark):
    """Against a walk from each start: random graphs with cycles, several labels, starts that are labelled themselves."""
    import random

    from cohortframe.operators import graph

    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    nodes = spark.createDataFrame([(n, rng.choice(["Lane", "Section", "File", "File", "File"]), {}) for n in names], "id string, label string, props map<string,string>")
    edges = spark.createDataFrame([(rng.choice(names), rng.choice(names), "x") for _ in range(90)], "src string, dst string, type string")
    start = nodes.select("id")
    got = {(r.start, r.label): (r.depth, r.nearest) for r in graph.nearest_labelled(edges, nodes, start, ["Lane", "Section"], 8).collect()}
    want = {}
    for label in ("Lane", "Section"):
        for r in graph.related(edges, start, "in", 1, 8, nodes=nodes, label=label).collect():
            want[r.start, label] = min(want.get((r.start, label), (99, "")), (r.depth, r.node))
    assert got == want


def streamed(spark, plan, files, schema):
    base = tempfile.mkdtemp(prefix="spark-")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = plan(spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(f"{base}/in"))
    with in_order.rocksdb_state(spark):
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return sorted((r.subject, r.event_id) for r in spark.read.schema(stream.schema).parquet(f"{base}/out").collect() if r.subject != "end")


def test_streams_judge_events_in_order_of_time(spark):
    """Against plain loops: out of order, ties, nulls, a subject with most events, one event that comes too late, and state that is forgotten."""
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    at = lambda hours: start + datetime.timedelta(hours=hours)
    schema = "event_id long, subject string, message string, ts timestamp"
    events = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.choice(["x", "x", "y", None]), at(rng.randint(0, 300) / 2)) for i in range(150)]
    files = [[e for e in events if e[3] < at(60)], [e for e in events if e[3] >= at(60)]]
    files[0], moved = [e for e in files[0] if e[3] < at(50) or e[0] % 2], [e for e in files[0] if e[3] >= at(50) and not e[0] % 2]
    files[1] += moved
    odd = [(900, None, "x", at(1)), (901, "a", "x", None)]
    end = [(-1, "end", "end", at(900))]
    too_late = [(902, "a", "z", at(2)), (903, "end", "end", at(901))]
    given = [files[0] + odd, files[1], end, too_late]
    want_repeats, want_refreshes = [], []
    for s in "abc":
        last = refreshed = None
        for e in sorted((e for e in events if e[1] == s), key=lambda e: (e[3], e[0])):
            if last is None or last[2] is None or (e[2] is not None and e[2] != last[2]) or e[3] - last[3] >= datetime.timedelta(hours=9):
                want_repeats.append((s, e[0]))
            last = e
            if refreshed is None or e[3] - refreshed >= datetime.timedelta(hours=24):
                want_refreshes.append((s, e[0]))
                refreshed = e[3]
    got = streamed(spark, lambda df: jobs.suppress_repeats_stream(df, "120 hours", "9 hours"), given, schema)
    assert got == sorted(want_repeats)
    got = streamed(spark, lambda df: jobs.refreshes_stream(df, "24 hours", "120 hours"), given, schema)
    assert got == sorted(want_refreshes)
    df = spark.createDataFrame(events + odd, schema)
    assert sorted((r.subject, r.event_id) for r in jobs.refreshes_since_last(df).collect()) == sorted(want_refreshes)
    assert sorted((r.subject, r.event_id) for r in jobs.suppress_repeats(df.filter("subject is not null and ts is not null"), idle="9 hours").collect()) == sorted(want_repeats)
    assert jobs.refreshes_since_last(df.limit(0)).count() == 0
    assert spark.conf.get(in_order.PROVIDER, None) != in_order.ROCKSDB


def test_a_subject_is_forgotten():
    """The processor by itself: what it remembers goes when the interval is over."""

    class Held:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v
        update = put = lambda self, v: setattr(self, "v", v)
        clear = lambda self: setattr(self, "v", None)
        appendList = lambda self, v: setattr(self, "v", (self.v or []) + v)

    class Handle:
        timers = []
        getListState = getValueState = lambda self, *a: Held()
        registerTimer = lambda self, t: self.timers.append(t)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    p = in_order.InOrder(lambda last, at, message: True, True, 5_000)
    p.init(Handle())
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"at": [3_000, 1_000], "event_id": [1, 2], "message": ["x", None]})]), Now(0)))
    assert Handle.timers == [1]
    assert [list(d["event_id"]) for d in p.handleExpiredTimer(("k",), Now(1), None)] == [[2]] and p.waiting.v == [(3_000, 1, "x")] and p.last.v == (1_000, None)
    assert [list(d["event_id"]) for d in p.handleExpiredTimer(("k",), Now(4), None)] == [[1]] and p.waiting.v is None and p.last.v == (3_000, "x")
    assert Handle.timers[-1] == 8 and [len(d) for d in p.handleExpiredTimer(("k",), Now(8), None)] == [0] and p.last.v is None
