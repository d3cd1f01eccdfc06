"""Structured Streaming forms of the polled sources and logs (STR-1 to STR-5), each with its batch form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import last_known
from ..operators.sets import reconcile_elements
from ..sources.paths import stored
from .in_order import BUCKETS, judged_in_order, microseconds

#: How a list's file name says which source it belongs to, and which version of its list it is: `name` or `name@version`.
NAMED = r"([^/@]+)(?:@(\d+))?$"
SNAPSHOT = {"lists": "source string, version long, address string", "elements": "source string, path string, withdrawn boolean", "changes": "source string, path string, what string, withdrawn boolean"}


def stream_source(spark: SparkSession, folder: str, checkpoint: str, on_batch, named: str = NAMED, most_files: int | None = None) -> object:
    """STR-1: polls a folder of lists (a path a line) and hands each batch's lines (source, version, path; null for a comment or an
    empty line, by which a list without elements is seen) to on_batch(lines, batch_id)."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    lines = (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).text(folder)
    file = F.col("_metadata.file_path")
    version = F.coalesce(F.nullif(F.regexp_extract(file, named, 2), F.lit("")).cast("long"), F.lit(0).cast("long")) if "(" in named.partition(")")[2] else F.lit(0).cast("long")
    path = F.when((F.col("value") != "") & ~F.col("value").startswith("#"), F.col("value"))
    rows = lines.select(F.regexp_extract(file, named, 1).alias("source"), version.alias("version"), path.alias("path"))
    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source_changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """STR-1: what changed between two sights of a source."""
    return reconcile_elements(previous, current).filter("what not in ('kept', 'still withdrawn')")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _last_batch(spark: SparkSession, target: str) -> int | None:
    """The last batch whose snapshot is whole: that of the greatest marker."""
    fs, p = _hadoop(spark, f"{target}/done")
    return max((int(x.getPath().getName()) for x in fs.listStatus(p)), default=None) if fs.exists(p) else None


def _snapshot(spark: SparkSession, target: str, what: str) -> DataFrame:
    last = _last_batch(spark, target)
    return spark.createDataFrame([], SNAPSHOT[what]) if last is None else spark.read.schema(SNAPSHOT[what]).parquet(f"{target}/{what}/batch={last}")


def polled_elements(spark: SparkSession, target: str) -> DataFrame:
    """STR-1: the elements of all lists polled so far: source, path, withdrawn."""
    return _snapshot(spark, target, "elements")


def polled_changes(spark: SparkSession, target: str) -> DataFrame:
    """STR-1: what each batch did to the elements of the lists that it brought: batch, source, path, what, withdrawn."""
    return spark.read.schema(SNAPSHOT["changes"] + ", batch int").parquet(f"{target}/changes")


def take_lists(spark: SparkSession, lines: DataFrame, batch_id: int, target: str, known: DataFrame | None = None) -> None:
    """STR-1: brings the versioned element table at target up to date with a batch of lists (source, version, path).

    Elements belong to their source's list. A list with the content that its source last had, or of a version that isn't later, changes nothing; a
    later one withdraws what it no longer names and returns what it names again; lists that no file of the batch
    belongs to are left alone. A snapshot of lists and elements is written for the batch, and becomes the current one by its marker, written
    last; a batch that comes again after its marker changes nothing. known has elements from before the first batch."""
    last = _last_batch(spark, target)
    if last is not None and last >= batch_id:
        return
    lists = _snapshot(spark, target, "lists")
    elements = known.select("source", "path", "withdrawn") if last is None and known is not None else _snapshot(spark, target, "elements")
    latest = lines.groupBy("source").agg(F.max("version").alias("version"))
    arrived = stored(lines.join(latest, ["source", "version"]).distinct(), "arrived")
    # the address doesn't depend on the lines' order, and no list is gathered for it
    parts = [F.sum(F.xxhash64("path", F.lit(i)).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    now = arrived.groupBy("source", "version").agg(F.concat_ws(".", F.count("path").cast("string"), *parts).alias("address"))
    before = lists.toDF("source", "_version", "_address")
    new = stored(now.join(before, "source", "left").filter("_version is null or version > _version"), "new-lists")
    other = new.filter("_address is null or address <> _address").select("source")
    current = arrived.filter("path is not null").join(other, "source", "left_semi").select("source", "path", F.lit(True).alias("_now"))
    mine = elements.join(other, "source", "left_semi").withColumnRenamed("withdrawn", "_was")
    what = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), F.when(F.col("_was"), "still withdrawn").otherwise("withdrawn")).when(F.col("_was"), "returned").otherwise("kept")
    met = stored(mine.join(current, ["source", "path"], "full_outer").select("source", "path", what.alias("what"), F.col("_now").isNull().alias("withdrawn")), "reconciled")
    kept_lists = lists.join(new, "source", "left_anti").unionByName(new.select("source", "version", "address"))
    kept_elements = elements.join(other, "source", "left_anti").unionByName(met.select("source", "path", "withdrawn"))
    for name, df in (("lists", kept_lists), ("elements", kept_elements), ("changes", met)):
        df.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")
    fs, marker = _hadoop(spark, f"{target}/done/{batch_id}")
    fs.create(marker, True).close()
    for name in ("lists", "elements"):  # the one before stays for readers that have begun
        for x in fs.listStatus(marker.getParent().getParent().suffix(f"/{name}")):
            if int(x.getPath().getName().partition("=")[2]) < (last if last is not None else batch_id):
                fs.delete(x.getPath(), True)


def poll_source(spark: SparkSession, folder: str, checkpoint: str, target: str, known: DataFrame | None = None, named: str = NAMED, most_files: int | None = None) -> None:
    """STR-1: takes all lists that are new in a folder into the element table at target, and ends; a later call goes on where this one ended."""
    stream_source(spark, folder, checkpoint, lambda lines, i: take_lists(spark, lines, i, target, known), named, most_files).awaitTermination()


def suppress_repeats(events: DataFrame, subject: str = "subject", message: str = "message", order: tuple[str, ...] = ("ts", "event_id"), idle: str | None = None) -> DataFrame:
    """STR-2, batch: messages that differ from their subject's previous one (A, B, A emits three), or with `idle` come at least
    that long after it (order's first column being the time)."""
    w = Window.partitionBy(subject).orderBy(*order)
    passes = F.col("_p").isNull() | (F.col("_p") != F.col(message))
    if idle:
        passes = passes | (F.unix_micros(F.col(order[0]).cast("timestamp")) - F.col("_at") >= microseconds(idle))
    before = events.withColumn("_p", F.lag(message).over(w)).withColumn("_at", F.unix_micros(F.lag(order[0]).over(w).cast("timestamp")) if idle else F.lit(None))
    return before.filter(passes).drop("_p", "_at")


def suppress_repeats_stream(events: DataFrame, late: str = "1 day", idle: str | None = None, buckets: int | None = BUCKETS) -> DataFrame:
    """STR-2, stream of (event_id, subject, message, ts): as the batch form, whatever batches bring the events in, up to `late`
    behind the newest; an event is emitted when the watermark has passed it. With `idle` a subject is forgotten that long after its last event."""
    gap = microseconds(idle) if idle else None

    def passes(last: tuple | None, at: int, message: str) -> bool:
        return last is None or last[1] is None or (message is not None and message != last[1]) or (gap is not None and at - last[0] >= gap)

    return judged_in_order(events, late, passes, True, gap, buckets)


def log_search(events: DataFrame, like: list[str] | None = None, ids: list[int] | None = None, start: str | None = None, stop: str | None = None) -> DataFrame:
    """STR-3: events whose message is like any pattern, of given subjects, from start up to stop; batch or stream."""
    out = events
    if like:
        out = out.filter(reduce(lambda a, b: a | b, (F.col("message").like(p) for p in like)))
    if ids:
        out = out.filter(F.col("subject").isin(ids))
    if start:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    return out.filter(F.col("ts") < F.lit(stop).cast("timestamp")) if stop else out


def rolling_step_stats(facts: DataFrame, window: str = "1 hour", late: str | None = None, slide: str | None = None, by: str = "step") -> DataFrame:
    """STR-4: count, mean and population deviation (whole numbers), maximum and total of time in windows of event time, tumbling or
    sliding, by step, by setup, or with by='overall' of all; with `late` a watermark bounds the state. Batch or stream."""
    facts = facts.withColumn("ts", F.col("ts").cast("timestamp"))
    f = facts.withWatermark("ts", late) if late else facts
    w = (F.window("ts", window, slide) if slide else F.window("ts", window)).alias("w")
    keys = [] if by == "overall" else [by]
    g = f.groupBy(w, *keys).agg(F.count("*").alias("n"), F.round(F.avg("time_s"), 0).alias("mean"), F.round(F.stddev_pop("time_s"), 0).alias("sd"), F.max("time_s").alias("most"), F.sum("time_s").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "mean", "sd", "most", "total")


def throttled_refresh(markers: DataFrame, interval: str = "24 hours") -> DataFrame:
    """STR-5: the first event of each source and interval is the one that refreshes it."""
    g = markers.groupBy("subject", F.window("ts", interval).alias("w")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return g.select("subject", F.col("w.start").alias("window_start"), "event_id")


def refreshes_since_last(markers: DataFrame, interval: str = "24 hours") -> DataFrame:
    """STR-5, batch: the events (event_id, subject, message) that refresh their source: its first one, then each first one at least
    the interval after the last refresh.

    Every event points to the one that would refresh next after it; from the first events the
    pointers lead to all refreshes, and as many as were followed are followed at once in the next round. No
    source is gathered. Events without a time or subject refresh nothing."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = markers.filter("ts is not null and subject is not null").select("subject", at.alias("at"), "event_id", "message")
    held = stored(rows, "markers")
    first = held.groupBy("subject").agg(F.min(F.struct("at", "event_id")).alias("e"))
    # downwards in time, a question meets the earliest event that isn't earlier than it; events of its time come before it
    marks = held.select("subject", (-F.col("at")).alias("down"), F.lit(0).alias("kind"), (-F.col("event_id")).alias("_o"), F.struct("at", "event_id").alias("next"), F.lit(None).cast("struct<at:bigint,event_id:bigint>").alias("e"))
    asked = held.select("subject", (-(F.col("at") + microseconds(interval))).alias("down"), F.lit(1).alias("kind"), (-F.col("event_id")).alias("_o"), F.lit(None).cast("struct<at:bigint,event_id:bigint>").alias("next"), F.struct("at", "event_id").alias("e"))
    swept = last_known(marks.unionByName(asked), "next", "subject", "down", "kind", "_o").filter("kind = 1 and next is not null")
    pointers = stored(swept.select("subject", "e", "next").distinct(), "pointers")
    found = stored(first, "refreshes")
    while not pointers.isEmpty():
        found = stored(found.unionByName(found.join(pointers, ["subject", "e"]).select("subject", F.col("next").alias("e"))), "refreshes")
        pointers = stored(pointers.join(pointers.toDF("subject", "next", "further"), ["subject", "next"]).select("subject", "e", F.col("further").alias("next")), "pointers")
    chosen = found.select("subject", F.col("e.at").alias("at"), F.col("e.event_id").alias("event_id"))
    return held.dropDuplicates(["subject", "at", "event_id"]).join(chosen, ["subject", "at", "event_id"], "left_semi").select("event_id", "subject", "message")


def refreshes_stream(markers: DataFrame, interval: str = "24 hours", late: str = "1 day", buckets: int | None = BUCKETS) -> DataFrame:
    """STR-5, stream: as the batch form, whatever batches bring the events in, up to `late` behind the newest; a source is
    forgotten when the interval after its last refresh is over, since the next event refreshes it anyway."""
    gap = microseconds(interval)
    return judged_in_order(markers, late, lambda last, at, message: last is None or at - last[0] >= gap, False, gap, buckets)
