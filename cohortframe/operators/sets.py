"""Unions, reconciliation and metadata merges (SET-1 to SET-8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_address
from .ordering import number_within


def union_reads(parts: list[DataFrame]) -> DataFrame:
    """SET-1: alignments of all parts."""
    return reduce(DataFrame.unionByName, parts)


def merge_batches(files: DataFrame, group: list[str], most: int | None = None, by_layout: bool = False) -> DataFrame:
    """SET-1: layout and batch of each file of a group: batches of at most `most` files, by path, from 0 (all in one without a limit).

    By layout, paired and single files (column paired) are merged apart, as pe
    and se; else together, as pe if any file of the group is paired."""
    own = F.when(F.col("paired"), "pe").otherwise("se") if "paired" in files.columns else F.lit("se")
    f = files.withColumn("layout", own)
    if not by_layout:
        f = f.drop("layout").join(f.groupBy(*group).agg(F.min("layout").alias("layout")), group)
    if most is None:
        return f.withColumn("batch", F.lit(0).cast("long"))
    keyed = f.withColumn("_key", F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in (*group, "layout"))))
    return number_within(keyed, "_key", "path").withColumn("batch", F.floor((F.col("rn") - 1) / most)).drop("_key", "rn")


def concat_variants(parts: list[DataFrame], sites_only: bool = False, dedupe: bool = False) -> DataFrame:
    """SET-2: variants of all parts; sites only, the fixed columns; deduped, a site of overlapping parts once."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if sites_only:
        u = u.select("chrom", "pos", "ref", "alt")
    return u.dropDuplicates(["chrom", "pos", "ref", "alt"]) if dedupe else u


def union_sites(call_sets: list[DataFrame]) -> DataFrame:
    """SET-3"""
    return reduce(DataFrame.union, [c.select("chrom", "pos") for c in call_sets]).distinct()


def reconcile_elements(existing: DataFrame, current: DataFrame) -> DataFrame:
    """SET-5: elements by content address of their paths: kept, withdrawn, returned or new, with the withdrawn flag they get."""
    e = existing.select(content_address(F.col("paths")).alias("key"), F.col("withdrawn").alias("_was"))
    c = current.select(content_address(F.col("paths")).alias("key"), F.lit(True).alias("_now")).distinct()
    j = e.join(c, "key", "full_outer")
    what = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), F.when(F.col("_was"), "still withdrawn").otherwise("withdrawn")).when(F.col("_was"), "returned").otherwise("kept")
    return j.select("key", what.alias("what"), F.col("_now").isNull().alias("withdrawn"))


def metadata_changes(current: DataFrame, new: DataFrame, tracked: list[str]) -> DataFrame:
    """SET-6: the first tracked key (columns of a file_id table) whose value differs; null on either side is no change."""
    n = new.select("file_id", *(F.col(k).alias(f"n_{k}") for k in tracked))
    first = F.coalesce(*(F.when(F.col(k) != F.col(f"n_{k}"), F.lit(k)) for k in tracked))
    return current.join(n, "file_id").select("file_id", first.alias("changed")).filter("changed is not null")


def elements_to_reset(changes: DataFrame, elements: DataFrame) -> DataFrame:
    """SET-6: elements (element, file_ids) that use a changed file."""
    return elements.select("element", F.explode("file_ids").alias("file_id")).join(changes, "file_id", "left_semi").select("element").distinct()


def _map(c: str) -> Column:
    return F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def apply_metadata(current: DataFrame, new: DataFrame, replace: bool, resolved: DataFrame | None = None) -> DataFrame:
    """SET-7: meta maps merged: replacing, a new non-empty value wins; else an existing key keeps its value.

    With resolved (file_id, current, of GRF-2) a file's new values are also those
    of the file that it leads to; of several such files, and of its own values,
    the greatest file_id's win."""
    if resolved is not None:
        onward = new.join(resolved.filter("current is not null and current <> file_id"), "file_id").select(F.col("current").alias("file_id"), "meta", F.col("file_id").alias("_from"))
        pairs = new.select("file_id", "meta", F.col("file_id").alias("_from")).unionByName(onward).select("file_id", "_from", F.explode("meta").alias("k", "v")).filter(F.col("v") != "" if replace else F.lit(True))
        one = pairs.groupBy("file_id", "k").agg(F.max_by("v", "_from").alias("v"))
        new = one.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))
    j = current.join(new.select("file_id", F.col("meta").alias("_n")), "file_id", "left")
    fresh = F.map_filter(_map("_n"), lambda k, v: v != "")
    first, second = (fresh, _map("meta")) if replace else (_map("meta"), _map("_n"))
    rest = F.map_filter(second, lambda k, v: ~F.array_contains(F.map_keys(first), k))
    return j.select("file_id", F.map_concat(first, rest).alias("meta"))


def merge_metadata(current: DataFrame, new: DataFrame) -> DataFrame:
    """SET-8: eav tables merged: each key's distinct values of both sides, sorted."""
    return current.unionByName(new).groupBy("file_id", "key").agg(F.array_sort(F.collect_set("val")).alias("vals"))


def check_row_counts(before: DataFrame, after: DataFrame, mode: str = "equal") -> DataFrame:
    """SNK-3: after, unless it has another number of rows than before (fewer, with mode 'at_least'), which is an error."""
    n, m = before.count(), after.count()
    if m != n if mode == "equal" else m < n:
        raise ValueError(f"{n} rows in, {m} rows out")
    return after
