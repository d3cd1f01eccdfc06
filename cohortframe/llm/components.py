"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; the minima are written before they
are joined, so both sides of the join come straight from an exchange and
adaptive execution can split a node with very many links. No node's links are
gathered. Cases: no links give no rows; loops and repeated links do no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_at


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60, rows_a_task: int = 50_000) -> DataFrame:
    """node and component (the smallest node reachable) for every node of links (u, v).

    The links are counted, and steps use as many tasks as they need."""
    spark = links.sparkSession
    edges, path = stored_at(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    mark = _mark(edges)
    tasks = max(6, mark[0] // rows_a_task)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, p1 = stored_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "large-star")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks).distinct()
        large, p2 = stored_at(large.coalesce(tasks), "links")
        least, p3 = stored_at(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "small-star")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        new, p4 = stored_at(small.coalesce(tasks), "links")
        now = _mark(new)
        discard(spark, path, p1, p2, p3)
        edges, path = new, p4
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres).coalesce(tasks)
