"""Numbers, running totals and carried values over whole orders, by range partitions and prefix sums over the partitions.

No function here gathers a group or a table in one task: rows are range-
partitioned and written, each partition does its own part, and a table of one
row a partition (and group) carries what earlier partitions hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import stored


def _parted(df: DataFrame, *order: str) -> DataFrame:
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parted")


def number_within(df: DataFrame, group: str, *order: str) -> DataFrame:
    """rn, the row's number within its group by the given order."""
    parted = _parted(df, group, *order)
    local = Window.partitionBy("_part", group).orderBy(*order)
    counts = parted.groupBy("_part", group).count()
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.col(group).alias("_number_group"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = parted.withColumn("_rn", F.row_number().over(local)).withColumnRenamed("_part", "_p")
    joined = numbered.join(counts, (F.col("_p") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_number_group")))
    return joined.withColumn("rn", F.col("_rn") + F.col("_before")).drop("_part", "_p", "_number_group", "_before", "_rn")


def running_total(df: DataFrame, value: str, *order: str) -> DataFrame:
    """total, the sum of value over the row and all before it by the given order (which leaves no ties)."""
    parted = _parted(df, *order)
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_s"))
    sums = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parted.withColumn("_local", local).join(F.broadcast(sums), "_part").withColumn("total", F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def last_known(df: DataFrame, value: str, group: str, *order: str) -> DataFrame:
    """value, where null that of the last row before it in its group that has one."""
    parted = _parted(df, group, *order)
    held = parted.groupBy("_part", group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("_part").alias("_p"), F.col(group).alias("_number_group"), F.last("_last", ignorenulls=True).over(before).alias("_before"))
    local = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = parted.withColumn("_own", F.last(value, ignorenulls=True).over(local))
    joined = filled.join(held, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_number_group")))
    return joined.withColumn(value, F.coalesce("_own", "_before")).drop("_part", "_p", "_number_group", "_own", "_before")


def with_place(ordered: DataFrame) -> DataFrame:
    """place, each row's position in a sorted table from 1: its number in its range partition plus the counts of earlier ones."""
    held = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("_part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    return held.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn("place", F.col("_before") + within + 1).drop("_id", "_part", "_before")


def group_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median, the exact median of each group's values (null ones aside): the middle one, or the mean of the middle two.

    Equal values are counted first, then range-partitioned by keys and value. Counts a partition and group say which partitions hold a
    group's middle ranks, and only those are looked into; so neither a group nor a frequent value is gathered in a task."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    parted = _parted(counted, *keys, "_value")
    by_group = Window.partitionBy(*(f"_k{i}" for i in range(len(keys))))
    sums = parted.groupBy(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(by_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).withColumn("_all", F.sum("_s").over(by_group))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = stored(sums.withColumn("_low", low).withColumn("_high", high).filter("_before < _high and _before + _s >= _low"), "middle")
    met = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = parted.join(middle, met)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") >= F.col(rank)) & (F.col("_upto") - F.col("_n") < F.col(rank)), F.col("_value")))
    return near.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias("median"))
