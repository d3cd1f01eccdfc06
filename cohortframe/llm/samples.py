"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_class(rows: DataFrame, label: str, key: str, each: int, most_classes: int = 10_000) -> DataFrame:
    """About `each` rows of every class at most, chosen by a hash of `key`; never more than 1.5 * each * classes + 100.

    Every class is sampled; more than most_classes of them is an error, as the
    sample would have no useful bound. One grouped count and one filtered scan:
    no class is gathered in a task. Which rows are chosen depends on the rows
    alone, not on the order of tasks: beyond the bound (a key that many rows
    share) the first by hash, key and the other columns stay."""
    labelled = rows.filter(F.col(label).isNotNull())
    counts = labelled.groupBy(label).count()
    sizes = counts.limit(most_classes + 1).collect()
    if len(sizes) > most_classes:
        raise ValueError(f"more than {most_classes} classes of {label}")
    shares = rows.sparkSession.createDataFrame([(r[label], int(min(1.0, each / r["count"]) * 1_000_000)) for r in sizes], f"_class {rows.schema[label].dataType.simpleString()}, _share long")
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000))
    chosen = labelled.join(F.broadcast(shares), F.col(label) == F.col("_class")).filter(place < F.col("_share")).drop("_class", "_share")
    return chosen.orderBy(place, key, *(c for c in rows.columns if c != key)).limit(int(1.5 * each * len(sizes)) + 100)
