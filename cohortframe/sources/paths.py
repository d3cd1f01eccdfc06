"""Paths and written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def new_dir(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir. In local mode, where that may be unset, it is in a temporary folder made once a session;
    on a cluster, whose machines would each write to their own disk, an unset one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        base = _OWN[app]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
