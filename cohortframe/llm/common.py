"""What several operators share: the shared folder, written tables, and bounded slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    In local mode, where that setting may be absent, a temporary folder is
    made, once a session, and set as the checkpoint folder; on a cluster, whose
    machines would each write to their own disk, its absence is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there,
    and a lost executor costs a reread, not a recomputation."""
    return stored_at(df, what)[0]


def stored_at(df: DataFrame, what: str, *by: str) -> tuple[DataFrame, str]:
    """The same, with the path; columns `by` become folders in it."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles of steps whose results are written: it does so once their frames are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Rows that the Parquet reader takes at once, by default 4096, and bytes of a row group that its writer holds, by default 128 MB.
READER_SETTING, WRITER_SETTING = "spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"


def smaller_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of at most 8 MB in this session, 512 rows at a time from Parquet and row groups of 16 MB, where it
    hasn't been told otherwise: whole texts and sets are large rows, of which JVM and worker each hold a batch for every
    task, and a heap that has grown once stays so for all later steps."""
    if spark.conf.get(BATCH_SETTING, None) in (None, "67108864b"):
        spark.conf.set(BATCH_SETTING, most)
    if spark.conf.get(READER_SETTING, None) in (None, "4096"):
        spark.conf.set(READER_SETTING, "512")
    if spark.conf.get(WRITER_SETTING, None) is None:
        spark.conf.set(WRITER_SETTING, str(16 << 20))


#: What empties the caches that a worker keeps from task to task, by the operator they belong to.
_CACHES: dict[str, Callable[[], None]] = {}


def keep_cache(owner: str, empty: Callable[[], None]) -> None:
    _CACHES[owner] = empty


def only_cache(owner: str | None) -> None:
    """At the start of a task: a worker that lives on lets go of what other operators remembered there, and of memory freed since."""
    for name, empty in _CACHES.items():
        if name != owner:
            empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can give freed memory back
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, in a worker that holds nothing of other operators while it runs and gives freed memory back when it has ended,
    so that an idle worker takes nothing from the steps that run without Python."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache(None)
        yield from run(batches)
        only_cache(None)

    return task


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it while df has a column so called (upper and lower case being the same)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(uri).path)
    return pafs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path of a URI on a mounted file system, which can be memory-mapped; else null."""
    fs, path = filesystem(uri)
    return path if isinstance(fs, pafs.LocalFileSystem) else None


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most most_bytes of text each, or a single row beyond that."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(column).cast(pa.large_binary())
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
