"""Token-ID binary output: flat files of unsigned integers with 64-bit document offsets.

A data set is a folder of shards in ascending doc_id order. Shard NAME has
NAME.ids (ids without gaps, unsigned 16-bit if the vocabulary fits, else
32-bit, little-endian), NAME.offsets (int64, documents + 1, from 0) and
NAME.docs (int64 doc_id; null as the smallest int64). The manifest table lists
shards; a shard's base, the ids before it, is a prefix sum over the manifest.

Cases: null text counts as empty and yields the end id alone; an empty table
gives no shards and no rows; null doc_id comes first; documents with equal
doc_id are ordered by a hash of their text, by which many of them spread over
shards; columns beside doc_id and text are ignored."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, filesystem, local_path, new_dir, slices, stored
from .word_tokens import default_tokenizer, encoder

NO_ID = np.iinfo(np.int64).min
MANIFEST = "shard int, name string, width int, n_docs long, n_tokens long"
#: Bytes of text of a shard, about, and ids that the reader takes at once.
SHARD_BYTES, READ_IDS = 64 << 20, 1 << 20


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, width: int | None = None, shards: int | None = None) -> DataFrame:
    """Writes the data set and returns its manifest, itself written.

    Each task writes its range of doc_id under a name of its own attempt, so
    a repeated task leaves only files that no manifest row names. width is
    the bytes of an id (2 or 4); by default 2 where the vocabulary fits.
    shards follows the bytes of text; the session's shuffle partitions are the least."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    wanted = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if shards is None:
        size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        bytes_an_id = width or (2 if max(coder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
        kind, end = f"<u{bytes_an_id}", np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        fs, path = filesystem(folder)
        out, ids, ends = None, array("q"), array("q", [0])
        for batch in batches:
            for part in slices(batch, "text"):
                out = out or fs.open_output_stream(f"{path}/{name}.ids", compression=None)
                ids.extend(NO_ID if x is None else x for x in part.column("doc_id").to_pylist())
                coded = coder.encode(as_bytes(part.column("text")))
                ends.frombytes((ends[-1] + np.cumsum([len(x) // 4 + 1 for x in coded])).astype(np.int64).tobytes())
                out.write(np.frombuffer(end.join([*coded, b""]), "<u4").astype(kind).tobytes())
        if out is None:
            return
        out.close()
        for what, values in (("offsets", ends), ("docs", ids)):
            with fs.open_output_stream(f"{path}/{name}.{what}", compression=None) as f:
                f.write(np.frombuffer(values, np.int64).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "width": pa.array([bytes_an_id], pa.int32()), "n_docs": [len(ids)], "n_tokens": [ends[-1]]})

    order = ["doc_id", F.xxhash64("text")]
    return stored(wanted.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "manifest")


class _File:
    """Parts of a file as arrays: memory-mapped where the store is mounted, else read as asked for."""

    def __init__(self, folder: str, name: str, kind: str):
        self.kind, self.mapped = np.dtype(kind), None
        if path := local_path(f"{folder}/{name}"):
            self.mapped = np.memmap(path, kind, "r")
        else:
            fs, path = filesystem(f"{folder}/{name}")
            self.file = fs.open_input_file(path)

    def part(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        return np.frombuffer(self.file.read_at((stop - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files.

    The prefix sum runs over the manifest alone, a row a shard."""
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets, docs, ids = (_File(folder, row["name"] + what, kind) for what, kind in ((".offsets", "<i8"), (".docs", "<i8"), (".ids", f"<u{row['width']}")))
                a = 0
                while a < row["n_docs"]:
                    at = offsets.part(a, min(a + 10_000, row["n_docs"]) + 1)
                    n = max(1, int(np.searchsorted(at, at[0] + READ_IDS, side="right")) - 1)  # whole documents, one at least
                    at, some = at[: n + 1], docs.part(a, a + n)
                    flat = memoryview(ids.part(int(at[0]), int(at[-1])).astype("<u4")).cast("B")
                    cuts = (4 * (at - at[0])).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(some, pa.int64(), mask=np.asarray(some == NO_ID)),
                            "start": pa.array(row["base"] + at[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(at), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(flat[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                        }
                    )
                    a += n

    spread = based.repartitionByRange(min(max(manifest.count(), 1), 100_000), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder, manifest)
