"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `capacity` ids while they are
tokenised. The histogram of piece lengths, of at most `capacity` rows whatever
the corpus, goes to the driver, which packs it: lengths longest first, each
into the shortest pattern with room, moving counts between patterns. A length
opens, moves and splits patterns, so their number follows the number of
lengths, not of documents, and the table of their slots can be broadcast. Every
pattern slot then owns an interval of the ranks of its length, and a piece
finds its sequence and offset by its rank. Ranks are local ranks of the
written pieces table plus prefix sums over (part, length) counts, so no length,
however frequent, is gathered anywhere.

Cases: null text counts as empty and yields the end id alone; documents with
equal doc_id are packed each; an empty table gives no rows; a document of any
length is cut; other columns are ignored."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, smaller_batches, stored
from .word_tokens import default_tokenizer, encoder

PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_rank long"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document, with their rank among the pieces of the same length in the same task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch, "text"):
                rows: list[tuple] = []
                for doc_id, coded in zip(some.column("doc_id").to_pylist(), coder.encode(as_bytes(some.column("text"))), strict=True):
                    ids = coded + end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        own = ids[4 * start : 4 * (start + capacity)]
                        size = len(own) // 4
                        rows.append((part, doc_id, start, size, zlib.crc32(own), n, int(seen[size]), own))
                        seen[size] += 1
                columns = list(zip(*rows, strict=True))
                made = [pa.array(columns[0], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[1:7])]
                names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_rank"]
                if keep_ids:
                    made, names = [*made, pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in columns[7]], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(made, names)

    smaller_batches(docs.sparkSession)
    wanted = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order packed) with the number of sequences of each.

    Where no pattern has room, only as many sequences are opened as all pieces
    still to be placed need; the rest of that length then stacks up on them."""
    by_total: dict[int, list[list]] = defaultdict(list)
    free = 0
    todo = sum(length * n for length, n in histogram.items())
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            total = next((t for t in sorted(by_total) if t + length <= capacity), None)
            if total is None:
                needed = -(-(todo - free) // capacity)
                opened = max(1, min(left, max(-(-left // (capacity // length)), needed)))
                by_total[length].append([(length,), opened])
                left, todo, free = left - opened, todo - length * opened, free + (capacity - length) * opened
                continue
            entry = by_total[total][-1]
            moved = min(left, entry[1])
            entry[1] -= moved
            if not entry[1]:
                by_total[total].pop()
                if not by_total[total]:
                    del by_total[total]
            by_total[total + length].append([(*entry[0], length), moved])
            left, todo, free = left - moved, todo - length * moved, free - length * moved
    return [(tuple(pattern), count) for t in sorted(by_total) for pattern, count in by_total[t]]


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each pattern slot the interval of ranks that it takes of its length: sorted by length and first rank."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece (and its ids, if asked for)."""
    pieces = stored(cut_pieces(docs, capacity, tokenizer or default_tokenizer(), end_id, keep_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = stored(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(slots_of(shortest_pack_first(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(slots["key"], (length << 44) + rank, side="right") - 1
            kept = names + (["ids"] if keep_ids else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(slots["sequence"][at] + rank - slots["first"][at]), pa.array(slots["offset"][at])], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{c} long" for c in names) + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, *(["ids"] if keep_ids else []), "rank").mapInArrow(place, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
