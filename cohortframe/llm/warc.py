"""WARC output and a splittable WARC reader.

Writing: one gzip member a record, so any member can be read alone. Of pages
with equal payloads the smallest page_id is a response and the others are
revisits without payload that refer to it.

Reading: files are dealt out by byte range. A task looks for gzip magic in
its range, tries each hit by inflating it and checking after the first bytes
that a WARC version follows, and at the end the header's length, and owns the
records whose member begins inside its range; it reads past the end of the
range to finish the last of them.

A revisit names its response as the format has it (profile, target URI and
date of the response) and, for this reader, by page_id. Record ids are random.

Cases: null html is an empty payload; equal payloads below least_bytes are all
responses; repeated rows of the smallest page_id are each a response, with a
record id of their own; null page_id is kept, never the one referred to, and a
revisit where another page has its payload; null url gives no target URI; an
empty table gives no file; columns beside page_id, url and html are ignored."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, filesystem, new_dir, slices, stored

#: Fixed values of the formats: a gzip member's first bytes, and the record header's first line.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FILES = "path string, bytes long, n_records long"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Repeated payloads, and bytes of their first pages' URLs, up to which their table is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def first_of_copies(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages (page_id, url, html) with sha, first_id and first_url: smallest page_id with the same payload and its URL, null where the payload occurs once.

    Digests, ids and URLs alone are shuffled, and only payloads that occur more
    than once reach the join. They are counted first, so pages stay where they
    are unless the repeated payloads are too many to broadcast."""
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    seen = (
        pages.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)
        .groupBy(sha.alias("sha"))
        .agg(first.alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    seen = stored(seen, "copies")
    size = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("first_url")), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    return pages.withColumn("sha", sha).join(F.broadcast(seen) if small else seen, "sha", "left")


def _one_line(url: str) -> str:
    return re.sub(r"[\r\n]", " ", url)


def _member(page_id: int | None, url: str | None, payload: bytes, sha: str, revisits: bool, first_id: int | None, first_url: str | None) -> bytes:
    lines = [
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=os.urandom(16), version=4)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _one_line(url))
    if revisits:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To-Page-ID: {first_id}", f"WARC-Refers-To-Date: {DATE}"]
        if first_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + _one_line(first_url))
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, one a task, and returns the table of files, itself written."""
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    wanted = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    columns = ["page_id", "url", "sha", "first_id", "first_url"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for part in slices(batch, "html"):
                if out is None:
                    fs, path = filesystem(name)
                    out = fs.open_output_stream(path, compression=None)
                for html, page_id, url, sha, first_id, first_url in zip(as_bytes(part.column("html")), *(part.column(c).to_pylist() for c in columns), strict=True):
                    member = _member(page_id, url, html, sha, first_id is not None and first_id != page_id, first_id, first_url)
                    out.write(member)
                    size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "n_records": [n]})

    return stored(first_of_copies(wanted, least_bytes).select("html", *columns).mapInArrow(write, FILES), "warc-files")


class _Range:
    """A file read in blocks; what lies in the block at hand is not read again."""

    def __init__(self, file: pa.NativeFile, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.at, self.held = file, size, block, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, self.block), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]


def _inflate(source: _Range, at: int) -> tuple[bytes, int] | None:
    """The member at a position, and where it ends; null if it isn't one of a WARC record, which its first bytes tell."""
    unpack, out, held, pos, step = zlib.decompressobj(31), [], 0, at, 2048
    try:
        while not unpack.eof:
            chunk = source.read(pos, step)
            if not chunk:
                return None
            out.append(unpack.decompress(chunk))
            pos, step = pos + len(chunk), min(2 * step, 1 << 16)
            before, held = held, held + len(out[-1])
            if before < len(VERSION) <= held and not b"".join(out).startswith(VERSION):
                return None
    except zlib.error:
        return None
    return b"".join(out), pos - len(unpack.unused_data)


def records_in(fs: pafs.FileSystem, path: str, size: int, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and body of each record whose member begins in [start, stop)."""
    stop = min(stop, size)
    with fs.open_input_file(path) as file:
        source, at = _Range(file, size), start
        while at < stop:
            if source.read(at, len(MAGIC)) != MAGIC:
                block = source.read(at, min(source.block, stop - at) + len(MAGIC) - 1)
                hit = block.find(MAGIC)
                if hit < 0:
                    at += max(1, len(block) - len(MAGIC) + 1)
                    continue
                at += hit
            if at >= stop:
                return
            whole = _inflate(source, at)
            header, _, rest = whole[0].partition(b"\r\n\r\n") if whole and whole[0].startswith(VERSION) else (b"", b"", b"")
            fields = dict(x.split(": ", 1) for x in header.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
            length = fields.get("Content-Length", "")
            if not length.isdigit() or len(rest) != int(length) + 4:
                at += 1
                continue
            yield fields, rest[: int(length)]
            at = whole[1]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(files: DataFrame, range_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the given files (path, bytes), read by ranges of range_bytes.

    A revisit has no payload of its own; its length and digest are those of
    its header. A response's are computed from what was read."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = ranges.repartitionByRange(min(int(tasks), 100_000), "path", "start")  # a range or so a task, not as a hash happens to fall

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        made: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*made, strict=True), kinds, strict=True)], [n for n, _ in kinds])

        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                for head, body in records_in(fs, path, row["bytes"], row["start"], row["start"] + range_bytes):
                    own, other = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                    response = head["WARC-Type"] == "response"
                    made.append((int(own) if own else None, head.get("WARC-Target-URI"), len(body) if response else int(head["WARC-Payload-Length"]), _digest(body) if response else head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], int(other) if other else None, body if with_payload else None))
                    held += len(body) if with_payload else 100
                    if held > 4 << 20:
                        yield emit()
                        made, held = [], 0
        if made:
            yield emit()

    return ranges.mapInArrow(read, READ)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, least_bytes=0)
    return read_warc(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
