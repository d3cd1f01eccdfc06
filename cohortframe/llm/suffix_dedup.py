"""Removal of byte strings that an earlier document holds as well, by range-partitioned suffixes.

A byte goes if a string of WIDTH bytes over it also starts in a document with a
smaller doc_id. Not every suffix is sorted: of each string of WIDTH bytes the
leading tokens of GRAM bytes with the least hash are its anchors, the same
wherever the string stands, so sorting the suffixes at anchors (one in about
sixteen positions), each with the bytes before it, finds every repeat:

1. Anchors whose token occurs in one document only go. Tokens are counted as
   sorted blocks of hashes; those of several documents become a bitmap of bounded
   size, in which a false hit only costs work. A second one has those of them
   that have different bytes around them; all other suffixes are equal if their
   tokens are, and need the key of their bytes alone.
2. Suffixes of the second kind are range-partitioned by their leading token,
   between splitters sampled from the documents. A bucket sorts its suffixes,
   and the reversed bytes before them, by multikey quicksort; runs of long enough
   common prefixes on either side give, for every string over an anchor, the
   first document that has it. All suffixes of one token fall in one bucket. A token so
   frequent that it is a splitter twice reaches over bucket boundaries; there
   each string over the anchor is compared across them, in buckets of its own hash.
3. Each anchor's decisions return to its documents by the key of its bytes; a
   key with very many occurrences is dealt over several tasks.

What crosses a shuffle are blocks of arrays, a row for each task and bucket, in
which equal suffixes have been made one.

Cases: null text is empty; texts shorter than WIDTH lose nothing; texts of any
length are taken in blocks, whole; a row with null doc_id loses nothing and
makes no other lose anything; rows of one doc_id never make each other lose
anything, but each is judged by its own text; repeated rows come back as often
as they stand; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, only_cache, released, slices, smaller_batches, stored_at

WIDTH, GRAM = 50, 20
#: Bytes before an anchor that a string over it can reach.
BEFORE = WIDTH - GRAM
#: Layout of a suffix: WIDTH bytes from the anchor, BEFORE bytes before it (nearest first), how many of either are in the document.
ROW = WIDTH + BEFORE + 2
#: Bits of the bitmap at most (64 MB), and for each token while there is room.
MOST_BITS, BITS_A_TOKEN = 29, 16
#: Bytes of text a slice, entries of a block that a task holds, bytes of a bucket (about), of spans that are broadcast at most, rows too.
SLICE, HELD, BUCKET, BROADCAST, BROADCAST_ROWS = 1 << 20, 1 << 19, 8 << 20, 64 << 20, 500_000
#: One document in so many is read for splitters.
SAMPLE = 64

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(blobs, kinds: str) -> list[np.ndarray]:
    """The columns of several packed blocks, joined; kinds has numpy's names of their types."""
    types = [np.dtype(k) for k in kinds.split()]
    width, parts = sum(t.itemsize for t in types), [[] for _ in types]
    for blob in blobs:
        at, n = 0, len(blob) // width
        for t, part in zip(types, parts, strict=True):
            part.append(np.frombuffer(blob, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]


def _window(f, values: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over each `width` neighbours, by doubling."""
    n, out = 1, values
    while 2 * n <= width:
        out, n = f(out[:-n], out[n:]), 2 * n
    return f(out[: n - width], out[width - n :]) if n < width else out


def _anchors(buffer: np.ndarray, n: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the tokens of least hash in each string of WIDTH bytes of buffer[:n]; buffer has 32 bytes more."""
    places, hashes = [], []
    spread = WIDTH - GRAM + 1
    for a in range(0, max(n - WIDTH + 1, 0), block):
        m = min(block + WIDTH, n - a) - GRAM + 1
        eight = np.ndarray((m,), "<u8", buffer, a, (1,))
        h = eight * _M[0]
        h ^= h >> np.uint64(32)
        h += np.ndarray((m,), "<u8", buffer, a + 8, (1,))
        h *= _M[1]
        h ^= h >> np.uint64(29)
        h += np.ndarray((m,), "<u4", buffer, a + 16, (1,))
        h *= _M[2]
        h ^= h >> np.uint64(31)
        edge = np.zeros(spread - 1, np.uint64)
        least = _window(np.maximum, np.concatenate([edge, _window(np.minimum, h, spread), edge]), spread)
        found = np.flatnonzero(least == h)
        places.append(found + a)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _slice_anchors(part: pa.RecordBatch):
    """buffer, and of each anchor inside a document its place in it, hash, row, and bytes of its document before it and from it on."""
    texts = [b"" if d is None or len(x) < WIDTH else x for d, x in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True)]
    data = bytes(BEFORE) + b"".join(texts) + bytes(64)
    buffer = np.frombuffer(data, np.uint8)
    place, h = _anchors(buffer, len(data) - 64)
    ends = np.cumsum([len(x) for x in texts]) + BEFORE
    row = np.searchsorted(ends, place, side="right")
    inside = (place >= BEFORE) & (row < len(texts))
    place, h, row = place[inside], h[inside], row[inside]
    before, after = place - np.r_[BEFORE, ends][row], ends[row] - place
    keep = (after >= GRAM) & (np.minimum(before, BEFORE) + np.minimum(after, WIDTH) >= WIDTH)
    return buffer, place[keep], h[keep], row[keep], before[keep], after[keep]


def _lanes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each row of bytes, as two numbers."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view("<u8")
    one, two = np.full(len(rows), _M[3]), np.full(len(rows), _M[4])
    for j in range(words.shape[1]):
        one = (one ^ words[:, j]) * _M[0]
        one ^= one >> np.uint64(32)
        two = (two + words[:, j]) * _M[2]
        two ^= two >> np.uint64(29)
    one, two = (one ^ two) * _M[3], (two + (one >> np.uint64(7))) * _M[4]
    return one ^ (one >> np.uint64(31)), two ^ (two >> np.uint64(30))


def _keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 96 bits of it by which suffixes are told apart."""
    one, two = _lanes(rows)
    return one, two.astype("<u4")


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each run of them starts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def multikey_quicksort(words: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of rows of unsigned words: rows are parted in three by a pivot of one word, and those equal to it go on by the next."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        part = order[a:b]
        if b - a <= small:
            order[a:b] = part[np.lexsort(words[part][:, depth:].T[::-1])]
            continue
        word = words[part, depth]
        drawn = np.sort(word[:: max(1, (b - a) // 101)])
        pivot = drawn[len(drawn) // 2]
        less, more = word < pivot, word > pivot
        equal = ~(less | more)
        i = a + int(less.sum())
        j = i + int(equal.sum())
        order[a:b] = np.concatenate([part[less], part[equal], part[more]])
        todo += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


def _sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and the common prefix of each with the one before it (0 for the first)."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    order = multikey_quicksort(wide.view(">u8").astype(np.uint64))
    common = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 16):
        at = np.arange(a, min(a + (1 << 16), len(rows)))
        differ = rows[order[at]] != rows[order[at - 1]]
        common[at] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, common


def _repeats(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For distinct suffixes, of which first is the least doc_id that has each: bit o is set if the string that starts o bytes
    before the anchor is in a document of smaller doc_id."""
    mask = np.zeros(len(rows), np.uint32)
    if len(rows) < 2:
        return mask
    order, common = _sorted_prefixes(rows[:, :WIDTH])
    near = np.zeros(len(rows), bool)  # others share their token
    same = common >= GRAM
    near[order[same]] = True
    near[order[np.flatnonzero(same) - 1]] = True
    some = np.flatnonzero(near)
    if not len(some):
        return mask
    renumber = np.cumsum(near) - 1
    kept = near[order]
    # the common prefix of neighbours that stay is as before: a suffix between them would have stayed, too, or shares no token
    at = np.flatnonzero(kept)
    ahead = np.where(np.r_[False, np.diff(at) == 1], common[at], 0)
    ahead[0] = 0
    order, rows, first = renumber[order[kept]], rows[some], first[some]
    back, behind = _sorted_prefixes(rows[:, WIDTH : WIDTH + BEFORE])
    before, after = rows[:, -2], rows[:, -1]
    own = np.zeros(len(rows), np.uint32)
    n = len(rows)
    right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(BEFORE + 1):
        fits = np.flatnonzero((before >= o) & (after >= WIDTH - o))
        if len(fits) < 2:
            continue
        right[order] = np.cumsum(ahead < WIDTH - o)
        left[back] = np.cumsum(behind < o)
        key = right[fits] * (n + 1) + left[fits]
        by, starts = _runs(key)
        least = np.minimum.reduceat(first[fits][by], starts)
        least = np.repeat(least, np.diff(np.r_[starts, len(by)]))
        hit = by[first[fits][by] > least]
        own[fits[hit]] |= np.uint32(1 << o)
    mask[some] = own
    return mask


DECISIONS = "<u8 <u4 <i8 <u4"  # key, first doc_id, repeated strings
SPREAD = "<u8 <u8 <u8 <u4 <i8 <i8 u1"  # key of a string, of its suffix, first and last doc_id, start before the anchor
OCCURRENCES = "<u8 <u4 <i8 <i8 <u4 u1 u1"  # key, doc_id, part of a repeated doc_id, place, bytes before and from the anchor
SPANS = "<i8 <i8 <u4 <u4"  # doc_id, part, start, end


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order, cuts = _runs(bucket)
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        yield int(bucket[order[a]]), order[a:b]


def _table(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names.split())


TOKENS = "<u4 <u4 u1"  # leading bits of a token's hash in its bucket, 39 bits of the hash of the bytes around it, and whether several documents have the token


def _spotted(h: np.ndarray, around: np.ndarray, source: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (h, around), and of each whether its h is marked as shared or comes from several sources; and the order's runs of h."""
    order = np.lexsort((around, h))
    h, around, source, shared = h[order], around[order], source[order], shared[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(h)])
    if len(h):
        several = np.maximum.reduceat(shared, starts).astype(bool) | (np.minimum.reduceat(source, starts) != np.maximum.reduceat(source, starts))
        new = np.r_[True, (h[1:] != h[:-1]) | (around[1:] != around[:-1])]
        return h[new], around[new], np.repeat(several, sizes)[new]
    return h, around, shared.astype(bool)


def shared_tokens(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of hashes of tokens at anchors, by their leading bits: those in several documents, and of these those with different bytes around them.

    size is the bytes of all texts."""
    spark = docs.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 16 // (1 << 20), 8)
    lead, most, held_most = int(least - 1).bit_length(), SLICE, HELD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache(None)
        held, entries = [], 0

        def blocks():
            h, around, shared = _spotted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            low = ((h >> np.uint64(32 - lead)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            one, two = around.astype("<u4"), (around >> np.uint64(57) << np.uint64(1)).astype(np.uint8) | shared.astype(np.uint8)
            return _table([(b, _packed(low[i], one[i], two[i])) for b, i in _by_bucket((h >> np.uint64(64 - lead)).astype(np.int64))], "bucket block", [pa.int32(), pa.binary()])

        for batch in batches:
            for part in slices(batch, "text", most):
                buffer, place, h, row, before, after = _slice_anchors(part)
                if not len(h):
                    continue
                h, around, shared = _spotted(h, _lanes(_rows(buffer, place, before, after))[0], row, np.zeros(len(h), np.uint8))
                held.append((h, around, np.full(len(h), len(held)), shared.astype(np.uint8)))
                entries += len(h)
                if entries > held_most:
                    yield blocks()
                    entries = 0
        if held:
            yield blocks()

    def meet(group: pa.Table) -> pa.Table:
        blobs = group.column("block").to_pylist()
        low, one, two = _unpacked(blobs, TOKENS)
        around = one.astype(np.uint64) | (two >> np.uint8(1)).astype(np.uint64) << np.uint64(32)
        low, around, shared = _spotted(low, around, np.repeat(np.arange(len(blobs)), [len(x) // 9 for x in blobs]), two & np.uint8(1))
        low = low[shared]
        low, n = np.unique(low, return_counts=True)
        return pa.table({"bucket": group.column("bucket")[:1], "low": pa.array([low.tobytes()], pa.binary()), "several": pa.array([low[n > 1].tobytes()], pa.binary()), "n": pa.array([len(low)], pa.int64())})

    found, path = stored_at(docs.select("doc_id", "text").mapInArrow(count, "bucket int, block binary").groupBy("bucket").applyInArrow(meet, "bucket int, low binary, several binary, n long"), "shared-tokens")
    total = found.agg(F.sum("n")).first()[0] or 0
    bits = max(min(int(BITS_A_TOKEN * total).bit_length(), MOST_BITS, lead + 32), lead + 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "several")), strict=True):
                maps = []
                for blob in blobs:
                    seen = np.zeros(1 << (bits - lead), np.uint8)
                    seen[np.frombuffer(blob, "<u4") >> np.uint32(32 - (bits - lead))] = 1
                    maps.append(np.packbits(seen).tobytes())
                yield _table([(bucket, *maps)], "bucket shared several", [pa.int32(), pa.binary(), pa.binary()])

    out, width = np.zeros((2, 1 << (bits - 3)), np.uint8), 1 << (bits - lead - 3)
    for row in found.select("bucket", "low", "several").mapInArrow(mark, "bucket int, shared binary, several binary").toLocalIterator():
        for i, blob in enumerate((row.shared, row.several)):
            out[i, row.bucket * width : (row.bucket + 1) * width] = np.frombuffer(blob, np.uint8)
    discard(spark, path)
    return out[0], out[1]


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


def _rows(buffer: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rows of bytes of the suffixes at places of buffer."""
    rows = np.zeros((len(place), ROW), np.uint8)
    before, after = np.minimum(before, BEFORE), np.minimum(after, WIDTH)
    view = np.lib.stride_tricks.sliding_window_view
    rows[:, :WIDTH] = view(buffer, WIDTH)[place]
    rows[:, WIDTH:-2] = view(buffer, BEFORE)[place - BEFORE][:, ::-1]
    for short, start, width in ((after, 0, WIDTH), (before, WIDTH, BEFORE)):
        cut = np.flatnonzero(short < width)
        rows[cut, start : start + width] *= np.arange(width)[None, :] < short[cut][:, None]
    rows[:, -2], rows[:, -1] = before, after
    return rows


def _suffixes(part: pa.RecordBatch, shared: np.ndarray, several: np.ndarray):
    """Rows of bytes of the suffixes at anchors of shared tokens of a slice; each anchor's row of the slice, its place in the document, and
    whether its token has different bytes around it elsewhere."""
    buffer, place, h, row, before, after = _slice_anchors(part)
    keep = _marked(shared, h)
    place, h, row, before, after = place[keep], h[keep], row[keep], before[keep], after[keep]
    return _rows(buffer, place, before, after), row, before, _marked(several, h)


def _splitters(docs: DataFrame, bitmaps) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading tokens between buckets, the frequent ones among them, and the bytes of all suffixes (about), from a sample of documents."""

    most = SLICE

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most):
                rows, _, _, differ = _suffixes(part, *bitmaps.value)
                rows = rows[differ]
                distinct = np.unique(np.ascontiguousarray(rows[:, : WIDTH + BEFORE]).view(f"S{WIDTH + BEFORE}").ravel())
                yield _table([(distinct.astype(f"S{GRAM}").tobytes(), len(rows))], "tokens n", [pa.binary(), pa.int64()])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("doc_id", "text").mapInArrow(draw, "tokens binary, n long")
    tokens, total = [np.zeros(0, f"S{GRAM}")], 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for r in some.toLocalIterator():
        own = np.frombuffer(r.tokens, f"S{GRAM}")
        # a bounded sample of the sample: as many of each slice as a few thousand splitters need
        tokens.append(own[:: max(1, len(own) // 2000)])
        total += r.n
    found = np.sort(np.concatenate(tokens))
    buckets = max(least, SAMPLE * total * ROW // BUCKET)
    at = (np.arange(1, buckets) * len(found)) // buckets
    cuts = found[at] if len(found) else found
    twice = np.unique(cuts[1:][cuts[1:] == cuts[:-1]])
    return np.unique(cuts), twice if len(found) >= 16 * buckets else twice[:0], buckets


def decided(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Decisions for suffixes (key_bucket, block) and occurrences (key_bucket, block), the paths of what is written, and the number of key buckets."""
    spark = docs.sparkSession
    bitmaps = spark.sparkContext.broadcast(shared_tokens(docs, size))
    released(spark)
    cuts, frequent, buckets = _splitters(docs, bitmaps)
    bounds = spark.sparkContext.broadcast((cuts, frequent))
    keys, most, held_most = int(max(buckets - 1, 1)).bit_length(), SLICE, HELD // 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache(None)
        cuts, frequent = bounds.value
        held: list[tuple] = []

        def blocks():
            rows, doc, one, two, sub, place, differ = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            out = []
            for b, i in _by_bucket((one >> np.uint64(64 - keys)).astype(np.int64)):
                out.append((b, "occurrences", _packed(one[i], two[i], doc[i], sub[i], place[i].astype("<u4"), rows[i, -2], rows[i, -1])))
            rows, doc, one, two = rows[differ], doc[differ], one[differ], two[differ]
            order, starts = _runs(one, two)
            lo, hi = (f.reduceat(doc[order], starts) if len(order) else doc for f in (np.minimum, np.maximum))
            i = order[starts]
            rows, one, two = rows[i], one[i], two[i]
            token = np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").ravel()
            many = np.isin(token, frequent) if len(frequent) else np.zeros(len(rows), bool)
            few, many = np.flatnonzero(~many), np.flatnonzero(many)
            for b, j in _by_bucket(np.searchsorted(cuts, token[few], side="right") if len(cuts) else np.zeros(len(few), np.int64)):
                j = few[j]
                out.append((b, "suffixes", rows[j].tobytes() + _packed(lo[j], hi[j])))
            for o in range(BEFORE + 1) if len(many) else ():
                j = many[(rows[many, -2] >= o) & (rows[many, -1] >= WIDTH - o)]
                string = np.concatenate([rows[j, WIDTH : WIDTH + o][:, ::-1], rows[j, : WIDTH - o]], axis=1)
                w1, w2 = _lanes(string)
                for b, k in _by_bucket((w1 % np.uint64(buckets)).astype(np.int64)):
                    x = j[k]
                    out.append((b, "strings", _packed(w1[k], w2[k], one[x], two[x], lo[x], hi[x], np.full(len(x), o, np.uint8))))
            return _table(out, "bucket kind block", [pa.int32(), pa.string(), pa.binary()])

        n = 0
        for batch in batches:
            for part in slices(batch, "text", most):
                rows, row, place, differ = _suffixes(part, *bitmaps.value)
                if not len(rows):
                    continue
                ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[row]
                sub = part.column("part").to_numpy(zero_copy_only=False)[row]
                held.append((rows, ids, *_keys(rows), sub, place, differ))
                n += len(rows)
                if n > held_most:
                    yield blocks()
                    n = 0
        if held:
            yield blocks()

    def settle(group: pa.Table) -> pa.Table:
        blobs, out = group.column("block").to_pylist(), []
        if group.column("kind")[0].as_py() == "suffixes":
            rows = np.concatenate([np.frombuffer(b, np.uint8, len(b) // (ROW + 16) * ROW).reshape(-1, ROW) for b in blobs])
            lo, hi = _unpacked([b[len(b) // (ROW + 16) * ROW :] for b in blobs], "<i8 <i8")
            one, two = _keys(rows)
            order, starts = _runs(one, two)
            lo, hi = np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)
            i = order[starts]
            rows, one, two = rows[i], one[i], two[i]
            mask = _repeats(rows, lo)
        else:
            w1, w2, one, two, lo, hi, start = _unpacked(blobs, SPREAD)
            order, starts = _runs(w1, w2, one, two)
            lo, hi = np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)
            i = order[starts]
            w1, w2, one, two, start = (x[i] for x in (w1, w2, one, two, start))
            heads = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
            least = np.repeat(np.minimum.reduceat(lo, heads), np.diff(np.r_[heads, len(w1)]))
            mask = np.where(lo > least, np.uint32(1) << start.astype(np.uint32), np.uint32(0)).astype(np.uint32)
        some = np.flatnonzero(mask > 0)
        for b, k in _by_bucket((one[some] >> np.uint64(64 - keys)).astype(np.int64)):
            k = some[k]
            out.append((b, _packed(one[k], two[k], lo[k], mask[k])))
        return pa.Table.from_batches([_table(out, "bucket block", [pa.int32(), pa.binary()])])

    blocks, path = stored_at(docs.select("doc_id", "part", "text").mapInArrow(cut, "bucket int, kind string, block binary"), "suffixes", "kind")
    bitmaps.unpersist()
    settled, path2 = stored_at(blocks.filter("kind in ('suffixes', 'strings')").groupBy("kind", "bucket").applyInArrow(settle, "bucket int, block binary"), "decisions")
    discard(spark, f"{path}/kind=suffixes", f"{path}/kind=strings")
    released(spark)
    of = lambda kind: blocks.filter(F.col("kind") == kind).select("bucket", "block")
    return settled, of("occurrences"), [path, path2], buckets


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, part, and spans (pairs of unsigned 32-bit start and end, in order, apart from each other) of what goes from each text that
    loses something, and the bytes of all spans. docs has doc_id, text and part, which tells texts of one doc_id apart."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    decisions, occurrences, paths, buckets = decided(docs, size)
    # a bucket of keys with very many occurrences is dealt over several tasks, each with the first documents that any of them has and all decisions
    tasks, path = stored_at(occurrences.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("block")) / (2 * BUCKET)).cast("int").alias("tasks")), "tasks")
    paths.append(path)
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    dealt = lambda t: occurrences.join(small(t), "bucket").select("bucket", F.pmod(F.xxhash64("block"), F.col("tasks")).cast("int").alias("task"), "block")

    def firsts(group: pa.Table) -> pa.Table:
        k1, k2, doc = _unpacked(group.column("block").to_pylist(), OCCURRENCES)[:3]
        order, starts = _runs(k1, k2)
        lo, i = np.minimum.reduceat(doc[order], starts), order[starts]
        return pa.table({"bucket": group.column("bucket")[:1], "block": pa.array([_packed(k1[i], k2[i], lo, np.zeros(len(i), "<u4"))], pa.binary())})

    large = tasks.filter("tasks > 1")
    if not large.isEmpty():
        found, path = stored_at(dealt(large).groupBy("bucket", "task").applyInArrow(firsts, "bucket int, block binary"), "firsts")
        decisions = decisions.unionByName(found)
        paths.append(path)
    right = decisions.join(small(tasks), "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "block")

    def apply(occurred: pa.Table, judged: pa.Table) -> pa.Table:
        k1, k2, doc, sub, place, before, after = _unpacked(occurred.column("block").to_pylist(), OCCURRENCES)
        one, two, first, bits = _unpacked(judged.column("block").to_pylist(), DECISIONS)
        out, n = [], len(k1)
        if n:
            order, starts = _runs(np.concatenate([k1, one]), np.concatenate([k2, two]))
            lo = np.minimum.reduceat(np.concatenate([doc, first])[order], starts)
            mask = np.bitwise_or.reduceat(np.concatenate([np.zeros(n, "<u4"), bits])[order], starts)
            at = np.zeros(len(order), np.int64)
            at[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
            at, place = at[:n], place.astype(np.int64)
            later = doc > lo[at]
            found = [(doc[later], sub[later], place[later] - before[later], place[later] + after[later])]
            held = np.flatnonzero(~later & (mask[at] > 0))
            for o in range(BEFORE + 1):
                x = held[(mask[at[held]] >> np.uint32(o) & np.uint32(1)) > 0]
                found.append((doc[x], sub[x], place[x] - o, place[x] - o + WIDTH))
            doc, sub, start, end = _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
            spread = (doc.astype(np.uint64) * _M[0]) >> np.uint64(32)
            for b, j in _by_bucket((spread % np.uint64(buckets)).astype(np.int64)):
                out.append((b, _packed(doc[j], sub[j], start[j].astype("<u4"), end[j].astype("<u4"))))
        return pa.Table.from_batches([_table(out, "bucket block", [pa.int32(), pa.binary()])])

    def gather(group: pa.Table) -> pa.Table:
        doc, sub, start, end = _unpacked(group.column("block").to_pylist(), SPANS)
        doc, sub, start, end = _merged(doc, sub, start.astype(np.int64), end.astype(np.int64))
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])])
        pairs = np.stack([start, end], axis=1).astype("<u4")
        blobs = [pairs[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(doc)], strict=True)]
        return pa.table({"doc_id": pa.array(doc[cuts], pa.int64()), "part": pa.array(sub[cuts], pa.int64()), "spans": pa.array(blobs, pa.binary())})

    met = dealt(tasks).groupBy("bucket", "task").cogroup(right.groupBy("bucket", "task")).applyInArrow(apply, "bucket int, block binary")
    spans, _ = stored_at(met.groupBy("bucket").applyInArrow(gather, "doc_id long, part long, spans binary"), "spans")
    discard(spark, *paths)
    released(spark)
    return spans, spans.agg(F.sum(F.octet_length("spans").cast("long") + 64)).first()[0] or 0


def _merged(doc, sub, start, end):
    """Spans of each (doc, sub) in order, touching ones joined."""
    if not len(doc):
        return doc, sub, start, end
    order = np.lexsort((start, sub, doc))
    doc, sub, start, end = doc[order], sub[order], start[order], end[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]
    group = np.cumsum(new)
    reach = np.maximum.accumulate((group << 33) + end)
    head = new | np.r_[True, (group[1:] << 33) + start[1:] > reach[:-1]]
    cuts = np.flatnonzero(head)
    last = np.r_[cuts[1:], len(doc)] - 1
    return doc[cuts], sub[cuts], start[cuts], reach[last] - (group[last] << 33)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text; with_text adds kept (binary) and spans (pairs of 32-bit start and end)."""
    spark = docs.sparkSession
    smaller_batches(spark)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    repeated, _ = stored_at(plain.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        parted = plain.withColumn("part", F.lit(0).cast("long"))
    else:
        marked = plain.join(repeated.withColumn("again", F.lit(True)), "doc_id", "left")
        parted = marked.select("doc_id", "text", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("part"))
    spans, size = repeated_spans(parted)
    joined = parted.join(F.broadcast(spans) if size <= BROADCAST else spans.hint("shuffle_hash"), ["doc_id", "part"], "left").select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE):
                out = []
                for doc, text, blob in zip(some.column("doc_id").to_pylist(), as_bytes(some.column("text")), some.column("spans").to_pylist(), strict=True):
                    cut = np.frombuffer(blob or b"", "<u4").reshape(-1, 2).tolist()
                    kept = b"".join(text[a:b] for a, b in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(text)], strict=True))
                    row = (doc, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept, blob or b"") if with_text else row)
                names = "doc_id n_bytes n_removed n_spans kept_sha256" + " kept spans" * with_text
                yield _table(out, names, [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2 * with_text)

    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans binary" * with_text)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
