"""Alignment of two tokenizers' tokens, with corpus-wide document counts of the pairs that overlap.

Tokenizer A (byte-level BPE, of the tokenizers library) takes a space and the
text, tokenizer B (a SentencePiece BPE model) the text, to which it adds the
space. Bytes at which tokens of both end cut a text into groups, and tokens of
A and B link where their bytes overlap.

Where tokens of neither can reach over a place (from a character that is no white
space to a space or line end, between letters and the marks that end a word), by the tokenizers'
settings and vocabularies, texts are cut into units; a unit's tokens, groups and links are made once
and remembered by bytes in two generations.

Counts: a first pass over documents gives sorted blocks of distinct pairs with
their documents. Merged in a tree, they are the distinct pairs, which get a
minimal perfect hash, shard by shard: levels of bits that just one key hits, an
index being a bit's rank. Blocks are then added into dense count vectors at those
indexes, the key kept there being verified, and the vectors are summed in a tree. The
first pass also writes the aligned documents, slice by slice, as places of units and
pairs; the second looks the pairs up in all shards broadcast, if they are within a
bound. Else it aligns the documents again and joins.

Cases: texts null, empty, or whose tokens' bytes aren't the space and the text
have zeros and an empty digest; the strings of special tokens are plain text;
texts of any length are taken whole; each row counts as a document of its own, whatever its
doc_id (null and repeated ones included); an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, keep_cache, only_cache, released, slices, smaller_batches, stored_at
from .piece_merges import SPACE, default_model

#: Bytes of units that a worker remembers, an entry counting as ENTRY bytes beside them.
CACHE_BYTES, ENTRY = 224 << 20, 270
#: Entries of a block of pairs, of a shard (about); vectors or blocks that one step of a tree joins; pairs that are broadcast at most.
BLOCK, SHARD, FAN, BROADCAST_PAIRS = 1 << 20, 1 << 20, 16, 4_000_000
SLICE = 2 << 20

#: Letters that make simple words: A-Z, and those of Latin-1 and its extensions, all of them letters to any tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def default_bytes() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_values() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte. Printable bytes stand for themselves, the others for those from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _gather(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some rows of a ragged array, end to end, and where each row's start."""
    n = starts[rows + 1] - starts[rows]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[rows] - (ends - n), n) + np.arange(int(n.sum()))], np.r_[0, ends]


class Units:
    """Units with their number of tokens of A and B, groups and links, whether their tokens spell them, their groups as text, and their links (A id << 32 | B id)."""

    def __init__(self, numbers=None, spelt=None, links=None, starts=None, groups=None):
        self.numbers = np.zeros((0, 4), np.int64) if numbers is None else numbers
        self.spelt = np.zeros(0, bool) if spelt is None else spelt
        self.links, self.starts = (np.zeros(0, "<u8"), np.zeros(1, np.int64)) if links is None else (links, starts)
        self.groups: list[bytes] = [] if groups is None else groups

    def some(self, rows: np.ndarray) -> Units:
        links, starts = _gather(self.links, self.starts, rows)
        return Units(self.numbers[rows], self.spelt[rows], links, starts, [self.groups[i] for i in rows.tolist()])

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        base = np.cumsum([0, *(len(p.links) for p in parts)])
        starts = np.concatenate([p.starts[:-1] + b for p, b in zip(parts, base[:-1], strict=True)] + [base[-1:]])
        groups = parts[0].groups  # of a generation's own, which grows in place
        for p in parts[1:]:
            groups += p.groups
        return Units(np.concatenate([p.numbers for p in parts]), np.concatenate([p.spelt for p in parts]), np.concatenate([p.links for p in parts]), starts, groups)


class Generation:
    """Remembered units: the place of each, and what belongs to the places, in parts that are joined as they grow."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.units, self.held = Units(), 0
        self.late: list[Units] = []

    def add(self, words: list[str], units: Units) -> None:
        first = len(self.place)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.late.append(units)
        self.held += sum(map(len, words)) + sum(map(len, units.groups)) + units.links.nbytes + ENTRY * len(words)

    def whole(self) -> Units:
        if self.late:
            self.units, self.late = Units.joined([self.units, *self.late]), []
        return self.units


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            settings = json.load(f)
        model = pb.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        split, spec, kinds = settings.get("pre_tokenizer") or {}, model.normalizer_spec, pb.ModelProto.SentencePiece
        own = [p.piece for p in model.pieces if p.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN)]
        if settings["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("a byte-level BPE without prefix space and a SentencePiece model that adds one and keeps white space are needed")
        value = byte_values()
        self.spell_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.spell_a[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.spell_b = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in s], np.int64) for s in (self.spell_a, self.spell_b))
        self.digits = np.array([b"%d" % i for i in range(max(len(self.spell_a), len(self.spell_b)))], object)
        # by their settings: A parts white space, letters and marks from each other; B's pieces hold spaces in front only and no line ends
        apart = split.get("use_regex", True) and not settings.get("normalizer") and not spec.precompiled_charsmap and model.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.line = self.b.piece_to_id("<0x0A>")
        apart = apart and self.b.is_byte(self.line) and not any("\n" in p or SPACE in p.lstrip(SPACE) for p in own) and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        marks = "".join(m for m in ".,;:!?" if not any(re.search(rf"[^\W\d_]{re.escape(m)}", p) for p in own))
        run = r"[ \n]*[^ \n]+(?:(?<=\s)[ \n]+[^ \n]*)*|[ \n]+"
        word, mark = rf"[{LETTERS}]+(?=[{marks}]*(?:[ \n]|\Z))" if marks else rf"[{LETTERS}]+(?=[ \n]|\Z)", rf"|(?<=[{LETTERS}])[{marks}]+(?=[ \n]|\Z)" if marks else ""
        # a space and letters, a line end by itself, letters after it, marks after letters; whatever else goes up to the next white space
        self.split = re.compile(rf"(?<!\s) {word}|(?<!\s)\n(?=\S)|(?<=\S\n){word}{mark}|{run}" if apart else r"(?s).+")
        self.simple = re.compile(rf" ?[{LETTERS}]+|[{marks}]+" if marks else rf" ?[{LETTERS}]+") if apart else None
        self.break_a = self.a.encode("\n", add_special_tokens=False).ids
        self.space_b = self.b.piece_to_id(SPACE)
        self.forget()

    def forget(self) -> None:
        self.young, self.old = Generation(), Generation()

    def units(self, text: str) -> list[str]:
        return self.split.findall(" " + text) if text else []

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """The ids of units as they stand in a text: a unit's first space is the one that the model adds; any other is encoded behind a line end."""
        out = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        return [x if u[0] == " " and len(u) > 1 else [self.space_b] if u == " " else x[2:] for u, x in zip(units, out, strict=True)]

    def _flat(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B of units, end to end, and how many each unit has."""
        if self.simple is None:
            ids = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)], self._ids_b(units)
            return *(np.array([i for x in y for i in x], np.int64) for y in ids), *(np.array([len(x) for x in y], np.int64) for y in ids)
        # simple units are encoded as lines of one text
        text = "\n" + "\n".join(units) + "\n"
        out = []
        for ids, cut in ((self.a.encode(text, add_special_tokens=False).ids, self.break_a[0]), (self.b.encode(text)[1:], self.line)):
            ids = np.array(ids, np.int64)
            at = np.flatnonzero(ids == cut)
            out.append((ids[ids != cut], np.diff(at) - 1))
        (a, n_a), (b, n_b) = out
        return a, b, n_a, n_b

    def known(self, words: set[str]) -> Generation:
        """The remembered units, among them all the given ones."""
        if self.young.held > CACHE_BYTES // 2:
            self.old, self.young = self.young, Generation()
        young, old = self.young, self.old
        missing = [u for u in words if u not in young.place]
        again = [u for u in missing if u in old.place]
        if again:
            young.add(again, old.whole().some(np.fromiter(map(old.place.__getitem__, again), np.int64, len(again))))
        new = [u for u in missing if u not in old.place] if again else missing
        plain = [u for u in new if self.simple is not None and self.simple.fullmatch(u)]
        for i in range(0, len(plain), 4000):
            part = plain[i : i + 4000]
            young.add(part, self._made(part, *self._flat(part)))
        rest = [u for u in new if self.simple is None or not self.simple.fullmatch(u)]
        for i in range(0, len(rest), 4000):
            part = rest[i : i + 4000]
            ids = [e.ids for e in self.a.encode_batch(part, add_special_tokens=False)], self._ids_b(part)
            young.add(part, self._made(part, *(np.array([i for x in y for i in x], np.int64) for y in ids), *(np.array([len(x) for x in y], np.int64) for y in ids)))
        return young

    def _made(self, words: list[str], flat_a: np.ndarray, flat_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Units:
        raw = [u.encode("utf-8", "replace") for u in words]
        size = np.array([len(x) for x in raw], np.int64)
        first_a, first_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        total = lambda sizes, first: np.diff(np.r_[0, np.cumsum(sizes)][first])
        spelt = (total(self.size_a[flat_a], first_a) == size) & (total(self.size_b[flat_b], first_b) == size)
        whole = b"".join(raw)
        if not spelt.all() or b"".join([self.spell_a[i] for i in flat_a.tolist()]) != whole or b"".join([self.spell_b[i] for i in flat_b.tolist()]) != whole:
            for k, r in enumerate(raw):
                spelt[k] = all(b"".join([s[i] for i in f[first[k] : first[k + 1]].tolist()]) == r for s, f, first in ((self.spell_a, flat_a, first_a), (self.spell_b, flat_b, first_b)))
            good = np.flatnonzero(spelt)
            if len(good) < len(words):
                part = [words[k] for k in good.tolist()]
                made = self._made(part, _gather(flat_a, first_a, good)[0], _gather(flat_b, first_b, good)[0], n_a[good], n_b[good]) if len(good) else Units()
                place = np.cumsum(spelt) - 1
                numbers = np.where(spelt[:, None], made.numbers[place], 0) if len(good) else np.zeros((len(words), 4), np.int64)
                groups = [made.groups[p] if ok else b"" for p, ok in zip(place.tolist(), spelt.tolist(), strict=True)]
                return Units(numbers, spelt, made.links, np.r_[0, np.cumsum(numbers[:, 3])], groups)
        # units end to end are one text, in which tokens of both kinds end together where units end
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        start_a, start_b = end_a - self.size_a[flat_a], end_b - self.size_b[flat_b]
        lo, hi = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
        n = hi - lo
        of = np.repeat(np.arange(len(flat_a)), n)
        linked = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        links = (flat_a[of].astype("<u8") << np.uint64(32)) | flat_b[linked].astype("<u8")
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        # both kinds of tokens in the groups' order, each with the sign that follows it
        side = np.repeat([0, 1], [len(flat_a), len(flat_b)])
        group = np.r_[np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)]
        order = np.argsort(2 * group + side, kind="stable")
        side, group = side[order], group[order]
        sign = np.where(np.r_[group[1:] != group[:-1], True], 2, np.where(np.r_[side[1:] != side[:-1], True], 1, 0))
        text = np.empty(2 * len(order), object)
        text[::2], text[1::2] = self.digits[np.r_[flat_a, flat_b][order]], np.array([b",", b"|", b";"], object)[sign]
        text = text.tolist()
        at = (2 * (first_a + first_b)).tolist()
        groups = [b"".join(text[i : j - 1]) for i, j in zip(at[:-1], at[1:], strict=True)]
        ends = np.cumsum(size)
        of_l = np.r_[0, np.cumsum(n)][first_a]
        numbers = np.stack([n_a, n_b, np.diff(np.r_[0, np.searchsorted(cuts, ends, side="right")]), np.diff(of_l)], axis=1)
        return Units(numbers, spelt, links, of_l, groups)

    def aligned(self, texts: list[bytes]) -> tuple[Units, list[np.ndarray]]:
        """The distinct units of some texts and each text's units as places among them; texts that tokens don't spell have none."""
        split = [self.units(x.decode("utf-8", "replace")) for x in texts]
        place = self.young.place
        flat = [place.get(u) for us in split for u in us]
        if None in flat or self.young.held > CACHE_BYTES // 2:
            place = self.known({u for us in split for u in us}).place
            flat = [place[u] for us in split for u in us]
        distinct, back = np.unique(np.array(flat, np.int64), return_inverse=True)
        units = self.young.whole().some(distinct)
        docs = np.split(back, np.cumsum([len(us) for us in split])[:-1]) if split else []
        none = np.zeros(0, np.int64)
        return units, docs if units.spelt.all() else [d if units.spelt[d].all() else none for d in docs]


_ALIGNERS: dict[tuple, Aligner] = {}


def _forget() -> None:
    for x in _ALIGNERS.values():
        x.forget()


def aligner(paths: tuple[str, str]) -> Aligner:
    only_cache("alignment")
    keep_cache("alignment", _forget)
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _in_documents(units: Units, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct pair of each document: the document's place, the pair's place, and how many links it is; and the distinct pairs."""
    n = len(units.groups)
    pairs, number = np.unique(units.links, return_inverse=True)
    # how often each document has each unit
    both = np.repeat(np.arange(len(docs)), [len(d) for d in docs]) * n + (np.concatenate(docs) if docs else np.zeros(0, np.int64))
    both, times = np.unique(both, return_counts=True)
    of, unit = both // max(n, 1), both % max(n, 1)
    found, starts = _gather(number, units.starts, unit)
    sizes = np.diff(starts)
    key, back = np.unique(np.repeat(of, sizes) * len(pairs) + found, return_inverse=True)
    weight = np.bincount(back, np.repeat(times, sizes), len(key)).astype(np.int64)
    return key // max(len(pairs), 1), key % max(len(pairs), 1), weight, pairs


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = (keys ^ np.uint64(0x632BE59BD9B4E019 * (level + 1) & (1 << 64) - 1)) * _M[0]
    h ^= h >> np.uint64(31)
    h *= _M[1]
    h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct keys, about three bits each: a key's index is the rank of its bit in its level."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.cumsum(counts) - counts

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        while len(left):
            size = max(64, -(-len(left) // 64) * 64)
            at = _level(left, len(sizes), size)
            n = np.bincount(at, minlength=size)
            words.append(np.packbits(n == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[n[at] != 1]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Indexes; for other keys than those hashed any index, or -1."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _level(keys[left], level, size)
            word, bit = self.words[base + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.ranks[base + (at[hit] >> 6)] + below[hit]
            left, base = left[~hit], base + size // 64
        return out

    def written(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<i8").tobytes() + self.words.tobytes()

    @classmethod
    def read(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        return cls(np.frombuffer(blob, "<i8", n, 8).tolist(), np.frombuffer(blob, "<u8", offset=8 * n + 8))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys ^ (keys >> np.uint64(30))) * _M[2] >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _tree(rows: DataFrame, nodes: int, join, schema: str) -> DataFrame:
    """rows (shard, node, ...) joined by groups of at most FAN nodes, level by level, until each shard has one."""
    while True:
        rows = rows.groupBy("shard", "node").applyInArrow(join, schema)
        if nodes <= 1:
            return rows
        nodes = -(-nodes // FAN)
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN).cast("int"))


def _u8(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


ALIGNED = "docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, groups: string>>, lengths binary, units binary, sizes binary, links binary, pairs binary"
BLOCKS = "block long, n long, keys binary, counts binary"


def _small_ints(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as many bytes each as the largest needs; the first byte says how many."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def aligned_and_counted(docs: DataFrame, paths: tuple[str, str], with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Shards of the distinct pairs that documents hold linked: shard, n, hash, keys and counts (documents of each pair), both in the hash's order;
    and the aligned documents, a row a slice of a task's texts: its documents, their units as places among the slice's, and the units' links as places among its pairs."""
    spark = docs.sparkSession
    doc = pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", pa.string())])
    shape = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.list_(doc)), *((c, pa.binary()) for c in ("lengths", "units", "sizes", "links", "pairs"))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, part = aligner(paths), [], TaskContext.get().partitionId()

        def joined():
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype("<u8")
            held[:] = [(keys, n)]
            return len(keys)

        def row(**given):
            return pa.RecordBatch.from_arrays([pa.array([given.get(f.name)], f.type) for f in shape], schema=shape)

        def aligned_slice(some: pa.RecordBatch, units: Units, texts: list[np.ndarray], pairs: np.ndarray):
            own, groups = _digests(units, texts)
            made = _batch(some, own, groups, with_groups).to_pylist()
            flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
            places = np.searchsorted(pairs, units.links)
            return row(docs=made, lengths=_small_ints(np.array([len(t) for t in texts], np.int64)), units=_small_ints(flat), sizes=_small_ints(np.diff(units.starts)), links=_small_ints(places), pairs=pairs.tobytes())

        def block(number: int):
            (keys, n) = held.pop()
            return row(block=part * 10_000 + number, n=len(keys), keys=keys.tobytes(), counts=n.tobytes())

        number = entries = 0
        for batch in batches:
            for some in slices(batch, "text", SLICE):
                units, texts = own.aligned(as_bytes(some.column("text")))
                _, pair, _, pairs = _in_documents(units, texts)
                yield aligned_slice(some, units, texts, pairs)
                held.append((pairs, np.bincount(pair, minlength=len(pairs))))
                held[-1] = held[-1][0][held[-1][1] > 0], held[-1][1][held[-1][1] > 0]
                entries += len(pairs)
                if entries > 2 * BLOCK:
                    entries = joined()
                    if entries > BLOCK:
                        yield block(number)
                        number, entries = number + 1, 0
        if held and joined():
            yield block(number)

    both, path = stored_at(docs.select("doc_id", "text").mapInArrow(blocks, f"{BLOCKS}, {ALIGNED}"), "pair-blocks")
    found = both.filter("block is not null").select("block", "n", "keys", "counts")
    of, entries, most = found.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    # sizes only: shards and nodes of a tree by what the blocks hold
    shards, nodes = max(1, -(-min(entries or 0, FAN * (most or 0)) // SHARD)), max(1, -(-of // FAN))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys, n in zip(batch.column("block").to_pylist(), _u8(batch.column("keys")), _u8(batch.column("counts")), strict=True):
                to = _shard(keys, shards)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(shards + 1))
                for s in range(shards):
                    i = order[cuts[s] : cuts[s + 1]]
                    if len(i):
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "node": pa.array([number * 2_654_435_761 % 4_294_967_291 % nodes], pa.int32()), "keys": pa.array([keys[i].tobytes()], pa.binary()), "counts": pa.array([n[i].tobytes()], pa.binary())})

    parts = found.mapInArrow(dealt, "shard int, node int, keys binary, counts binary")

    def distinct(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group.column("shard")[:1], "node": group.column("node")[:1], "keys": pa.array([np.unique(np.concatenate(_u8(group.column("keys")))).tobytes()], pa.binary())})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, keys in zip(batch.column("shard").to_pylist(), _u8(batch.column("keys")), strict=True):
                made = PerfectHash.of(keys)
                ordered = np.zeros(len(keys), "<u8")
                ordered[made.index(keys)] = keys
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "hash": pa.array([made.written()], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary())})

    whole = _tree(parts.select("shard", "node", "keys"), nodes, distinct, "shard int, node int, keys binary")
    hashes, path2 = stored_at(whole.select("shard", "keys").mapInArrow(hashed, "shard int, n long, hash binary, keys binary"), "pair-hashes")

    def added(group: pa.Table, own: pa.Table) -> pa.Table:
        made, keys = PerfectHash.read(own.column("hash")[0].as_py()), np.frombuffer(own.column("keys")[0].as_py(), "<u8")
        total = np.zeros(len(keys), "<u8")
        for some, n in zip(_u8(group.column("keys")), _u8(group.column("counts")), strict=True):
            at = made.index(some)
            if not (keys[at] == some).all():
                raise RuntimeError("a counted pair is not the hashed one")
            total[at] += n
        return pa.table({"shard": own.column("s")[:1], "node": own.column("m")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    def summed(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group.column("shard")[:1], "node": group.column("node")[:1], "counts": pa.array([np.sum(_u8(group.column("counts")), axis=0).astype("<u8").tobytes()], pa.binary())})

    at_nodes = parts.select(F.col("shard").alias("s"), F.col("node").alias("m")).distinct().join(hashes.select(F.col("shard").alias("s"), "hash", "keys"), "s")
    vectors = parts.groupBy("shard", "node").cogroup(at_nodes.groupBy("s", "m")).applyInArrow(added, "shard int, node int, counts binary")
    total = _tree(vectors.withColumn("node", F.floor(F.col("node") / FAN).cast("int")), -(-nodes // FAN), summed, "shard int, node int, counts binary")
    out, _ = stored_at(hashes.join(total.select("shard", "counts"), "shard"), "pair-counts")
    discard(spark, path2)
    released(spark)
    return out, both.filter("block is null").drop("block", "n", "keys", "counts")


def pair_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The shards of counts alone."""
    return aligned_and_counted(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), paths)[0]


def _unshard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, n in zip(_u8(batch.column("keys")), _u8(batch.column("counts")), strict=True):
            for i in range(0, len(keys), 1 << 17):
                k = keys[i : i + (1 << 17)]
                yield pa.RecordBatch.from_pydict({"key": pa.array(k.astype(np.int64)), "a": pa.array((k >> np.uint64(32)).astype(np.int64)), "n": pa.array(n[i : i + (1 << 17)].astype(np.int64))})


def pair_table(counts: DataFrame) -> DataFrame:
    """a and b (ids of the two tokenizers), and the documents n that hold them linked, from shards of counts."""
    return counts.select("keys", "counts").mapInArrow(_unshard, "key long, a long, n long").select("a", F.col("key").bitwiseAND(0xFFFFFFFF).alias("b"), "n")


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


def align_tokens(docs: DataFrame, a: str | None = None, b: str | None = None, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text; with_groups adds the groups as text."""
    spark = docs.sparkSession
    smaller_batches(spark)
    paths = a or default_bytes(), b or default_model()
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts, aligned = aligned_and_counted(plain, paths, with_groups)
    # a row for each id of A at most
    best = counts.select("keys", "counts").mapInArrow(_unshard, "key long, a long, n long").groupBy("a").agg(F.max("n").alias("most"))
    if (counts.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_PAIRS:
        shards = sorted(counts.select("shard", "hash", "keys", "counts").toLocalIterator(), key=lambda r: r.shard)
        of = best.toArrow()
        most = np.zeros(max(of.column("a").to_pylist(), default=0) + 1, np.int64)
        most[of.column("a").to_numpy()] = of.column("most").to_numpy()
        return _looked_up(aligned, spark.sparkContext.broadcast(([(bytes(r.hash), bytes(r.keys), bytes(r.counts)) for r in shards], counts.agg(F.max("shard")).first()[0] or 0, most)), with_groups)
    return _joined(plain, paths, counts, best, with_groups)


def _digests(units: Units, texts: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """n_a, n_b, n_groups and n_links, and the groups, of each text."""
    own = np.array([units.numbers[t].sum(axis=0) for t in texts], np.int64).reshape(-1, 4)
    return own, [b";".join([units.groups[i] for i in t.tolist()]) for t in texts]


def _batch(some: pa.RecordBatch, own: np.ndarray, groups: list[bytes], with_groups: bool, **more) -> pa.RecordBatch:
    columns = {"doc_id": some.column("doc_id")} | {c: pa.array(own[:, i], pa.int64()) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))} | more
    columns["groups_sha256"] = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())
    return pa.RecordBatch.from_pydict(columns | ({"groups": pa.array([g.decode() for g in groups], pa.string())} if with_groups else {}))


def _looked_up(aligned: DataFrame, sent, with_groups: bool) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, last, most = sent.value
        shards = [(PerfectHash.read(h), np.frombuffer(k, "<u8"), np.frombuffer(n, "<u8")) for h, k, n in blobs]
        for batch in batches:
            for at_row in range(batch.num_rows):
                cell = lambda c, i=at_row, b=batch: b.column(c)[i].as_py()
                pairs, lengths, units, sizes, number = np.frombuffer(cell("pairs"), "<u8"), *(_ints(cell(c)) for c in ("lengths", "units", "sizes", "links"))
                n, to = np.zeros(len(pairs), np.int64), _shard(pairs, last + 1)
                for s, (made, keys, counted) in enumerate(shards):
                    i = np.flatnonzero(to == s)
                    at = made.index(pairs[i])
                    good = (at >= 0) & (keys[at] == pairs[i])  # a pair of a text that tokens don't spell may be no key
                    n[i[good]] = counted[at[good]].astype(np.int64)
                top = most[np.minimum((pairs >> np.uint64(32)).astype(np.int64), len(most) - 1)]
                is_best = (n > 0) & (n == top)
                # sums of each unit, then of each text: differences of running totals, which whole numbers allow
                totals = []
                for x in (is_best.astype(np.int64), n):
                    of_unit = np.diff(np.r_[0, np.cumsum(x[number])][np.r_[0, np.cumsum(sizes)]])
                    totals.append(np.diff(np.r_[0, np.cumsum(of_unit[units])][np.r_[0, np.cumsum(lengths)]]))
                docs = batch.column("docs").slice(at_row, 1).flatten()
                own = dict(zip((f.name for f in docs.type), docs.flatten(), strict=True))
                names = [c.split()[0] for c in schema.split(", ")]
                own |= {"n_best": pa.array(totals[0], pa.int64()), "count_sum": pa.array(totals[1], pa.int64())}
                yield pa.RecordBatch.from_arrays([own[c] for c in names], names)

    schema = OUT + ", n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return aligned.mapInArrow(look, schema)


def _joined(docs: DataFrame, paths: tuple, counts: DataFrame, best: DataFrame, with_groups: bool) -> DataFrame:
    """The same by a join on pairs, for more of them than can be broadcast."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(paths), TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch, "text", SLICE):
                units, texts = own.aligned(as_bytes(some.column("text")))
                doc, pair, weight, pairs = _in_documents(units, texts)
                offsets = pa.array(np.searchsorted(doc, np.arange(some.num_rows + 1)), pa.int32())
                lists = {"keys": pa.ListArray.from_arrays(offsets, pa.array(pairs[pair].astype(np.int64))), "links": pa.ListArray.from_arrays(offsets, pa.array(weight, pa.int64()))}
                yield _batch(some, *_digests(units, texts), with_groups, row=pa.array(np.arange(row, row + some.num_rows), pa.int64()), **lists)
                row += some.num_rows

    rows, _ = stored_at(docs.mapInArrow(listed, OUT + ", row long, keys array<long>, links array<long>, groups_sha256 string" + ", groups string" * with_groups), "aligned")
    flat = counts.select("keys", "counts").mapInArrow(_unshard, "key long, a long, n long").join(best, "a").select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    pairs = rows.select("row", F.explode(F.arrays_zip("keys", "links")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.links").alias("links"))
    sums = pairs.join(flat, "key").groupBy("row").agg(F.sum(F.col("links") * F.col("best")).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *["groups"] * with_groups)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
