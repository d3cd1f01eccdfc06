"""SentencePiece encoding by vectorised merge rounds, and decoding.

A text becomes words that no piece can reach across; the distinct words of a
batch become one flat array of symbols. In each round every word finds its
best-ranked adjacent pair and merges it, at its leftmost place, or at all its
places left to right if no piece made from the merged one ranks better;
arrays are then compacted, and words without a pair leave, until none remains.
Characters outside the vocabulary fall back to byte pieces.

Cases: null and empty texts give no ids and decode to an empty text; texts of
any length are encoded whole; repeated rows are encoded each."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices

#: Bytes of words and their ids that a worker remembers at most, an entry counting as ENTRY bytes beside them.
CACHE_BYTES, ENTRY = 128 << 20, 110
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class MergeCoder:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or any(p.type in (kinds.UNUSED, kinds.USER_DEFINED) for p in model.pieces):
            raise ValueError("only BPE models with identity normalisation and neither unused nor user-defined pieces are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.words: dict[str, bytes] = {}
        self.held = 0
        pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        # a symbol is a normal piece, by its id, or a character that only occurs inside pieces, by a number beyond
        symbol = {pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in pieces[i]} - symbol.keys()):
            symbol[c] = len(pieces) + len(symbol)
        self.symbol = symbol
        scores = np.array([p.score for p in model.pieces])
        rank_of = np.searchsorted(np.unique(-scores[normal]), -scores)
        self.base = max(symbol.values()) + 2
        pairs = {}
        for i in normal:
            s = pieces[i]
            for k in range(1, len(s)):
                a, b = symbol.get(s[:k]), symbol.get(s[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.ranks = rank_of[self.merged].astype(np.int64)
        # merging all places at once is safe if nothing made from the merged piece ranks better than it
        best_made = np.full(self.base, np.iinfo(np.int64).max)
        np.minimum.at(best_made, keys // self.base, self.ranks)
        np.minimum.at(best_made, keys % self.base, self.ranks)
        own = np.full(self.base, -1, np.int64)
        own[self.merged] = self.ranks
        self.safe = best_made > own
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        if len(self.byte) not in (0, 256):
            raise ValueError("byte pieces are incomplete")
        self.size = len(pieces)
        # words end where no piece can go on: before a space after another character, and at line ends
        if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
            self.split = re.compile(r"(?s).+")
        elif any("\n" in pieces[i] for i in normal):
            self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.split = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        text = [b""] * self.size
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                text[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                text[i] = (model.trainer_spec.unk_surface or " ⁇ ").encode()
        self.text = np.array(text, object)
        self.digits = np.array([str(i).encode() for i in range(self.size)], object)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the pair table of each pair of symbols; -1 if there is none."""
        key = np.where((left >= 0) & (right >= 0), left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        get = self.symbol.get
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        joined = "".join(words)
        codes = np.fromiter((get(c, -1) for c in joined), np.int64, len(joined))
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(joined))  # of a symbol's first character in joined
        word = np.repeat(np.arange(len(words)), lengths)
        done_codes, done_place = [], []
        none = np.iinfo(np.int64).max
        del first
        while len(codes):
            found = self._pairs(codes[:-1], codes[1:])
            found[word[:-1] != word[1:]] = -1
            rank = np.where(found >= 0, self.ranks[found], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(np.r_[rank, none], starts)
            live = least < none
            if not live.all():
                keep = np.repeat(live, np.diff(np.r_[starts, len(codes)]))
                done_codes.append(codes[~keep])
                done_place.append(place[~keep])
                codes, place, word = codes[keep], place[keep], word[keep]
                continue
            per_word = np.repeat(least, np.diff(np.r_[starts, len(codes)]))
            hit = np.flatnonzero(rank == per_word[:-1])
            # the leftmost place of each word; where safe, every second one of a run of overlapping places
            head = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            broken = np.r_[True, (hit[1:] != hit[:-1] + 1) | head[1:]]
            run_start = np.maximum.accumulate(np.where(broken, np.arange(len(hit)), 0))
            even = (np.arange(len(hit)) - run_start) % 2 == 0
            into = self.merged[found[hit]]
            safe_word = np.minimum.reduceat(self.safe[into], np.flatnonzero(head))
            take = head | (even & np.repeat(safe_word, np.diff(np.r_[np.flatnonzero(head), len(hit)])))
            at = hit[take]
            codes[at] = into[take]
            keep = np.ones(len(codes), bool)
            keep[at + 1] = False
            codes, place, word = codes[keep], place[keep], word[keep]
        if not done_codes:
            return [b""] * len(words)
        codes, place = np.concatenate(done_codes), np.concatenate(done_place)
        order = np.argsort(place)
        codes, place = codes[order], place[order]
        cuts = np.searchsorted(place, np.r_[0, np.cumsum(lengths)])
        odd = (codes < 0) | (codes >= self.size)  # characters that are no piece
        if odd.any():
            spread = [[int(c)] if not o else ([self.byte[b] for b in joined[p].encode()] if self.byte else [self.unknown]) for c, p, o in zip(codes.tolist(), place.tolist(), odd.tolist(), strict=True)]
            sizes = np.r_[0, np.cumsum([len(x) for x in spread])]
            codes, cuts = np.array([i for x in spread for i in x], np.int64), sizes[cuts]
        flat = codes.astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split.findall(self.prefix + x.replace(" ", SPACE)) if x else [] for x in texts]
        if self.held > CACHE_BYTES:
            self.words.clear()
            self.held = 0
        known = self.words
        if new := list(dict.fromkeys(w for ws in split for w in ws if w not in known)):
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                found = self.merge_words(part)
                known.update(zip(part, found, strict=True))
                self.held += sum(map(sys.getsizeof, part)) + sum(map(sys.getsizeof, found)) + ENTRY * len(part)
        out = [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4") for ws in split]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.text[ids].tolist()).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") and len(ids) and self.text[ids[0]].startswith(b" ") else text


_CODERS: dict[str, MergeCoder] = {}


def coder(path: str) -> MergeCoder:
    """This worker's coder; its cache of words lives on from task to task."""
    if path not in _CODERS:
        _CODERS[path] = MergeCoder(path)
    return _CODERS[path]


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id with ids (array<int>) of every whole text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = coder(path).encode([x.decode("utf-8", "replace") for x in as_bytes(part.column("text"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype("<i4") for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of each row's ids."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                text = [coder(path).decode(np.array(x or [], np.int64)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = coder(path)
                found = own.encode([x.decode("utf-8", "replace") for x in as_bytes(part.column("text"))])
                of_ids = [hashlib.sha256(b",".join(own.digits[x].tolist())).hexdigest() for x in found]
                of_text = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
