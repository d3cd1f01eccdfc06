"""Token ids of whole texts by the tokenizers library, with a bounded cache of words."""

from __future__ import annotations

import json
import os
from itertools import compress

import numpy as np

from .common import keep_cache, only_cache

#: Bytes of words and their ids that a worker remembers at most, an entry counting as ENTRY bytes beside them.
CACHE_BYTES, ENTRY = 160 << 20, 170
#: Words handed to the library as one text.
JOINED = 200
#: Marks that may stand behind a word's letters.
MARKS = r"""!"#$%&()*+,-./:;=?@[\]^_`{}~"""
#: The tokenizer settings under which a run of such letters is one unit whatever stands around it.
LOWERING = ["NFC", "Replace", "Lowercase"]
LETTER_RUNS = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    If the tokenizer never lets a token reach over ASCII white space (it is
    probed for that once), each distinct word is encoded once and remembered;
    otherwise whole texts go to the library. Words are remembered in two
    generations of half the bytes each: when the younger is full it becomes the
    older, and only words met again move on, so memory stays bounded however
    long or many the words are, and frequent ones aren't learnt anew."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        self.plain, self.ends = self._plain(path)
        probe = ["The cat, it's 12 o'clock.", "Ünï 中文 x"]
        parts = [self._ids(w) for x in probe for w in x.split(" ")]
        self.by_word = all(self._ids(sep.join(probe)) == sum((self._ids(x) for x in probe), []) for sep in (" ", "\n", "\t ", "  \r\n")) and sum(parts, []) == self._ids(" ".join(probe)) and not self._ids(" \t\n\r\x0b\x0c")

    @staticmethod
    def _plain(path: str):
        """The same vocabulary without normalising and splitting, for lower-case letter runs, and which ids end a unit (null if that can't be told);
        null where letter runs aren't units."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        normal, split = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
        steps = [x["type"] for x in normal.get("normalizers", [])]
        first = next(iter(split.get("pretokenizers", [])), {})
        if steps != LOWERING or not first.get("pattern", {}).get("Regex", "").endswith(LETTER_RUNS):
            return None, None
        settings["normalizer"] = None
        settings["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        ends, suffix = None, settings["model"].get("end_of_word_suffix")
        if suffix:
            vocabulary = settings["model"]["vocab"]
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return Tokenizer.from_str(json.dumps(settings)), ends

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        if self.plain is None:
            return self._keep(words, self._encoded(self.library, [w.decode("utf-8", "replace") for w in words]))
        # lower-case ASCII letters are a stem as they stand
        lower = [w for w in words if w.islower() and w.isalpha()]
        self._keep(lower, self._encoded(self.plain, b" ".join(lower).decode().split(), self.ends))
        if len(lower) == len(words):
            return
        known, before = self.words, self.older
        words = [w for w in words if w not in known]
        text = b"\n".join(words).decode("utf-8", "replace")
        lower = text.lower().split("\n")
        stems = [x.rstrip(MARKS) for x in lower]
        # letters up to ÿ are left alone by composition and have one lower-case form
        narrow = text.isascii() or all(x <= "ÿ" for x in set(text))
        plain = [x.isalpha() and (narrow or x.isascii() or max(x) <= "ÿ") for x in stems]
        if not all(plain):
            rest = [w for w, ok in zip(words, plain, strict=True) if not ok]
            self._keep(rest, self._encoded(self.library, [w.decode("utf-8", "replace") for w in rest]))
            words, lower, stems = (list(compress(x, plain)) for x in (words, lower, stems))
        keys = "\n".join(stems).encode().split(b"\n") if stems else []
        if new := {key: stem for key, stem in zip(keys, stems, strict=True) if key not in known}:
            if again := [key for key in new if key in before]:
                self._keep(again, [before[key] for key in again])
                new = {key: stem for key, stem in new.items() if key not in before}
            self._keep(list(new), self._encoded(self.plain, list(new.values()), self.ends))
        marks = {x: np.array(self._ids(x), "<u4").tobytes() for x in {x[len(stem) :] for x, stem in zip(lower, stems, strict=True)}}
        dressed = {w: known[key] + marks[x[len(stem) :]] for w, key, x, stem in zip(words, keys, lower, stems, strict=True) if w != key}
        self._keep(list(dressed), list(dressed.values()))

    def _keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.words.update(zip(words, ids, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)

    def _encoded(self, library, texts: list[str], ends: np.ndarray | None = None) -> list[bytes]:
        """The ids of each of the words, which go to the library JOINED at a time; ends tells them apart, or else the library's offsets."""
        out: list[bytes] = []
        for i in range(0, len(texts), JOINED):
            part = texts[i : i + JOINED]
            cuts = ids = np.zeros(0, "<u4")
            if ends is not None:  # without offsets, which take the library longer
                ids = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.r_[0, np.flatnonzero(ends[ids]) + 1]
            if len(cuts) != len(part) + 1:
                found = library.encode(" ".join(part), add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                starts = np.cumsum([0, *(len(x) + 1 for x in part)])
                cuts = np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64, len(ids)), starts)
            flat, cuts = ids.tobytes(), (4 * cuts).tolist()
            out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _meet(self, words: list[bytes]) -> None:
        """Makes the given words known: from the older generation, else from the library."""
        if self.held > CACHE_BYTES // 2:
            self.older, self.words, self.held = self.words, {}, 0
        again = [w for w in words if w in self.older]
        self._keep(again, [self.older[w] for w in again])
        if new := [w for w in words if w not in self.older] if again else words:
            self._learn(new)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]
        split = [x.split() for x in texts]
        get = self.words.get
        found = [list(map(get, ws)) for ws in split]
        if missing := list(dict.fromkeys([w for ws, ids in zip(split, found, strict=True) for w, x in zip(ws, ids, strict=True) if x is None])):
            self._meet(missing)
            known = self.words
            return [b"".join([known[w] if x is None else x for w, x in zip(ws, ids, strict=True)]) for ws, ids in zip(split, found, strict=True)]
        return [b"".join(ids) for ids in found]


_ENCODERS: dict[str, WordEncoder] = {}


def _forget() -> None:
    _ENCODERS.clear()


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; its cache lives on from task to task."""
    only_cache("words")
    keep_cache("words", _forget)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
