"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 6,
hashed); a text is taken as its distinct words in the order of their first use,
so that repeats don't add up; a window of WINDOW places has the mean of its
words' vectors, an empty place counting as zero; a linear softmax scores it, and a text scores as its most toxic window, so one insult in a long
text counts as it does in a short one. Training starts with windows of all
texts and goes on with each toxic text's most toxic window against the worst
windows of clean texts. Vectors and softmax are trained together. A fifth of
the sample, kept out of that, then sets scale and shift of the score. As everything before the softmax is
a mean, a trained word is one number, remembered per worker.

Cases: null and empty texts have one empty window, whose score is the bias
alone; without labelled rows of both classes every score is 0; an empty table
gives no rows; repeated rows are scored each."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices, smaller_batches, tidied
from .samples import per_class

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 4, 3, 6
WINDOW, STEP, DECAY, FIRST_STEPS, EACH = 8, 4, 3e-5, 25, 30
#: Runs of letters and digits with a letter among them, so that digits put for letters stay inside their word.
WORD = re.compile(r"\d*[^\W\d_][^\W_]*")
#: Bytes of words that a worker remembers at most, an entry counting as ENTRY bytes beside its word.
CACHE_BYTES, ENTRY = 64 << 20, 130


def words_of(text: str) -> list[str]:
    """Distinct words in the order of their first use."""
    return list(dict.fromkeys(WORD.findall(text.lower())))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words in angle brackets, word by word, and how many each has."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ codes[n - 1 :]
        if n >= SHORTEST:
            inside = np.arange(len(h)) + n <= ends[: len(h)]
            found.append(((h[inside] + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(15)).astype(np.int64))
            of.append(owner[: len(h)][inside])
        if len(h) < 2:
            break
    flat, of_all = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return flat[order], np.bincount(of_all, minlength=len(words))


def window_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each window of a text of n words; the last one may be shorter."""
    first = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    return first, np.minimum(first + WINDOW, n)


class SubwordModel:
    """Trained word scores. A word's score is (softmax weight of toxic minus clean) times its vector."""

    def __init__(self, texts: list[str], labels: list[int], clean_share: float = 0.9, rounds: int = 5):
        self.known: dict[str, float] = {}
        self.held = 0
        self.trained, self.scale, self.shift = len(set(labels)) == 2, 1.0, 0.0
        if not self.trained:
            return
        apart = np.arange(len(texts)) % 5 == 4
        fitted = [i for i in range(len(texts)) if not apart[i]]
        if len({labels[i] for i in fitted}) < 2:
            fitted, apart = list(range(len(texts))), np.ones(len(texts), bool)
        self._fit([texts[i] for i in fitted], [labels[i] for i in fitted], rounds, seed=7)
        self._calibrate([texts[i] for i in np.flatnonzero(apart)], np.array(labels)[apart], clean_share)

    def _calibrate(self, texts: list[str], y: np.ndarray, clean_share: float) -> None:
        """Scale and shift of the best window's logit, on texts set apart, with classes weighed as in the corpus."""
        logit = np.array([self._best(x) for x in texts])
        if len(set(y.tolist())) < 2:
            return
        weight = np.where(y == 1, (1 - clean_share) / (y == 1).sum(), clean_share / (y == 0).sum())
        a, c = 1.0, 0.0
        for _ in range(50):  # Newton steps of a weighted logistic regression with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * logit + c, -50, 50)))
            g = np.array([(weight * (p - y) * logit).sum() + 1e-3 * (a - 1), (weight * (p - y)).sum() + 1e-4 * c])
            w = weight * p * (1 - p)
            h = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-4]])
            step = np.linalg.solve(h, g)
            a, c = a - step[0], c - step[1]
        if a > 0 and (y == 1).sum() >= 20:
            self.scale = float(np.clip(a, 0.5, 2.0))
            self.shift = float(c) * self.scale / float(a)

    def _fit(self, texts: list[str], labels: list[int], rounds: int, seed: int) -> None:
        self._decay = max(DECAY, 0.1 / len(texts))  # fewer texts, more restraint
        vocabulary: dict[str, int] = {}
        docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int64) for t in texts]
        buckets, self._per_word = subwords([*vocabulary, "-"])  # the last stands where a window has no word
        self._used, local = np.unique(buckets, return_inverse=True)
        self._local = local.astype(np.int32)
        del buckets, local
        self._starts = np.cumsum(self._per_word) - self._per_word
        rng = np.random.default_rng(seed)
        self._vectors, self._weights, self._bias = rng.normal(0, 0.3, (len(self._used), DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
        rows, owner, nothing = [], [], len(vocabulary)
        for i, d in enumerate(docs):
            first, _ = window_bounds(len(d))
            padded = np.r_[d, np.full(WINDOW, nothing)].astype(np.int32)
            rows.append(padded[first[:, None] + np.arange(WINDOW)])
            owner.append(np.full(len(first), i))
        windows, owner_of = np.concatenate(rows), np.concatenate(owner)
        y = np.array(labels)[owner_of]
        doc_starts = np.flatnonzero(np.r_[True, owner_of[1:] != owner_of[:-1]])
        place = np.arange(len(owner_of)) - np.repeat(doc_starts, np.diff(np.r_[doc_starts, len(owner_of)]))
        counts = np.bincount(owner_of)[owner_of]
        # at first up to some 30 windows of every text, then toxic texts' best windows against the worst clean ones so far
        chosen = place % np.maximum(1, counts // EACH) == 0
        self._train(windows[chosen], y[chosen], 1 / np.minimum(counts[chosen], EACH), nothing, FIRST_STEPS, 0.3)
        hard = np.zeros(len(y), bool)
        for _ in range(rounds):
            logits = self._logits(windows, nothing)
            order = np.lexsort((-logits, owner_of))
            top = np.empty(len(y), np.int64)
            top[order] = place
            hard |= (y == 0) & (top < 4)
            chosen = hard | ((y == 1) & (top < 1))
            self._train(windows[chosen], y[chosen], np.ones(chosen.sum()), nothing, 30, 0.15)
        self.bucket_score = np.zeros(BUCKETS, np.float32)
        self.bucket_score[self._used] = self._vectors @ (self._weights[:, 1] - self._weights[:, 0])
        self.bias = float(self._bias[1] - self._bias[0])
        del self._vectors, self._weights, self._bias, self._used, self._local, self._starts, self._per_word

    def _logits(self, windows: np.ndarray, nothing: int) -> np.ndarray:
        """Toxic minus clean, for every window."""
        per_bucket = self._vectors @ (self._weights[:, 1] - self._weights[:, 0])
        per_word = np.add.reduceat(per_bucket[self._local], self._starts) / self._per_word
        per_word[nothing] = 0
        out = np.empty(len(windows))
        for a in range(0, len(windows), 50_000):
            part = windows[a : a + 50_000]
            out[a : a + 50_000] = per_word[part].sum(axis=1) / WINDOW
        return out

    def _train(self, windows: np.ndarray, y: np.ndarray, share: np.ndarray, nothing: int, steps: int, rate: float) -> None:
        """Steps of Adam on vectors, softmax weights and bias together, over the given windows."""
        words, inner = np.unique(np.r_[windows.ravel(), nothing], return_inverse=True)
        inner = inner[:-1].reshape(windows.shape)
        pad = len(words) - 1
        spans = self._per_word[words]
        entries = np.repeat(self._starts[words], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        used, local = np.unique(self._local[entries], return_inverse=True)
        local = local.astype(np.int32)
        del entries
        starts = np.cumsum(spans) - spans
        vectors = self._vectors[used]
        share = np.where(y == 1, share / max(share[y == 1].sum(), 1e-9), 2 * share / max(share[y == 0].sum(), 1e-9))
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, self._weights, self._bias)]
        flat = inner.ravel()
        for step in range(1, steps + 1):
            word_vectors = np.add.reduceat(vectors[local], starts) / spans[:, None]
            word_vectors[pad] = 0
            logits = (word_vectors @ self._weights)[inner].sum(axis=1) / WINDOW + self._bias
            toxic = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -50, 50)))
            error = (toxic - y) * share
            on_word = np.bincount(flat, np.repeat(error / WINDOW, WINDOW), len(words))
            on_word[pad] = 0
            on_word = np.stack([-on_word, on_word], axis=1)
            per_entry = ((on_word @ self._weights.T) / spans[:, None]).astype(np.float32)
            on_buckets = np.stack([np.bincount(local, np.repeat(per_entry[:, k], spans), len(used)) for k in range(DIM)], axis=1).astype(np.float32)
            grads = [on_buckets + np.float32(self._decay) * vectors, word_vectors.T @ on_word + self._decay * self._weights, np.array([-error.sum(), error.sum()])]
            for p, g, (m, v) in zip((vectors, self._weights, self._bias), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)).astype(p.dtype)
        self._vectors[used] = vectors

    def _learn(self, words: list[str]) -> None:
        buckets, sizes = subwords(words)
        sums = np.add.reduceat(self.bucket_score[buckets].astype(np.float64), np.cumsum(sizes) - sizes)
        self.known.update(zip(words, (sums / sizes).tolist(), strict=True))
        self.held += sum(map(sys.getsizeof, words)) + ENTRY * len(words)

    def _best(self, text: str) -> float:
        """The most toxic window's logit."""
        ws = words_of(text)
        if new := [w for w in ws if w not in self.known]:
            for i in range(0, len(new), 20_000):
                self._learn(new[i : i + 20_000])
        sums = np.zeros(len(ws) + 1)
        np.cumsum(np.fromiter(map(self.known.__getitem__, ws), np.float64, len(ws)), out=sums[1:])
        first, end = window_bounds(len(ws))
        return float((sums[end] - sums[first]).max()) / WINDOW + self.bias

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def score(self, texts: list[str]) -> list[float]:
        """The probability that each text is toxic."""
        if not self.trained:
            return [0.0] * len(texts)
        if self.held > CACHE_BYTES:
            self.forget()
        if new := list({w for x in texts for w in words_of(x)} - self.known.keys()):
            for i in range(0, len(new), 20_000):
                self._learn(new[i : i + 20_000])
        return [1 / (1 + float(np.exp(-min(50.0, max(-50.0, self.scale * self._best(x) + self.shift))))) for x in texts]


def train_toxicity_model(docs: DataFrame, labels: DataFrame, each: int = 1500, longest: int = 1 << 16) -> SubwordModel:
    """Fits on a bounded sample of labelled documents: about `each` of a class, of at most `longest` bytes each.
    Those bounds are the documented parameters; scores cover all rows and whole texts.

    The sample is drawn from the labels (doc_id, toxic), a repeated one counting
    once, so only its few thousand ids are joined to docs (doc_id, text),
    broadcast; where documents share an id, the first texts by order make up the bound."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.cache()
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= longest)
    sample = texts.join(F.broadcast(per_class(marks, "toxic", "doc_id", each)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(3 * each + 100)
    rows = sample.toPandas().sort_values(["doc_id", "text"])
    marks.unpersist()
    clean = counts.get(0, 0) / max(1, sum(counts.values()))
    return SubwordModel(rows["text"].tolist(), rows["toxic"].tolist(), clean)


def score_toxicity(docs: DataFrame, model: SubwordModel, name: str = "toxicity") -> DataFrame:
    """docs with a column `name` (0 to 1), which takes the place of one so called, in one pass over whole texts."""
    smaller_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = own.score([x.decode("utf-8", "replace") for x in as_bytes(part.column("text"))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, name])
        own.forget()  # a worker that lives on holds no words of models that are done with

    plain = docs.withColumn("text", F.col("text").cast("string"))
    kept = plain.select(*[c for c in plain.columns if c.lower() != name.lower()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(tidied(run), f"{schema}, `{name}` double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train_toxicity_model(docs, marks.filter(~apart))
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", apart.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
