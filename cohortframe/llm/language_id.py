"""Language identification by string kernels.

Kernel: two texts share k(x, y) = |G(x) ∩ G(y)| / sqrt(|G(x)| |G(y)|), where
G has the character n-grams of lengths 1 to 4 that occur in a text (a blended
spectrum, presence only), hashed into 2^14 buckets. A Nyström map over landmark
texts turns it into finite features, and one-versus-rest kernel ridge
regression is solved on them. Texts are scored in blocks: a presence matrix
times the landmark matrix times the weights.

Landmarks are dealt evenly among the languages, and their number grows with
that of the languages; the sample's bytes are bounded over all languages.

Cases: null text and text without a letter give `und` with score 1; an empty
table gives no rows; without training rows every other text gives `und`
with score 0; equal outputs go to the alphabetically first language; repeated
rows are scored each; other columns stay as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices, smaller_batches, tidied
from .samples import per_class

BUCKETS, LONGEST, BLOCK = 1 << 14, 4, 128
UNKNOWN = "und"


def presence(texts: list[str]) -> np.ndarray:
    """Row per text: which buckets its n-grams of lengths 1 to 4 fall into (float32 zeros and ones)."""
    seen = np.zeros((len(texts), BUCKETS), np.uint8)
    for row, text in zip(seen, texts, strict=True):
        codes = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(codes), np.uint32)
        for n in range(LONGEST):
            if len(codes) <= n:
                break
            h = (h[: len(codes) - n] * np.uint32(0x01000193)) ^ (codes[n:] + np.uint32(n << 24))
            mixed = h * np.uint32(0x9E3779B1)
            row[mixed >> np.uint32(18)] = 1
    return seen.astype(np.float32)


def landmark_rows(of: np.ndarray, classes: int, landmarks: int) -> list[int]:
    """Which rows are landmarks, of rows with class numbers `of`: as near as can be the same number of each class, spread over its rows."""
    order = np.argsort(of, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=classes))]
    own = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    quota = np.zeros(classes, np.int64)
    while quota.sum() < min(landmarks, len(of)):
        left = min(landmarks, len(of)) - quota.sum()
        open_ones = np.flatnonzero(quota < np.diff(ends))
        quota[open_ones[:left] if left < len(open_ones) else open_ones] += 1
    return sorted(int(rows[k * len(rows) // q]) for rows, q in zip(own, quota, strict=True) for k in range(q))


class KernelModel:
    """Landmarks and weights; texts to language and score."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = 128, ridge: float = 1e-3):
        """Texts in an order of their own; where two languages are equally likely the alphabetically first is taken."""
        self.labels = sorted(set(labels))
        if not texts:
            self.columns = np.zeros(0, np.int64)
            return
        classes, of = np.unique(np.array(labels), return_inverse=True)
        chosen = landmark_rows(of, len(classes), landmarks)
        marks = presence([texts[i] for i in chosen])
        self.columns = np.flatnonzero(marks.any(axis=0))
        self.norms = np.sqrt(marks.sum(axis=1))
        self.marks = np.ascontiguousarray(marks[:, self.columns].T)
        own = (self.marks.T @ self.marks) / np.outer(self.norms, self.norms)
        values, vectors = np.linalg.eigh(own.astype(np.float64))
        kept = values > 1e-6 * values.max()
        whiten = vectors[:, kept] / np.sqrt(values[kept])
        # normal equations, summed block by block; classes weigh the same, however common
        weight = 1 / np.bincount(of)[of]
        square, target = np.zeros((whiten.shape[1] + 1,) * 2), np.zeros((whiten.shape[1] + 1, len(classes)))
        for i in range(0, len(texts), BLOCK):
            z = self.kernel(texts[i : i + BLOCK]).astype(np.float64) @ whiten
            z = np.hstack([z, np.ones((len(z), 1))])
            y = np.where(of[i : i + BLOCK, None] == np.arange(len(classes))[None, :], 1.0, -1.0)
            zw = z * weight[i : i + BLOCK, None]
            square += z.T @ zw
            target += zw.T @ y
        solved = np.linalg.solve(square + ridge * np.eye(len(square)), target)
        self.weights = (whiten @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        seen = presence(texts)
        size = np.sqrt(np.maximum(seen.sum(axis=1), 1))
        return (seen[:, self.columns] @ self.marks) / np.outer(size, self.norms)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not len(self.columns):
            return [(UNKNOWN, 0.0)] * len(texts)
        found = self.kernel(texts) @ self.weights + self.bias
        power = np.exp(4 * (found - found.max(axis=1, keepdims=True)))
        best = found.argmax(axis=1)
        return [(self.labels[b], float(x)) for b, x in zip(best, (power / power.sum(axis=1, keepdims=True))[np.arange(len(best)), best], strict=True)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train_language_model(rows: DataFrame, each: int = 400, landmarks: int = 128, longest: int = 1 << 16, total: int = 1 << 27, most_rows: int = 100_000, a_class: int = 3, most_landmarks: int = 2048) -> KernelModel:
    """Fits on a bounded sample of rows (doc_id, text, lang): about `each` texts of every language, of at most `longest` bytes each.

    All languages share `total` bytes and `most_rows` texts: where that many texts of the rows' mean size would be more, each has fewer, at least one.
    There are `landmarks` of them, or `a_class` a language if that is more, up to `most_landmarks`. Those bounds are the
    documented parameters; predictions cover all rows and whole texts."""
    wanted = rows.select("doc_id", F.col("text").cast("string").alias("text"), "lang").filter((F.octet_length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    sizes = wanted.filter("lang is not null").groupBy("lang").agg(F.avg(F.octet_length("text")).alias("mean"))
    seen = sizes.agg(F.count("*").alias("classes"), F.sum("mean").alias("bytes")).first()  # bytes: of one text of each language
    if seen["classes"]:
        each = max(1, min(each, int(total / max(seen["bytes"], 1.0)), most_rows // seen["classes"]))
    sample = per_class(wanted, "lang", "doc_id", each).toPandas()
    sample = sample.sort_values(["doc_id", "text"])
    return KernelModel(sample["text"].tolist(), sample["lang"].tolist(), max(landmarks, min(most_landmarks, a_class * seen["classes"])))


def identify(docs: DataFrame, model: KernelModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with language and score under the given names, which take the place of columns so called, in one pass
    over whole texts; the model (about a megabyte) goes to the workers."""
    spark = docs.sparkSession
    smaller_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x.decode("utf-8", "replace") for x in as_bytes(part.column("text"))]
                out: list[tuple[str, float]] = [(UNKNOWN, 1.0)] * len(texts)
                asked = [i for i, x in enumerate(texts) if has_letter(x)]
                for a in range(0, len(asked), BLOCK):
                    some = asked[a : a + BLOCK]
                    for i, found in zip(some, own.predict([texts[i] for i in some]), strict=True):
                        out[i] = found
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in out]), pa.array([x for _, x in out])], [*part.schema.names, *names])

    plain = docs.withColumn("text", F.col("text").cast("string"))
    kept = plain.select(*[c for c in plain.columns if c.lower() not in {x.lower() for x in names}])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(tidied(run), f"{schema}, `{names[0]}` string, `{names[1]}` double")


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_language_model(docs.filter(~held_out(4, 2)))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
