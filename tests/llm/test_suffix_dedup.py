"""Removal of repeated byte strings against a dictionary of all strings, and its sort."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import suffix_dedup as S

FOLDER = "/root/testdata/sf0.001"


def by_hand(rows):
    """Rows (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - S.WIDTH + 1 if doc is not None else 0):
            w = b[i : i + S.WIDTH]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - S.WIDTH + 1 if doc is not None else 0):
            if first[b[i : i + S.WIDTH]] < doc:
                gone[i : i + S.WIDTH] = b"\1" * S.WIDTH
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect()), key=repr)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(6, 30)) for _ in range(6)] + ["x" * 130, "ab" * 60, "0123456789" * 9]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 8)
            parts += [s[a : len(s) - rng.randint(0, 8)], text(rng.randint(0, 12))]
        rows.append((rng.randint(0, n), rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(None, shared[0] * 2), (None, None), (5, None), (6, ""), (7, "short"), (n + 1, shared[7] * 3), rows[3], rows[3], (rows[4][0], rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("bucket", F.lit(1)).withColumn("spans", F.lit(2))
    assert found(df.repartition(5)) == by_hand(rows)


def test_frequent_tokens_and_bounds(spark, monkeypatch):
    """Strings of a token that reaches over buckets, keys dealt over tasks, small blocks, a full bitmap, no broadcast."""
    rng = random.Random(9)
    middle = "the same twenty-five bytes"
    rows = [(i, "".join(rng.choice("pqrs") for _ in range(25)) + middle + "".join(rng.choice("pq") for _ in range(rng.randint(0, 3))) + "tail of many texts, the same in all" * (i % 2)) for i in range(400)] + made(4, 40)
    for name, value in (("MOST_BITS", 3), ("HELD", 64), ("SLICE", 400), ("BUCKET", 4000), ("SAMPLE", 1), ("BROADCAST", 0)):
        monkeypatch.setattr(S, name, value)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op13_suffix_dedup(spark, FOLDER).collect()), key=repr)
    assert got == by_hand(rows) and any(r[2] for r in got)


def test_whole_outputs_and_long_texts(spark):
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    rows = [(1, long), (2, "new " + long[1_000_000:1_000_200] + " end"), (3, long[:2_500_000])]
    out = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert out[1].kept.decode() == long and out[2].kept == b"new  end" and out[3].kept == b""
    assert np.frombuffer(out[2].spans, "<u4").tolist() == [4, 204]


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_bytes == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (50_000, 6)).astype(np.uint64)
    order = S.multikey_quicksort(words, small=64)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all() and sorted(order) == list(range(50_000))
