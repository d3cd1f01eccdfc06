"""Token alignment against whole texts, plain loops and both libraries; the perfect hash."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import alignment as A
from cohortframe.llm.piece_merges import default_model

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  \n\n  ", "a", "don't  stop\t\t x", "x\t \ny   z  \n", "▁▁ a ▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "中文 русский שלום é́ ﬁ 😀👩‍👩‍👧 \x00\x1c \x1f y", "\r\n\r\n a\x85 b c", "'s 're I'll", "1234567 89,000.5", "word " * 3000, "z" * 5000, "end   ", "end \n", "a　 b", "﻿x"]


def by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A.default_bytes())
    t.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=default_model())
    value, docs, count = A.byte_values(), [], collections.Counter()
    for doc, text in rows:
        groups, links = [], []
        if text:
            want = (" " + text).encode()
            ia, ib = t.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            sa = [bytes(value[c] for c in t.id_to_token(i)) for i in ia]
            sb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
            if b"".join(sa) == want == b"".join(sb):
                i = j = x = y = 0
                ga, gb = [], []
                while i < len(ia) or j < len(ib):
                    if x <= y:
                        x, i = x + len(sa[i]), i + 1
                        ga.append(i - 1)
                    else:
                        y, j = y + len(sb[j]), j + 1
                        gb.append(j - 1)
                    if x == y:
                        groups.append((ga, gb))
                        ga, gb = [], []
                for ga, gb in groups:
                    pos_a, pos_b = [], []
                    p = 0
                    for k in ga:
                        pos_a.append((p, p + len(sa[k])))
                        p += len(sa[k])
                    p = 0
                    for k in gb:
                        pos_b.append((p, p + len(sb[k])))
                        p += len(sb[k])
                    links += [(ia[k], ib[m]) for k, (s, e) in zip(ga, pos_a) for m, (u, v) in zip(gb, pos_b) if s < v and u < e]
                groups = [(",".join(str(ia[k]) for k in ga), ",".join(str(ib[k]) for k in gb)) for ga, gb in groups]
                docs.append((doc, len(ia), len(ib), groups, links))
                count.update(set(links))
                continue
        docs.append((doc, 0, 0, [], []))
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc, na, nb, groups, links in docs:
        digest = hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if groups else ""
        out.append((doc, na, nb, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


def found(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in A.align_tokens(df).collect()), key=repr)


def odd_rows():
    rng = random.Random(5)
    chars = [" ", "\n", "\t", "a", "b", "'s", "é", "中", "▁", "1", "23", ".", " ", " ", "😀", "the", "\x1d", "ing", "  "]
    return list(enumerate(ODD)) + [(100 + i, "".join(rng.choice(chars[: 8 if i % 3 else None] + ["the", "x"]) for _ in range(rng.randint(1, 60)))) for i in range(150)] + [(None, "null id"), (None, "null id"), (3, "the same again"), (3, "the same again")]


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("keys", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("n_a", F.lit(2))
    assert found(df.repartition(3)) == by_hand(odd_rows())


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted((tuple(r[n] for n in names) for r in A.op12_alignment(spark, FOLDER).collect()), key=repr) == by_hand(rows)


def test_join_and_trees(spark, monkeypatch):
    """No broadcast, several shards and levels of trees."""
    for name, value in (("BROADCAST_PAIRS", 0), ("SHARD", 40), ("FAN", 2)):
        monkeypatch.setattr(A, name, value)
    rows = odd_rows()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == by_hand(rows)


def test_empty_and_whole_outputs(spark):
    assert A.align_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = A.align_tokens(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), with_groups=True).collect()[0]
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    pairs = A.pair_table(A.pair_counts(spark.createDataFrame([("hello world",), ("hello",)], "text string"), (A.default_bytes(), default_model()))).collect()
    assert sorted(r.n for r in pairs)[-1] == 2


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    made = A.PerfectHash.read(A.PerfectHash.of(keys).written())
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    assert len(made.written()) < 64 + n


def test_documents_are_aligned_once(spark, tmp_path, monkeypatch):
    """Every alignment leaves a mark on disk, as tasks run in other processes: no more slices are aligned than the table has."""
    mark, aligned = str(tmp_path / "aligned"), A.Aligner.aligned

    def counted(self, texts):
        with open(mark, "a") as f:
            f.write("x" * len(texts))
        return aligned(self, texts)

    monkeypatch.setattr(A, "aligner", _Counting(counted))
    rows = [(i, t) for i, t in enumerate(["hello world", None, "", "Hello, world! x", "a\nb"])]
    out = A.align_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == [0, 1, 2, 3, 4] and out[1].n_a == 0 and out[3].n_links > 0
    with open(mark) as f:
        assert len(f.read()) == len(rows)


class _Counting:
    def __init__(self, aligned):
        self.aligned = aligned

    def __call__(self, paths):
        own = A.Aligner(*paths)
        own.aligned = self.aligned.__get__(own)
        return own
