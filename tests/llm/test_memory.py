"""What steps hold of memory, and what the encoder's cache keeps: pipeline, op5_token_files, op6_packing."""

from __future__ import annotations

import pyarrow as pa

from cohortframe.llm import common
from cohortframe.llm.word_tokens import WordEncoder, default_tokenizer


def test_sessions_read_and_write_large_rows_in_small_parts(spark):
    own = spark.newSession()
    common.smaller_batches(own)
    assert int(own.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == 512
    assert int(own.conf.get("parquet.block.size")) == 16 << 20
    told = spark.newSession()
    told.conf.set("spark.sql.parquet.columnarReaderBatchSize", "100")
    told.conf.set("parquet.block.size", "1000000")
    common.smaller_batches(told)
    assert told.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "100"
    assert told.conf.get("parquet.block.size") == "1000000"


def test_a_tidied_task_gives_memory_back_when_it_begins_and_ends(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "only_cache", seen.append)
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    task = common.tidied(lambda batches: iter([b for b in batches]))
    assert list(task(iter([batch, batch]))) == [batch, batch]
    assert seen == [None, None]


def test_a_stem_met_in_a_dressed_word_stays_known():
    coder = WordEncoder(default_tokenizer())
    (ids,) = coder.encode([b"cat"])
    coder.older, coder.words = coder.words, {}
    coder.encode([b"Cat."])
    assert coder.words[b"cat"] == ids


def test_lower_case_words_are_encoded_as_they_stand(monkeypatch):
    coder = WordEncoder(default_tokenizer())
    texts = [b"the cat sat", b"The CAT, a caf\xc3\xa9! \xff x1 \xc4\xb0x", b""]
    expected = [[i for w in t.split() for i in coder._ids(w.decode("utf-8", "replace"))] for t in texts]
    asked = []
    kept = coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda library, words, ends=None: asked.append((library is coder.plain, list(words))) or kept(library, words, ends))
    found = coder.encode(texts)
    assert [list(memoryview(x).cast("I")) for x in found] == expected
    assert asked[0] == (True, ["the", "cat", "sat", "a"])
