"""The training-data operators against brute force, libraries and round trips, with empty, null and odd rows."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import embedding_dedup, language_id, minhash_dedup, mtree_search, packing, piece_merges, samples, token_files, toxicity, url_filter, warc, word_tokens
from cohortframe.llm import queries as registered
from cohortframe.llm.common import new_dir
from cohortframe.llm.components import components
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\n", "a", "one two three four", "\x00 \x1c ☃ 中文😀", "word " * 3000, "é́ ﬁ ﬂ İ Σς", "<|endoftext|> x", "▁▁ a  b"]
SCHEMA = {"documents": "doc_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string"}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(ODD)] + [(3, "repeated row here", "en", "s", 0)] * 2
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("score", F.lit(2.0))


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, name, FOLDER, registered.queries(), registered.oracle_sql())


def encode(x):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = encode.__dict__.setdefault("t", Tokenizer.from_file(word_tokens.default_tokenizer()))
    return [*t.encode(x or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    start, want = 0, {}
    for doc_id, text in sorted(texts(spark)):
        ids = encode(text)
        want[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op5_token_files(spark, FOLDER).collect()}
    assert got == want


def test_token_files_of_odd_rows(spark, odd):
    folder = new_dir(spark, "odd")
    rows = token_files.read_token_files(spark, folder, token_files.write_token_files(odd, folder, width=4)).orderBy("start").collect()
    assert len(rows) == odd.count() and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert sorted(r.ids_crc32 for r in rows) == sorted(crc(encode(r.text)) for r in odd.collect())
    folder = new_dir(spark, "none")
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(odd.limit(0), folder)).count() == 0


def check_packed(rows, docs, capacity):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids, at = encode(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += (capacity - at) if at & (at - 1) else 0
    return padding / (padding + sum(r.length for r in rows))


def test_packing(spark):
    assert check_packed(packing.op6_packing(spark, FOLDER).collect(), texts(spark), 2048) < 0.03


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack(odd.filter("doc_id <> 3"), 64, keep_ids=True).collect()
    check_packed(rows, [(i, x) for i, x in enumerate(ODD) if i != 3], 64)
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(odd.limit(0)).count() == 0


def test_patterns_hold_all_lengths():
    rng = random.Random(3)
    for _ in range(50):
        h = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        patterns = packing.shortest_pack_first(h, 100)
        held = collections.Counter()
        for p, n in patterns:
            assert sum(p) <= 100
            for x in p:
                held[x] += n
        assert held == h


def library_pieces(xs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_merges.default_model())
    return [(x, sp.decode(x)) for x in (sp.encode(t or "", num_threads=1) for t in xs)]


def test_pieces_equal_the_library(spark, odd):
    rng = random.Random(1)
    xs = [t for _, t in texts(spark)] + [x for x in ODD if x] + ["".join(rng.choice("aab  ▁\nté中😀ﬁ=_-.") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["ab" * 500]
    coder = piece_merges.coder(piece_merges.default_model())
    for x, got, (ids, text) in zip(xs, coder.encode(xs), library_pieces(xs), strict=True):
        assert got.tolist() == ids and coder.decode(got) == text, x[:40]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = odd.collect()
    want = sorted((r.doc_id, len(i), sha(",".join(map(str, i)).encode()), sha(t.encode())) for r, (i, t) in zip(rows, library_pieces([r.text for r in rows]), strict=True))
    assert sorted(tuple(r) for r in piece_merges.piece_digests(odd).collect()) == want
    back = piece_merges.decode_pieces(piece_merges.encode_pieces(odd)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r.doc_id, t) for r, (_, t) in zip(rows, library_pieces([r.text for r in rows]), strict=True))


def test_warc_round_trip(spark):
    rows = [(5, "http://x", "same"), (2, "http://y", "same"), (9, None, None), (7, "u", ""), (8, "v", "x" * 300_000), (1, "w", "é\r\n\r\n\x1f\x8b\x08"), (4, "z", "small"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, SCHEMA["pages"]).withColumn("sha", F.lit("clash"))
    files = warc.write_warc(pages, new_dir(spark, "warc"))
    for size in (100, 4096, 1 << 20):
        got = {(r.page_id, r.url): r for r in warc.read_warc(files, range_bytes=size).collect()}
        assert len(got) == len(rows)
        for page_id, url, html in rows:
            r, body = got[(page_id, url)], (html or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
            assert r.refers_to == {5: 2, None: 2, 9: 7}.get(page_id)
            assert r.record_type == ("response" if r.refers_to is None else "revisit")
            assert bytes(r.payload) == (body if r.refers_to is None else b"")
    large = warc.read_warc(warc.write_warc(pages, new_dir(spark, "warc"), least_bytes=10)).filter("record_type = 'revisit'").count()
    assert large == 0
    assert warc.read_warc(warc.write_warc(pages.limit(0), new_dir(spark, "warc"))).count() == 0


def brute_groups(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 4 >= 3 * max(len(sets[a]), len(sets[b])):
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_with_a_large_group_and_a_common_passage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(70)]
    docs = [(i, x) for i, x in enumerate(ODD)]
    for i in range(150):  # near copies of one text
        ws = list(base)
        for _ in range(rng.randint(0, 5)):
            ws[rng.randrange(len(ws))] = word()
        docs.append((100 + i, " ".join(ws)))
    for i in range(150):  # short texts around one passage
        docs.append((1000 + i, " ".join([*(word() for _ in range(rng.randint(0, 25))), *passage, *(word() for _ in range(rng.randint(0, 25)))])))
    docs += [(2000 + i, " ".join(base[:100])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df).collect()}
    want = brute_groups(docs)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 150
    assert all(r.kept == (r.doc_id == r.component_id) for r in minhash_dedup.near_duplicates(df.limit(50)).collect())
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4920, 9255])
def test_near_duplicate_that_contains_a_common_text(spark, seed):
    """Of the longer text's 96 smallest values 39 or more are its own, at a Jaccard index of 0.75 with the common text alone."""
    common = [f"t{i}" for i in range(304)]
    longer = [*common, *(f"s{seed}x{i}" for i in range(100))]
    sketch = minhash_dedup.shingle_set(" ".join(longer).encode())[: minhash_dedup.KEEP]
    assert (~np.isin(sketch, minhash_dedup.shingle_set(" ".join(common).encode()))).sum() >= 39
    docs = [(1, " ".join(longer)), (2, " ".join(common))] + [(10 + i, " ".join([*common, f"v{i}"])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_groups(docs) and {c for _, c in got.values()} == {1}


def test_common_values_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BROADCAST_ROWS", 0)
    docs = texts(spark)[:120]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df).collect()} == brute_groups(docs)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(spark, n=300, dim=20, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[0] + rng.normal(size=(40, dim)).astype(np.float32) * 0.2
    x[90:120] = x[1]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, x[1].tolist(), None), (1004, [1.0, 2.0], 1), (1005, [], 0)]
    return rows, spark.createDataFrame(rows, SCHEMA["embeddings"]).withColumn("key", F.lit("clash")).withColumn("rep", F.lit(1))


def test_near_vectors(spark):
    rows, df = vectors(spark)
    use = [(i, np.array(v, float), c) for i, v, c in rows if c is not None and v and np.isfinite(v).all() and np.any(v)]
    links, root = collections.Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, c in use:
        for j, b, d in use:
            if i < j and c == d and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (links[i], find(i), find(i) == i) for i, _, _ in rows} and sum(links.values()) > 100
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(mtree_search, "LEAF", 8)
    rows, df = vectors(spark, 400)
    v = {i: np.floor(256 * np.array(x, np.float64)).astype(int) for i, x, _ in rows if x and np.isfinite(x).all()}
    dim = max(map(len, v.values()))
    pad = {i: np.pad(x, (0, dim - len(x))) for i, x in v.items()}
    want = []
    for q in pad:
        if q % 50 == 0:
            best = sorted(((-int(pad[q] @ pad[c]), c) for c in pad if c != q))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = mtree_search.top_k(mtree_search.quantised(df), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert mtree_search.top_k(mtree_search.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_spare_computations():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 50
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 8)))
    m2 = float((x * x).sum(axis=1).max())
    pages = dict(enumerate(mtree_search.build_pages(mtree_search._raised(x, m2), np.arange(2000))))
    seen = []
    product = lambda rows, q: seen.append(len(rows)) or (rows @ q).tolist()
    q = x[5]
    got = mtree_search.search(pages, np.r_[q, 0], 5, 5, -np.inf, float(q @ q) + m2, product)
    assert got == [(int(-s), i) for s, i in sorted((-float(x[i] @ q), i) for i in range(2000) if i != 5)[:5]]
    assert sum(seen) < 1500


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang").join(language_id.op8_language_id(spark, "/root/testdata/sf0.01"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    model = language_id.train_language_model(docs, each=50)
    got = [(r.text, r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()]
    assert len(got) == odd.count() and all((p == "und") == (not any(map(str.isalpha, t or ""))) for t, p, _ in got)
    empty = language_id.train_language_model(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_toxicity(spark, odd):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op3_toxicity(spark, folder).join(marks, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if r.toxic == 0]
    assert np.mean([x >= 0.5 for x in toxic]) > 0.7 and np.mean([x < 0.5 for x in clean]) > 0.95
    assert np.mean([(x > y) + (x == y) / 2 for x in toxic for y in clean]) > 0.9  # area under the curve
    model = toxicity.train_toxicity_model(spark.read.parquet(f"{folder}/documents.parquet"), marks)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and len({r.toxicity for r in got if not (r.text or "").strip()}) == 1
    none = toxicity.train_toxicity_model(odd, marks.limit(0))
    assert {r.toxicity for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q=1", "https://net/", "http://net", "http://fr.org/fr/", "http://example.com/de/1#t", None, "", "no scheme net/", "x://y://z.net/a", "http://ÄB.net/en", "http://a.net?x/y", "http://notnet/", "http://example.net/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("length", F.lit(1))
    df = df.unionByName(spark.read.parquet(f"{FOLDER}/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url", F.lit("c").alias("host"), F.lit(1).alias("length")))
    labelled = df.select("url", F.when(url_filter.rule_for(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))["verdict"] == "block", 1.0).otherwise(0.0).alias("label"))
    model = url_filter.train_url_model(labelled)
    got = url_filter.judge(df, model).collect()
    assert len(got) == df.count()
    for r in got:
        host, path, best = judged(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), r.url
        assert r.verdict == (best[1] if best else "block" if r.score >= 0.5 else "allow")
    one = url_filter.train_url_model(labelled.filter("label = 1.0"))
    assert {r.verdict for r in url_filter.judge(df, one).filter("rule is null").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), model).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "", "en", "s", 0), (900_002, "12 34", "en", "s", 0), (900_003, None, "en", "s", 0)], DOCS)
    kept = p.language(spark, docs.unionByName(extra), FOLDER)
    assert kept.columns == docs.columns and kept.filter("doc_id > 900000").count() == 0 and kept.count() > 0.95 * docs.count()
    clean = p.toxicity(spark, kept, FOLDER)
    one = p.near_duplicate_groups(spark, clean, FOLDER).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if i == c}
    check_packed(p.packing(spark, one, FOLDER).collect(), [(r.doc_id, r.text) for r in one.collect()], 2048)
    assert p.run(spark, FOLDER).count() > 0


def test_unseen_misspellings_are_caught():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(3, 9)))
    bad = ["grobnikal", "shlorpitude", "vexmorgan"]
    plain = [word() for _ in range(400)]
    made = lambda insult: " ".join([*rng.choices(plain, k=12), *([insult] if insult else []), *rng.choices(plain, k=12)])
    labels = [i % 2 for i in range(600)]
    model = toxicity.SubwordModel([made(rng.choice(bad) if y else None) for y in labels], labels, clean_share=0.5)
    for wrong in ("gr0bnikal", "shlorpitud3", "vexmorgann", "vexm0rgan"):
        assert np.mean(model.score([made(wrong) for _ in range(50)])) > 0.1 + np.mean(model.score([made(None) for _ in range(50)]))
    assert toxicity.words_of("Sh1t 12 a_b 3d") == ["sh1t", "a", "b", "3d"]


def test_language_of_a_very_long_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train_language_model(docs, each=100)
    for lang in ("en", "de"):
        long = " ".join(r.text for r in docs.filter(F.col("lang") == lang).orderBy("doc_id").limit(200).collect() if r.text)
        words = (long.split() * (20_000 // len(long.split()) + 1))[:20_000]
        assert model.predict([" ".join(words)])[0][0] == lang


def test_samples_are_the_same_whatever_the_partitions(spark):
    rows = spark.range(3000).selectExpr("id % 40 as doc_id", "concat('t', id) as text", "concat('c', id % 300) as lang")
    picked = [sorted(map(tuple, samples.per_class(rows.repartition(n), "lang", "doc_id", 4).collect())) for n in (1, 7)]
    assert picked[0] == picked[1] and len({r[2] for r in picked[0]}) > 150
    with pytest.raises(ValueError):
        samples.per_class(rows, "lang", "doc_id", 4, most_classes=10)


def test_word_cache_stays_within_its_bytes(monkeypatch):
    monkeypatch.setattr(word_tokens, "CACHE_BYTES", 60_000)
    coder = word_tokens.WordEncoder(word_tokens.default_tokenizer())
    rng = random.Random(2)
    xs = [" ".join("".join(rng.choice("abcdeÉß0!.,") for _ in range(rng.choice((3, 8, 400)))) for _ in range(40)) for _ in range(60)]
    for x in xs + xs:
        assert np.frombuffer(coder.encode([x.encode()])[0], "<u4").tolist() == encode(x)[:-1]
        assert coder.held < 60_000 + 40_000  # and what one text adds
    assert coder.encode([b"Plain words, plain; PLAIN!"]) == [np.array(encode("Plain words, plain; PLAIN!")[:-1], "<u4").tobytes()]


CLASH = ("features", "prediction", "probability", "length", "suffix", "fit", "score", "lang_pred", "toxicity", "key", "component", "n_shingles", "kept", "set_key", "block", "pivot", "rank", "sha", "first_id", "part")


def clashing(df):
    return df.withColumns({c: F.lit(-7) for c in CLASH if c not in df.columns})


def test_clashing_columns_stay(spark):
    urls = clashing(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url"))
    ruled = url_filter.rule_for(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    model = url_filter.train_url_model(urls.select("url", F.when(ruled["verdict"] == "block", 1.0).when(ruled["verdict"] == "allow", 0.0).alias("label")))
    got = url_filter.judge(urls, model).collect()
    assert len(got) == urls.count() and all(r[c] == -7 for r in got for c in CLASH if c != "score")
    long = spark.createDataFrame([(1, "http://a.net/" + "x7" * 50_000), (2, "http://b.org/y"), (2, "http://b.org/y")], "page_id long, url string")
    assert len(url_filter.judge(long, model).collect()) == 3
    docs = clashing(spark.createDataFrame([(1, "one two three four five six seven"), (None, None), (2, "")], "doc_id long, text string"))
    assert len(minhash_dedup.near_duplicates(docs).collect()) == len(packing.pack(docs).collect()) == len(piece_merges.piece_digests(docs).collect()) == 3
    folder = new_dir(spark, "clash")
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(docs, folder)).count() == 3
    pages = clashing(spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], SCHEMA["pages"]))
    assert warc.read_warc(warc.write_warc(pages, new_dir(spark, "warc"))).count() == 2
    vecs = clashing(spark.createDataFrame([(50, [1.0, 2.0], 1), (2, [1.0, 2.1], 1)], SCHEMA["embeddings"]))
    assert len(embedding_dedup.near_vectors(vecs).collect()) == 2 and len(mtree_search.top_k(mtree_search.quantised(vecs), F.col("vec_id") % 50 == 0).collect()) == 1


def test_url_trees_learn_labels_that_no_rule_gives(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(f"http://{word(5)}.{rng.choice(['com', 'org'])}/{'/'.join(word(4) for _ in range(rng.randint(1, 3)))}", 0.0) for _ in range(600)]
    rows += [(f"http://{word(9)}-{rng.randint(100, 999)}.{rng.choice(['com', 'xyz'])}/{rng.randint(10**6, 10**9)}?a={word(3)}&b={rng.randint(0, 99)}", 1.0) for _ in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "url string, label double")
    model = url_filter.train_url_model(spark.createDataFrame(rows[:800], "url string, label double"))
    got = {r.url: r.verdict for r in url_filter.judge(df, model, rules=()).collect()}
    assert np.mean([got[u] == ("block" if y else "allow") for u, y in rows[800:]]) > 0.95


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=i % 130 + 2).tolist(), 1) for i in range(260)]
    rows += [(1000 + i, [x * 2 for x in v], 1) for i, v, _ in rows[:130]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA["embeddings"])).collect()}
    assert all(got[1000 + i][1] == got[i][1] <= i for i in range(5, 130))
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = lambda v, d: [x + d * (k == 3) for k, x in enumerate(v)]
    rows = [(1, a, 1), (1, b, 1), (2, near(a, 0.1), 1), (3, near(b, 0.1), 1), (4, near(b, 0.2), 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA["embeddings"])).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_search_with_repeated_and_null_ids_and_large_sums(spark):
    rows = [(50, [1.0, 2.0], 1), (50, [9.0, 9.0], 1), (None, [9.0, 9.0], 1), (7, [3.0, 3.0], 1), (7, [3.0, 3.0], 1), (8, [1.0, 0.0], 1)]
    got = mtree_search.top_k(mtree_search.quantised(spark.createDataFrame(rows, SCHEMA["embeddings"])), F.col("vec_id") % 50 == 0, k=3).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(50, 7, 65536 * 9), (50, 7, 65536 * 9), (50, 8, 65536)]
    big = 3_037_000_499
    large = spark.createDataFrame([(0, [big, 1]), (1, [big, 1]), (2, [big, 0]), (3, [big - 1, 5])], "vec_id long, v array<long>")
    got = mtree_search.top_k(large, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, big * big + 1), (2, big * big), (3, big * (big - 1) + 5)]


def test_warc_records_are_apart_and_name_their_response(spark):
    import gzip

    pages = spark.createDataFrame([(1, "http://first", "same"), (1, "http://first", "same"), (2, "http://second", "same")], SCHEMA["pages"])
    files = warc.write_warc(pages, new_dir(spark, "warc"))
    raw = b"".join(gzip.open(f.path.removeprefix("file:")).read() for f in files.collect()).decode()
    ids = re.findall(r"WARC-Record-ID: (\S+)", raw)
    assert len(set(ids)) == 3 and raw.count("WARC-Type: response") == 2
    assert "WARC-Profile: " + warc.REVISIT in raw and "WARC-Refers-To-Target-URI: http://first" in raw and "WARC-Refers-To-Date: " in raw


def test_near_duplicates_with_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (5, base + " more"), (5, "other words that are not alike at all here"), (3, base), (None, base), (9, None), (9, "")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 56, 0, True), (3, 56, 3, True), (5, 5, 5, True), (5, 56, 3, False), (5, 57, 3, False), (9, 0, 9, True), (9, 0, 9, True)]


def test_stages_keep_columns_and_take_odd_tables(spark):
    import corpus_pipeline as p

    docs = clashing(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    base = " ".join(f"w{i}" for i in range(60))
    odd_rows = spark.createDataFrame([(10**6, base, "en", "s", 0), (10**6, base, "en", "s", 0), (10**6, base + " more", "en", "s", 1), (10**6, "quite another text about other things here", "en", "s", 0), (10**6 + 1, base, "en", "s", 0), (None, base, "en", "s", 0), (10**6 + 2, None, "en", "s", 0), (10**6 + 2, "", "en", "s", 0)], DOCS)
    table = docs.unionByName(clashing(odd_rows))
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, table, FOLDER)
        assert got.columns == table.columns, name
        assert all(r[c] == -7 for r in got.select(*CLASH).distinct().collect() for c in CLASH), name
        assert stage(spark, table.limit(0), FOLDER).count() == 0, name
    kept = sorted((r.doc_id or 0, (r.text or "")[:5], r.n_chars) for r in p.near_duplicate_groups(spark, clashing(odd_rows), FOLDER).collect())
    assert kept == [(0, "w0 w1", 0), (10**6, "quite", 0), (10**6, "w0 w1", 0), (10**6 + 2, "", 0), (10**6 + 2, "", 0)]
    assert p.packing(spark, table.limit(0), FOLDER).count() == 0 and p.packing(spark, clashing(odd_rows), FOLDER).count() == 8
