"""Features and models against plain Python and direct solutions."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from cohortframe.llm import language_id, url_filter


def plain_features(url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest[: next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))]
    path = rest[len(host) :]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    query = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
    counts = collections.Counter(url.lower())
    return {
        "length": len(url), "host_length": len(host), "labels": host.count(".") + 1, "depth": path.count("/"), "hyphens": host.count("-"),
        "digit_ratio": sum(c in "0123456789" for c in url) / max(1, len(url)), "parameters": len(query.split("&")) if query else 0, "fragment": float("#" in url),
        "entropy": -sum(n / len(url) * math.log2(n / len(url)) for n in counts.values()),
    }


def test_url_features_against_plain_python(spark):
    urls = ["http://a-b.c.org/x/y/1?q=1&r=22&s#top", "", "no scheme/1", "x://HOST?a#b", "https://n.net/" + "é7/" * 500, "http://h/#?x=1", "http://h/?&&"]
    urls += [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").filter("url is not null").collect()]
    df = url_filter.lexical_features(url_filter.with_parts(spark.createDataFrame([(u,) for u in urls], "url string")))
    for r in df.collect():
        for name, value in plain_features(r.url).items():
            assert abs(r[url_filter.OWN + name] - value) < 1e-9, (r.url, name)


def test_suffix_statistics_leave_out_the_own_fold(spark):
    rows = [(f"http://h{i}.{'abc'[i % 3]}/p", float(i % 3 == 0 or i % 7 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, label double")
    model = url_filter.train_url_model(df)
    sample = url_filter.lexical_features(url_filter.with_parts(df))
    fold = url_filter.fold_of(F.col("url"))
    seen = url_filter.with_statistics(sample, model, fold).withColumn("fold", fold).collect()
    for r in seen:
        others = [x.label for x in seen if x.fold != r.fold and x[url_filter.OWN + "suffix"] == r[url_filter.OWN + "suffix"]]
        assert abs(r[url_filter.OWN + "suffix_rate"] - (sum(others) + 5 * model.prior) / (len(others) + 5)) < 1e-9
    told = url_filter.evaluate(df)
    assert told["auc"] > 0.8 and abs(sum(told[x] for x in url_filter.FEATURES) - 1) < 1e-9


def test_url_labels_without_meaning_are_not_told(spark):
    rng = random.Random(3)
    rows = [(f"http://h{rng.randint(0, 10**9)}.{rng.choice(['com', 'org'])}/{rng.choice(['de', 'fr'])}/{rng.randint(0, 10**6)}", float(rng.random() < 0.5)) for _ in range(1500)]
    assert abs(url_filter.evaluate(spark.createDataFrame(rows, "url string, label double"))["auc"] - 0.5) < 0.12


def grams(text):
    text = " ".join(text.lower().split())
    return {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}


def bucket(gram):
    h = 0
    for n, c in enumerate(gram):
        h = (h * 0x01000193 ^ (ord(c) + (n << 24))) & 0xFFFFFFFF
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 18


def test_language_kernel_and_ridge_against_direct_solution():
    rng = random.Random(5)
    of = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(2, 6))) for _ in range(8))
    texts = [of("abcdef") for _ in range(12)] + [of("defghi") for _ in range(10)] + [of("xyzabc") for _ in range(8)]
    labels = ["l1"] * 12 + ["l2"] * 10 + ["l3"] * 8
    asked = [of("abcdefxyz") for _ in range(9)] + texts[::7]
    model = language_id.KernelModel(texts, labels, landmarks=30)
    sets = [[grams(x) for x in some] for some in (texts, asked)]
    kernel = lambda some: np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets[0]] for a in some])
    assert np.abs(model.kernel(asked) - kernel(sets[1])).mean() < 0.02  # buckets collide now and then
    sets = [[{bucket(g) for g in x} for x in some] for some in sets]
    assert np.abs(model.kernel(asked) - kernel(sets[1])).max() < 1e-5
    # all texts are landmarks, so kernel ridge regression can be solved directly, with a kernel of 1 for the constant
    own, new = model.kernel(texts).astype(float) + 1, model.kernel(asked).astype(float) + 1
    root = np.sqrt([1 / labels.count(x) for x in labels])
    y = np.where(np.array(labels)[:, None] == np.array(["l1", "l2", "l3"])[None, :], 1.0, -1.0)
    direct = new @ (root[:, None] * np.linalg.solve(root[:, None] * own * root[None, :] + 1e-3 * np.eye(30), root[:, None] * y))
    assert np.abs(model.kernel(asked) @ model.weights + model.bias - direct).max() < 1e-2
    assert [x for x, _ in model.predict(asked)] == [["l1", "l2", "l3"][i] for i in direct.argmax(axis=1)]


def test_landmarks_are_dealt_evenly():
    of = np.array([0] * 100 + [1] * 3 + [2] * 50)
    chosen = language_id.landmark_rows(of, 3, 30)
    assert len(set(chosen)) == 30 and sorted(collections.Counter(of[chosen]).values()) == [3, 13, 14]
    assert language_id.landmark_rows(of, 3, 1000) == list(range(153))
    assert len(set(of[language_id.landmark_rows(np.arange(50), 50, 128)])) == 1 and len(language_id.landmark_rows(np.arange(50), 50, 20)) == 20


def test_three_hundred_languages_within_one_bound(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(12)]
        rows += [(k * 10 + j, " ".join(rng.choice(words) for _ in range(25)), f"l{k:03d}") for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit, rest = docs.filter("doc_id % 10 < 6"), docs.filter("doc_id % 10 >= 6")
    model = language_id.train_language_model(fit, total=1 << 18)
    assert model.marks.shape[1] <= 900 and len(model.labels) >= 290
    got = language_id.identify(rest, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
