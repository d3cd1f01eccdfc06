"""Cohorts of many samples: sparse matrices and blocked comparison of pairs, against plain loops."""

import random
import time
from itertools import combinations

from cohortframe.operators import cohorts

SCHEMA = "chrom string, pos long, sample string, gt string, dp int"


def test_pairs_against_loops(spark, monkeypatch):
    monkeypatch.setattr(cohorts, "TILE_CALLS", 300)
    rng = random.Random(2)
    rows = [(rng.choice("12"), rng.randint(1, 20), f"s{n:03}", rng.choice(["0/0", "0/1", "1/1", "./.", None]), rng.choice([None, 1, 5, 9, 30])) for n in range(300) for _ in range(rng.randint(1, 5))]
    rows += [("1", 1, "s000", "0/1", 3)] * 2 + [(None, 1, "s001", "0/1", 3), ("1", None, "s002", "0/0", 2)]
    want = {}
    by_site = {}
    for c, p, s, g, d in rows:
        if c is not None and p is not None:
            by_site.setdefault((c, p), []).append((s, g, d))
    for calls in by_site.values():
        for (s, g, d), (t, h, e) in combinations(sorted(calls, key=lambda x: x[0]), 2):
            if s != t:
                w = want.setdefault((s, t), [0, 0, []])
                w[0] += 1
                w[1] += g is not None and h is not None and g != h
                if d is not None or e is not None:
                    w[2].append(min(x for x in (d, e) if x is not None))
    got = {(r.sample_a, r.sample_b): r for r in cohorts.pairwise_discordance(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    for k, (sites, discordant, depths) in want.items():
        r = got[k]
        assert (r.sites, r.discordant, r.type) == (sites, discordant, "fluidigm")
        assert r.avg_min_depth is None if not depths else abs(r.avg_min_depth - sum(depths) / len(depths)) < 1e-9


def matrix_time(spark, n):
    calls = spark.range(n).selectExpr("'1' as chrom", "5L as pos", "'A' as ref", "'C,G' as alt", "concat('s', lpad(id, 6, '0')) as sample", "case when id % 2 = 0 then '0/2' else '1|1' end as gt").filter("substr(sample, -1) <> '7'")
    samples = cohorts.sample_dictionary(spark.range(n).selectExpr("concat('s', lpad(id, 6, '0')) as sample"))
    start = time.time()
    row = cohorts.matrix_rows(cohorts.merge_samples(calls, samples), samples).collect()[0]
    took = time.time() - start
    assert list(row.gts) == ["./." if i % 10 == 7 else "0/2" if i % 2 == 0 else "1|1" for i in range(n)]
    return took


def test_matrix_of_many_samples_grows_in_proportion(spark):
    matrix_time(spark, 100)
    small, large = matrix_time(spark, 5_000), matrix_time(spark, 20_000)
    assert large < 10 * small + 2


def test_greater_genotype_of_a_repeated_call_counts(spark):
    calls = spark.createDataFrame([("1", 5, "A", "C", "x", "0/1"), ("1", 5, "A", "C", "x", "1/1"), ("1", 5, "A", "C", "y", "0/0")], "chrom string, pos long, ref string, alt string, sample string, gt string")
    samples = cohorts.sample_dictionary(calls)
    merged = cohorts.merge_samples(calls, samples)
    assert [tuple(c) for c in merged.collect()[0].calls] == [(0, "1/1"), (1, "0/0")]
    assert sorted((r.sample, r.gt) for r in cohorts.named_calls(merged, samples).collect()) == [("x", "1/1"), ("y", "0/0")]


def test_empty_cohort(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cohorts.pairwise_discordance(none).count() == 0
    calls = spark.createDataFrame([], "chrom string, pos long, ref string, alt string, sample string, gt string")
    samples = cohorts.sample_dictionary(calls)
    assert cohorts.matrix_rows(cohorts.merge_samples(calls, samples), samples).count() == 0
