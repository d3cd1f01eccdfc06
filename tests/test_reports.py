"""Comparisons of samples (JON-21): which pairs a group allows, and that no group is paired with itself."""

import json

import pytest
from pyspark.sql import functions as F

from cohortframe.operators import reports

SAMPLES = "sample string, public_name string, control boolean, donor string, qc_failed boolean"


def most_rows(df) -> int:
    """The rows of the largest step of df's plan, as run."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return most


def compared(spark, results, samples, studies, groups, asked):
    return reports.sample_discordance(
        spark.createDataFrame([(s, "fluidigm", 1, json.dumps(cns)) for s, cns in results.items()], "sample string, type string, date int, cns string"), spark.createDataFrame(samples, SAMPLES),
        spark.createDataFrame(studies, "sample string, study_id int"), spark.createDataFrame(groups, "name string, study_id int"), spark.createDataFrame([(s,) for s in asked], "sample string"),
    )


def test_groups_say_which_pairs_count(spark):
    cns = {"k1": ["1", "20", "2.5", "b"], "k2": ["7", "20", "2.5", "b"], "k3": ["1", "20", "2.5", "c"], "k4": ["1", "20", "2.5", "d"], "k5": ["1", "20", "2.5", "e"], "k6": ["1", "20", "2.5", "f"], "k7": ["1", "20", "2.5", "unknown"]}
    samples = [(s, f"p{s}", s == "b", "d1", s == "f") for s in "abcdef"]
    studies = [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 9), ("f", 1)]
    groups = [("g1", 1), ("g2", 2), ("g2", 3), ("g4", 4), ("all_studies", 1), ("all_studies", 4), ("all_studies", 9), (None, 1), (None, 9)]
    rows = compared(spark, {"a": cns, "b": cns}, samples, studies, groups, ["a", "a"]).collect()
    # two keys of one sample are two comparisons, whatever number of groups allow them; d is in another group, e in that of all studies only, f failed QC
    assert sorted((r.sample, r.other, r.discordance) for r in rows) == [("a", "b", 1.0), ("a", "b", 7.0), ("a", "c", 1.0)]
    assert {r.other: (r["rank"].a, r["rank"].c) for r in rows if r.discordance == 1} == {"b": (False, False), "c": (False, True)}


def ring(spark, n):
    """Each of n samples of one group compared with the next."""
    results = {f"s{i}": {"k": ["1", "20", "2.5", f"s{(i + 1) % n}"]} for i in range(n)}
    return compared(spark, results, [(f"s{i}", f"p{i}", False, "d", False) for i in range(n)], [(f"s{i}", 1) for i in range(n)], [("g", 1)], results)


@pytest.fixture
def planned(spark):
    """Plans stay as they are made, so that their figures can be read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_pairs_but_those_compared(planned):
    df = ring(planned, 2_000)
    assert most_rows(df) == 2_000 and df.count() == 2_000


def test_first_of_each_order(spark):
    """The likely same individual comes first, then sites that agree, controls, public name, and the sample itself."""
    cns = {str(i): x for i, x in enumerate([["2", "16", "1", "b"], ["3", "40", "1", "c"], ["1", "15", "1", "d"], ["2", "16", "1", "e"], ["2", "16", "1", "f"]])}
    for left_out, first in (("", "f"), ("f", "b"), ("fb", "e"), ("fbe", "c"), ("fbec", "d")):
        samples = [(s, "p", s == "f", "d1", s in left_out) for s in "abcdef"]
        df = compared(spark, {"a": cns}, samples, [(s, 1) for s in "abcdef"], [("g", 1)], ["a"])
        assert [tuple(r) for r in df.groupBy("sample").agg(F.min_by("other", "rank")).collect()] == [("a", first)]


def test_first_of_each_makes_no_pairs(planned):
    df = ring(planned, 2_000).groupBy("sample").agg(F.min_by("other", "rank").alias("first"))
    assert most_rows(df) == 2_000 and df.filter("cast(substr(first, 2) as int) = (cast(substr(sample, 2) as int) + 1) % 2000").count() == 2_000
