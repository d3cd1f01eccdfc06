"""Queries over whole tables give a row for each row of their table, and orders place every one."""

import pytest

from cohortframe.plans import registry
from cohortframe.plans.views import Views

from .test_queries import FOLDER


@pytest.mark.parametrize(("name", "view"), [("SRT-1_sort_coordinate", "reads"), ("SRT-3_sort_variants", "variants"), ("SRT-4_order_parts", "files"), ("SRT-5_report_order", "variants")])
def test_sorts_place_every_row(spark, name, view):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several range partitions
    try:
        places = [r.place for r in registry.queries()[name](spark, FOLDER).select("place").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(places) == list(range(1, getattr(Views(spark, FOLDER), view).count() + 1))


def test_every_library_has_a_verdict(spark):
    got = {r.library: r.status for r in registry.queries()["AGG-33_library_verdicts_narrow"](spark, FOLDER).collect()}
    lanes = Views(spark, FOLDER).qc_lanes
    assert set(got) == {r.library for r in lanes.select("library").distinct().collect()} and {"passed", "failed"} <= set(got.values())


def test_every_check_is_met(spark):
    met = {(r.test, r.passed) for r in registry.queries()["AGG-33_auto_qc_tests"](spark, FOLDER).collect()}
    assert {t for t, _ in met} == {"empty", "npg", "genotype", "mapped_bases", "duplicates", "proper_pairs", "error_rate", "max_indel_ratio", "min_indel_ratio", "insert_size", "insert_size_reverse", "overlap_duplicates", "indels_per_cycle"}
    assert all((t, False) in met for t, _ in met if t != "insert_size_reverse")


@pytest.mark.parametrize(("name", "view"), [("SCALAR_decode_flags", "reads"), ("SCALAR_report_time", "files"), ("JON-5_add_to_all_elements", "files")])
def test_a_row_for_each_row(spark, name, view):
    assert registry.queries()[name](spark, FOLDER).count() == getattr(Views(spark, FOLDER), view).count()


def test_every_donor_is_unpivoted(spark):
    got = registry.queries()["AGG-19_unpivot_cnv_summary"](spark, FOLDER)
    assert {r["sample"] for r in got.collect()} == {r.donor for r in Views(spark, FOLDER).cnvs.select("donor").distinct().collect()}
