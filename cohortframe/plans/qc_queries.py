"""Registered queries of lane QC."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qc
from .book import Book

QUERIES = Book()
add = QUERIES.add

PEAK = """h AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY value) AS i, sum(n) OVER (PARTITION BY lane) AS tot, max(value) OVER (PARTITION BY lane) AS last FROM {hist} WHERE value > 0),
    p AS (SELECT lane, i AS pi, value AS pv FROM h QUALIFY row_number() OVER (PARTITION BY lane ORDER BY n DESC, i) = 1), j AS (SELECT h.*, pi, pv FROM h JOIN p ON p.lane = h.lane),
    d AS (SELECT lane, abs(i - pi) AS d, sum(n) AS n, any_value(tot) AS tot FROM j GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY lane ORDER BY d) AS cum FROM d), w AS (SELECT lane, min(d) AS m FROM c WHERE cum * 100 >= 80 * tot GROUP BY lane),
    peaks AS (SELECT j.lane, any_value(pv) AS peak, 100 * coalesce(sum(n) FILTER (abs(value - pv) * 100 <= pv * 25), 0) / any_value(tot) AS amount, any_value(m) AS m,
      100 * greatest(any_value(pv) - coalesce(max(value) FILTER (i = pi - m), 0), coalesce(max(value) FILTER (i = pi + m), any_value(last)) - any_value(pv)) / any_value(pv) AS reach FROM j JOIN w ON w.lane = j.lane GROUP BY j.lane)"""

add("WIN-9_insert_peak", lambda v: qc.insert_peak(v.insert_hist).select("lane", "peak", F.round("pct_in_window", 4).alias("pct_in_window"), "rows_each_side", F.round("range_pct", 4).alias("range_pct")),
    f", {PEAK.format(hist='insert_hist')} SELECT lane, peak, round(amount, 4) AS pct_in_window, m AS rows_each_side, round(reach, 4) AS range_pct FROM peaks")
add("WIN-9_insert_peak_lanes", lambda v: qc.insert_peak(v.qc_inserts).select("lane", "peak", F.round("pct_in_window", 4).alias("pct_in_window"), "rows_each_side", F.round("range_pct", 4).alias("range_pct")),
    f", {PEAK.format(hist='qc_inserts')} SELECT lane, peak, round(amount, 4) AS pct_in_window, m AS rows_each_side, round(reach, 4) AS range_pct FROM peaks")
add("WIN-10_indel_cycle_check", lambda v: qc.indel_cycle_check(v.lane_stats.select("library", (F.col("lane_no") % 4).alias("series"), F.col("reads_duplicated").alias("n")).withColumnRenamed("library", "lane"), 2),
    """, v AS (SELECT library AS lane, lane_no % 4 AS series, list_sort(list(reads_duplicated)) AS v FROM lane_stats GROUP BY 1, 2) SELECT lane, NOT bool_or(v[len(v)] > 2 * v[len(v) // 2 + 1]) AS passed FROM v GROUP BY lane""")
add("AGG-34_overlap_duplicate_percent", lambda v: qc.overlap_duplicate_percent(v.insert_hist, v.insert_hist.select("lane", F.lit(20).alias("length"))),
    "SELECT lane, round(100 * sum(greatest(0, 40 - value) * n) / sum(40 * n), 1) AS overlap_percent FROM insert_hist WHERE n > 0 GROUP BY lane")
add("AGG-34_overlap_single_length", lambda v: qc.overlap_duplicate_percent(v.qc_inserts, v.qc_lengths),
    """, l AS (SELECT lane, min(length) AS l FROM qc_lengths GROUP BY lane HAVING min(length) = max(length)) SELECT i.lane, round(100 * sum(greatest(0, 2 * l - value) * n) / sum(2 * l * n), 1) AS overlap_percent FROM qc_inserts i JOIN l ON l.lane = i.lane GROUP BY i.lane""")
add("AGG-35_insertion_deletion_ratio", lambda v: qc.insertion_deletion_ratio(v.lane_stats.select(F.col("library").alias("lane"), "n_ins", "n_del")).select("lane", "ratio"), "SELECT library AS lane, round(sum(n_ins) / nullif(sum(n_del), 0), 2) AS ratio FROM lane_stats GROUP BY library")

QC = f"""{PEAK.format(hist='qc_inserts')}, ind AS (SELECT lane, sum(n_ins) AS ins, sum(n_del) AS del FROM qc_indels GROUP BY lane),
    one AS (SELECT lane, min(length) AS l FROM qc_lengths GROUP BY lane HAVING min(length) = max(length)), ov AS (SELECT i.lane, round(100 * sum(greatest(0, 2 * l - value) * n) / sum(2 * l * n), 1) AS ov FROM qc_inserts i JOIN one ON one.lane = i.lane GROUP BY i.lane),
    sv AS (SELECT lane, series, list_sort(list(n)) AS v FROM qc_cycles GROUP BY 1, 2), cy AS (SELECT lane, bool_and(v[len(v)] <= 8 * v[len(v) // 2 + 1]) AS cyc FROM sv GROUP BY lane),
    x AS (SELECT q.*, amount, reach, coalesce(ins, 0) AS ins, coalesce(del, 0) AS del, ov, cyc, i.lane IS NOT NULL AS has_inserts, NOT (sequences = 0 AND total_length = 0) AS full_lane, 100 * bases_mapped / clip_bases AS mapped, 100 * (reads_mapped - rmdup_reads_mapped) / reads_mapped AS dup, 100 * rmdup_reads_mapped / reads_mapped AS proper,
      CASE WHEN gtype_analysis LIKE 'status=%' THEN regexp_extract(gtype_analysis, 'status=(\\S+)', 1) WHEN gtype_analysis IS NOT NULL THEN NULL WHEN genotype_found IS NULL THEN NULL WHEN genotype_found = sample THEN 'confirmed' ELSE 'wrong' END AS st
      FROM qc_lanes q LEFT JOIN peaks ON peaks.lane = q.lane LEFT JOIN ind ON ind.lane = q.lane LEFT JOIN ov ON ov.lane = q.lane LEFT JOIN cy ON cy.lane = q.lane LEFT JOIN (SELECT DISTINCT lane FROM qc_inserts) i ON i.lane = q.lane),
    q AS (SELECT lane, library, t.* FROM x, LATERAL (VALUES ('empty', NOT full_lane, false, NULL), ('npg', npg_status = 'fail', false, NULL), ('genotype', st IS NOT NULL, st LIKE 'confirmed%', NULL), ('mapped_bases', full_lane, mapped >= 90, NULL), ('duplicates', full_lane, dup <= 8, NULL),
      ('proper_pairs', full_lane, proper >= 80, NULL), ('error_rate', true, error_rate <= 0.02, NULL), ('max_indel_ratio', true, del > 0 AND ins <= 0.82::DOUBLE * del, NULL), ('min_indel_ratio', true, del = 0 OR (ins > 0 AND ins >= 0.68::DOUBLE * del), NULL),
      ('insert_size', is_paired AND full_lane AND (reads_paired = 0 OR mean_insert = 0 OR NOT has_inserts), false, NULL), ('insert_size', is_paired AND full_lane AND reads_paired > 0 AND mean_insert > 0 AND has_inserts, true, amount >= 80),
      ('insert_size_reverse', is_paired AND full_lane AND reads_paired > 0 AND mean_insert > 0 AND has_inserts, true, reach <= 25), ('overlap_duplicates', ov IS NOT NULL, ov <= 4, NULL), ('indels_per_cycle', cyc IS NOT NULL, cyc, NULL)) t(test, applies, passed, library_passed) WHERE coalesce(applies, false))"""
_checks = lambda v: qc.auto_qc(v.qc_lanes, v.qc_indels, v.qc_inserts, v.qc_lengths, v.qc_cycles)
add("AGG-33_auto_qc", lambda v: _checks(v).drop("reason").withColumn("library_passed", F.when(F.col("library_passed"), "yes").when(~F.col("library_passed"), "no")), f", {QC} SELECT lane, library, test, passed, CASE WHEN CAST(library_passed AS BOOLEAN) THEN 'yes' WHEN NOT CAST(library_passed AS BOOLEAN) THEN 'no' END AS library_passed FROM q")
add("AGG-33_auto_qc_tests", lambda v: _checks(v).groupBy("test", "passed").agg(F.count("*").alias("n"), F.count_if(~F.col("library_passed")).alias("library_failed")), f", {QC} SELECT test, passed, count(*) AS n, count(*) FILTER (NOT CAST(library_passed AS BOOLEAN)) AS library_failed FROM q GROUP BY 1, 2")
add("AGG-33_lane_verdicts", lambda v: qc.lane_verdicts(_checks(v)), f", {QC} SELECT lane, library, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM q GROUP BY 1, 2")
add("AGG-33_library_verdicts", lambda v: qc.library_verdicts(_checks(v), v.qc_lanes.select("library").distinct().withColumn("status", F.when(F.col("library") == "lib1", "failed"))),
    f""", {QC}, l AS (SELECT library, bool_and(CAST(library_passed AS BOOLEAN)) AS ok FROM q WHERE library_passed IS NOT NULL GROUP BY library), b AS (SELECT DISTINCT library FROM qc_lanes)
      SELECT b.library, CASE WHEN b.library = 'lib1' OR NOT ok THEN 'failed' WHEN ok THEN 'passed' END AS status FROM b LEFT JOIN l ON l.library = b.library""")
# insert sizes of the libraries that end in 2 or 4 are all 250, but in those of 4 one lane in ten keeps its own
_spread = lambda v: v.qc_inserts.join(v.qc_lanes.select("lane", "library"), "lane").withColumn("value", F.when(F.col("library").rlike("2$") | (F.col("library").rlike("4$") & ~F.col("lane").rlike("3$")), F.lit(250).cast("long")).otherwise(F.col("value"))).groupBy("lane", "value").agg(F.sum("n").alias("n"))
NARROW = "narrow AS (SELECT i.lane, CASE WHEN library LIKE '%2' OR (library LIKE '%4' AND i.lane NOT LIKE '%3') THEN 250 ELSE value END AS value, CAST(sum(n) AS BIGINT) AS n FROM qc_inserts i JOIN qc_lanes l ON l.lane = i.lane GROUP BY 1, 2)"
add("AGG-33_library_verdicts_narrow", lambda v: qc.library_verdicts(qc.auto_qc(v.qc_lanes, v.qc_indels, _spread(v), v.qc_lengths, v.qc_cycles), v.qc_lanes.select("library").distinct().withColumn("status", F.when(F.col("library") == "lib12", "failed"))),
    f""", {NARROW}, {PEAK.format(hist='narrow')}, l AS (SELECT library, bool_and(amount >= 80 AND reach <= 25) AS ok FROM qc_lanes q JOIN peaks ON peaks.lane = q.lane WHERE is_paired AND NOT (sequences = 0 AND total_length = 0) AND reads_paired > 0 AND mean_insert > 0 GROUP BY library), b AS (SELECT DISTINCT library FROM qc_lanes)
      SELECT b.library, CASE WHEN b.library = 'lib12' OR NOT ok THEN 'failed' WHEN ok THEN 'passed' END AS status FROM b LEFT JOIN l ON l.library = b.library""")
