"""Registered queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators.graph import resolve_files
from .book import Book

QUERIES = Book()
add = QUERIES.add

MEDIAN = """{p}c AS (SELECT {k}, value, n, sum(n) OVER (PARTITION BY {k} ORDER BY value) AS cum, sum(n) OVER (PARTITION BY {k}) AS tot FROM {t}),
    {p}m AS (SELECT {k}, min(value) AS median FROM {p}c WHERE cum >= round_even(tot / 2, 0) GROUP BY {k})"""
add("AGG-1_read_group_stats", lambda v: a.read_group_stats(v.reads),
    f""", i AS (SELECT rg, isize AS value, count(*) AS n FROM reads WHERE flag & 4 = 0 AND flag & 2 > 0 AND mapq > 0 AND isize > 0 GROUP BY 1, 2), {MEDIAN.format(p='i', k='rg', t='i')},
       d AS (SELECT i.rg, abs(value - median) AS value, sum(n) AS n FROM i JOIN im ON i.rg = im.rg GROUP BY 1, 2), {MEDIAN.format(p='d', k='rg', t='d')},
       s AS (SELECT rg, round(sum(value * n) / sum(n), 0) AS mean_insert, round(sqrt(sum(value * value * n) / sum(n) - (sum(value * n) / sum(n)) * (sum(value * n) / sum(n))), 2) AS insert_sd FROM i GROUP BY rg)
       SELECT r.rg, CAST(sum(len) AS BIGINT) AS total_bases, CAST(sum(len) FILTER (flag & 4 = 0) AS BIGINT) AS mapped_bases, count(*) AS total_reads, count(*) FILTER (flag & 4 = 0) AS mapped_reads, count(*) FILTER (flag & 4 = 0 AND flag & 1 > 0) AS mapped_paired,
         count(*) FILTER (flag & 4 = 0 AND flag & 2 > 0) AS proper_pairs, round(100 * sum(nm) FILTER (flag & 4 = 0) / sum(len) FILTER (flag & 4 = 0), 2) AS pct_mismatch, round(sum(sum_qual) FILTER (flag & 4 = 0) / sum(n_qual) FILTER (flag & 4 = 0), 2) AS avg_qual,
         count(*) FILTER (flag & 1024 > 0) AS duplicate_reads, CAST(sum(len) FILTER (flag & 1024 > 0) AS BIGINT) AS duplicate_bases, any_value(mean_insert) AS mean_insert, any_value(insert_sd) AS insert_sd, any_value(im.median) AS median_insert, any_value(dm.median) AS insert_mad
       FROM reads r JOIN s ON s.rg = r.rg JOIN im ON im.rg = r.rg JOIN dm ON dm.rg = r.rg GROUP BY r.rg""")
add("AGG-2_histogram_median", lambda v: a.histogram_median(v.lane_hist, "lane"), f", {MEDIAN.format(p='x', k='lane', t='lane_hist')} SELECT lane, median FROM xm")
add("AGG-2_histogram_quartiles", lambda v: a.histogram_quartiles(v.lane_hist, "lane"),
    ", c AS (SELECT lane, value, sum(n) OVER (PARTITION BY lane ORDER BY value) AS cum, sum(n) OVER (PARTITION BY lane) AS tot FROM lane_hist) SELECT lane, min(value) FILTER (cum >= 0.25 * tot) AS q1, min(value) FILTER (cum >= 0.5 * tot) AS q2, min(value) FILTER (cum >= 0.75 * tot) AS q3 FROM c GROUP BY lane")
add("AGG-2_histogram_mean_sd", lambda v: a.histogram_mean_sd(v.lane_hist, "lane").select("lane", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd")),
    "SELECT concat('rg', l_suppkey % 7) AS lane, round(avg(CAST(l_quantity AS INT)), 4) AS mean, round(stddev_pop(CAST(l_quantity AS INT)), 4) AS sd FROM lineitem GROUP BY 1")
add("AGG-2_histogram_mad", lambda v: a.histogram_mad(v.lane_hist, "lane"),
    f", {MEDIAN.format(p='x', k='lane', t='lane_hist')}, d AS (SELECT h.lane, abs(value - median) AS value, sum(n) AS n FROM lane_hist h JOIN xm ON h.lane = xm.lane GROUP BY 1, 2), {MEDIAN.format(p='d', k='lane', t='d')} SELECT xm.lane, xm.median, dm.median AS mad FROM xm JOIN dm ON xm.lane = dm.lane")
add("AGG-3_bas_totals", lambda v: a.bas_totals(a.read_group_stats(v.reads)),
    """SELECT count(*) AS total_reads, count(*) FILTER (flag & 4 = 0) AS mapped_reads, CAST(sum(len) AS BIGINT) AS total_bases, CAST(sum(len) FILTER (flag & 4 = 0) AS BIGINT) AS mapped_bases, count(*) FILTER (flag & 1024 > 0) AS duplicate_reads,
       CAST(sum(len) FILTER (flag & 1024 > 0) AS BIGINT) AS duplicate_bases, round(100.0 * count(*) FILTER (flag & 4 = 0) / count(*), 2) AS percent_mapped FROM reads""")
add("AGG-4_mean_coverage", lambda v: a.mean_coverage(v.insert_hist.select("lane", (F.col("value") * 20).alias("cov"), "n")),
    "SELECT lane, round(sum(n * value * 20) FILTER (value BETWEEN 1 AND 50) / sum(n) FILTER (value BETWEEN 1 AND 50), 2) AS mean_coverage FROM insert_hist GROUP BY lane")
add("AGG-4_cumulative_coverage", lambda v: a.cumulative_coverage(v.insert_hist.select("lane", (F.col("value") * 20).alias("cov"), "n"), (1, 50, 1000)),
    "SELECT lane, CAST(sum(n) FILTER (value * 20 >= 1) AS BIGINT) AS cov_1, CAST(sum(n) FILTER (value * 20 >= 50) AS BIGINT) AS cov_50, CAST(sum(n) FILTER (value * 20 >= 1000) AS BIGINT) AS cov_1000 FROM insert_hist GROUP BY lane")
add("AGG-5_alignment_summary", lambda v: a.alignment_summary(v.reads),
    """, p AS (SELECT * FROM reads WHERE flag & 256 = 0), s AS (SELECT rg, count(*) AS non_primary_alignments FROM reads WHERE flag & 256 > 0 GROUP BY rg),
       x AS (SELECT rg, count(*) AS raw_reads, count(*) FILTER (flag & 64 > 0) AS first_fragments, count(*) FILTER (flag & 128 > 0) AS last_fragments, count(*) FILTER (flag & 4 = 0) AS reads_mapped, count(*) FILTER (flag & 4 > 0) AS reads_unmapped, count(*) FILTER (flag & 1 > 0) AS reads_paired, count(*) FILTER (flag & 1 = 0) AS reads_unpaired,
         count(*) FILTER (flag & 4 = 0 AND flag & 1 > 0 AND flag & 8 = 0) AS reads_mapped_and_paired, count(*) FILTER (flag & 15 = 3) AS reads_properly_paired, count(*) FILTER (flag & 1024 > 0) AS reads_duplicated, count(*) FILTER (flag & 4 = 0 AND mapq = 0) AS reads_mq0, count(*) FILTER (flag & 512 > 0) AS reads_qc_failed,
         count(*) FILTER (flag & 13 = 1 AND flag & 64 > 0 AND mrnm <> rname) AS pairs_on_different_chromosomes, CAST(sum(len) AS BIGINT) AS total_length, CAST(coalesce(sum(len) FILTER (flag & 4 = 0), 0) AS BIGINT) AS bases_mapped, CAST(sum(100 - row_no % 8) FILTER (flag & 4 = 0) AS BIGINT) AS bases_mapped_cigar,
         CAST(coalesce(sum(len) FILTER (flag & 1024 > 0), 0) AS BIGINT) AS bases_duplicated, CAST(sum(nm) FILTER (flag & 4 = 0) AS BIGINT) AS mismatches, round(sum(nm) FILTER (flag & 4 = 0) / sum(100 - row_no % 8) FILTER (flag & 4 = 0), 6) AS error_rate, round(avg(len), 0) AS average_length, max(len) AS maximum_length, round(sum(sum_qual) / sum(n_qual), 1) AS average_quality FROM p GROUP BY rg)
       SELECT x.*, coalesce(non_primary_alignments, 0) AS non_primary_alignments FROM x LEFT JOIN s ON s.rg = x.rg""")
add("AGG-5_indel_cycle_section", lambda v: a.indel_cycle_section(v.reads),
    """, x AS (SELECT rg, flag & 128 = 0 AS f, CASE WHEN flag & 16 > 0 THEN 8 ELSE 90 END AS cycle FROM reads WHERE flag & 260 = 0) SELECT rg, CAST(cycle AS BIGINT) AS cycle, count(*) FILTER (f) AS ins_first, count(*) FILTER (NOT f) AS ins_last, CAST(0 AS BIGINT) AS del_first, CAST(0 AS BIGINT) AS del_last FROM x GROUP BY 1, 2""")
add("AGG-5_gc_section", lambda v: a.gc_section(v.documents.select("lang", "text", (F.when(F.col("doc_id") % 2 == 0, 64).otherwise(128) + F.when(F.col("doc_id") % 5 == 0, 256).otherwise(0)).alias("flag")), "lang", "text"),
    """, x AS (SELECT lang, doc_id, floor(100 * (length(text) - length(translate(text, 'GCgc', ''))) / length(text)) AS gc FROM documents WHERE length(text) > 0 AND doc_id % 5 > 0) SELECT lang, CAST(gc AS BIGINT) AS gc, count(*) FILTER (doc_id % 2 = 0) AS first, count(*) FILTER (doc_id % 2 = 1) AS last FROM x GROUP BY 1, 2""")
add("AGG-5_base_content_section", lambda v: a.base_content_section(v.documents.select("lang", F.regexp_replace("text", "[^!-~]", "!").alias("seq")), "lang"),
    """, t AS MATERIALIZED (SELECT lang, string_split(regexp_replace(text, '[^!-~]', '!', 'g'), '') AS c FROM documents WHERE length(text) > 0), x AS (SELECT lang, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS cycle FROM t)
       SELECT lang AS key, cycle, count(*) FILTER (lower(c) = 'a') AS a, count(*) FILTER (lower(c) = 'c') AS c, count(*) FILTER (lower(c) = 'g') AS g, count(*) FILTER (lower(c) = 't') AS t, count(*) FILTER (lower(c) NOT IN ('a', 'c', 'g', 't')) AS other FROM x GROUP BY 1, 2""")
add("HLP-3_quality_sums", lambda v: a.with_quality_sums(v.files.select("file_id", F.when(F.col("file_id") % 4 == 0, "*").otherwise(F.col("path")).alias("qual"))).select("file_id", "sum_qual", "n_qual"),
    "SELECT file_id, CAST(CASE WHEN file_id % 4 = 0 THEN 0 ELSE list_sum(list_transform(string_split(path, ''), lambda c: ord(c) - 33)) END AS BIGINT) AS sum_qual, CAST(CASE WHEN file_id % 4 = 0 THEN 0 ELSE length(path) END AS BIGINT) AS n_qual FROM files")
add("AGG-5_insert_size_section", lambda v: a.insert_size_section(v.reads), "SELECT rg, abs(isize) AS insert_size, count(*) AS pairs, count(*) FILTER (flag & 2 > 0) AS inward FROM reads WHERE flag & 64 > 0 AND flag & 12 = 0 GROUP BY 1, 2")
add("AGG-5_indel_section", lambda v: a.indel_section(v.reads), "SELECT rg, CAST(2 AS BIGINT) AS length, count(*) AS insertions, CAST(0 AS BIGINT) AS deletions FROM reads WHERE flag & 4 = 0 GROUP BY rg")
add("AGG-5_read_length_section", lambda v: a.read_length_section(v.reads), "SELECT rg, len AS length, count(*) AS n FROM reads GROUP BY 1, 2")
add("AGG-5_cycle_qualities", lambda v: a.cycle_qualities(v.documents.select(F.col("lang").alias("file"), F.regexp_replace("text", "[^!-~]", "!").alias("qual"))),
    """, t AS MATERIALIZED (SELECT lang, string_split(regexp_replace(text, '[^!-~]', '!', 'g'), '') AS c FROM documents WHERE length(text) > 0), x AS (SELECT lang, unnest(c) AS c, unnest(range(1, len(c) + 1)) AS cycle FROM t)
       SELECT lang AS key, cycle, CAST(ord(c) - 33 AS BIGINT) AS quality, count(*) AS n FROM x GROUP BY 1, 2, 3""")
add("AGG-6_avg_base_quals", lambda v: a.avg_base_quals(v.lane_hist.groupBy(F.col("lane").alias("cycle")).agg(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i * 0).alias("z"), F.array(*(F.coalesce(F.sum(F.when(F.col("value") == i, F.col("n"))), F.lit(0)) for i in range(6))).alias("quals"))),
    "SELECT lane AS cycle, round(coalesce(sum(value * n) FILTER (value < 6) / sum(n) FILTER (value < 6), 0), 2) AS avg_qual FROM lane_hist GROUP BY lane")
add("AGG-7_sequence_stats", lambda v: a.sequence_stats(v.documents.select("lang", F.length("text").alias("len")), "lang"), "SELECT lang, count(*) AS reads, CAST(sum(length(text)) AS BIGINT) AS bases, round(sum(length(text)) / count(*), 2) AS avg_length, max(length(text)) AS max_length FROM documents GROUP BY lang")
add("AGG-8_group_by_metadata", lambda v: a.group_by_metadata(v.file_meta, ["sample", "library"]).select("group", F.array_join("paths", ",").alias("paths")),
    """, w AS (SELECT path, max(CASE WHEN key = 'sample' THEN val END) AS s, max(CASE WHEN key = 'library' THEN val END) AS l FROM file_meta WHERE key IN ('sample', 'library') GROUP BY path)
       SELECT concat_ws('|', s, l) AS "group", string_agg(path, ',' ORDER BY path) AS paths FROM w GROUP BY 1""")
add("AGG-9_group_column", lambda v: a.group_column(v.files, "path", "sample").select("sample", F.array_join("items", ",").alias("items")), "SELECT sample, string_agg(path, ',' ORDER BY path) AS items FROM files GROUP BY sample")
add("AGG-10_group_index", lambda v: a.group_column(v.index_rows, "fastq_file", "run_id").select("run_id", F.array_join("items", ",").alias("items")), "SELECT run_id, string_agg(fastq_file, ',' ORDER BY fastq_file) AS items FROM index_rows GROUP BY run_id")
add("AGG-11_common_metadata", lambda v: a.common_metadata(v.file_meta, v.files.select("file_id", F.col("sample").alias("group")).unionByName(v.files.select("file_id", F.concat_ws("/", "sample", "platform").alias("group")))),
    """, g AS (SELECT sample AS "group", file_id FROM files UNION ALL SELECT concat_ws('/', sample, platform), file_id FROM files), n AS (SELECT "group", count(*) AS n FROM g GROUP BY 1) SELECT g."group", key, min(val) AS val FROM file_meta m JOIN g ON m.file_id = g.file_id JOIN n ON n."group" = g."group" GROUP BY 1, 2, n.n HAVING count(DISTINCT val) = 1 AND count(*) = n.n""")
add("AGG-12_combined_metadata", lambda v: a.combined_metadata(v.file_meta, v.files.select("file_id", F.col("lane").alias("group"))).select("group", "key", F.array_join("vals", ",").alias("vals")),
    """SELECT lane AS "group", key, string_agg(DISTINCT val, ',' ORDER BY val) AS vals FROM file_meta m JOIN files f ON m.file_id = f.file_id GROUP BY 1, 2""")
add("AGG-13_group_lanes", lambda v: a.group_lanes(v.lane_stats.select("lane", "library"), v.files.filter("file_id % 97 <> 0").select(F.concat(F.lit("lane"), F.col("file_id").cast("string")).alias("lane")), "library"),
    "SELECT library, count(*) AS lanes, count(*) AS files FROM lane_stats GROUP BY library HAVING bool_and(lane_no % 97 <> 0)")
add("AGG-14_derive_dedup_stats", lambda v: a.derive_dedup_stats(v.lane_stats.filter("reads_mapped > 0")).select("lane", "reads_after", "bases_after", "bases_mapped_after"),
    "SELECT lane, reads_mapped - reads_duplicated AS reads_after, total_length - bases_duplicated AS bases_after, bases_mapped_cigar - CAST(floor(bases_mapped_cigar * reads_duplicated / reads_mapped) AS BIGINT) AS bases_mapped_after FROM lane_stats WHERE reads_mapped > 0")
_rgs = lambda v: v.files.select((F.col("file_id") % 400).alias("file_id"), F.col("file_id").cast("string").alias("id"), F.when(F.col("file_id") % 3 > 0, "1").alias("pu"), F.concat(F.lit("l"), (F.col("file_id") % 400 % 7).cast("string")).alias("lb"), "sample", F.when(F.col("file_id") % 5 == 0, "").otherwise("SC").alias("cn"), F.col("platform").alias("pl"), F.lit(None).cast("string").alias("ds")).withColumnRenamed("sample", "sm")
add("AGG-15_consensus_rg_metadata", lambda v: a.consensus_rg_metadata(_rgs(v), v.files.filter("file_id < 400").select("file_id", F.md5("path").alias("md5"), F.when(F.col("file_id") % 10 == 0, "own").alias("lane"), F.when(F.col("file_id") % 11 == 0, "ownlib").alias("library"), *(F.lit(None).cast("string").alias(c) for c in ("sample", "center_name", "platform", "study")))),
    """, r AS (SELECT file_id % 400 AS f, count(*) AS n, min(CAST(file_id AS STRING)) AS id, max(CASE WHEN file_id % 3 > 0 THEN '1' END) AS pu, min(sample) AS s0, max(sample) AS s1, max(CASE WHEN file_id % 5 > 0 THEN 'SC' END) AS cn, min(platform) AS p0, max(platform) AS p1 FROM files GROUP BY 1),
       x AS (SELECT f.file_id, md5(path) AS m, n, coalesce(CASE WHEN f.file_id % 10 = 0 THEN 'own' END, CASE WHEN n = 1 THEN coalesce(pu, id) ELSE pu END) AS lane, CASE WHEN f.file_id % 11 = 0 THEN 'ownlib' ELSE concat('l', f.file_id % 7) END AS library, CASE WHEN s0 = s1 THEN s0 END AS sample, cn, CASE WHEN p0 = p1 THEN p0 END AS platform FROM files f JOIN r ON r.f = f.file_id WHERE f.file_id < 400)
       SELECT file_id, CASE WHEN n <> 1 OR lane = '1' THEN m ELSE lane END AS lane, library, sample, cn AS center_name, platform, NULL AS study FROM x""")
add("AGG-15_consensus", lambda v: a.consensus(v.files, "lane", "library", F.md5("lane")), "SELECT lane, CASE WHEN count(DISTINCT library) = 1 THEN min(library) ELSE md5(lane) END AS library FROM files GROUP BY lane")
for merged, sql in ((False, "SELECT run_id AS lane, row_no % 2 AS layout, CAST(sum(read_count) AS BIGINT) AS reads, CAST(sum(base_count) AS BIGINT) AS bases FROM index_rows GROUP BY 1, 2"),
                    (True, "SELECT run_id AS lane, CASE WHEN count(DISTINCT row_no // 7 % 2) = 2 THEN 2 ELSE min(row_no // 7 % 2) END AS layout, CAST(sum(read_count) AS BIGINT) AS reads, CAST(sum(base_count) AS BIGINT) AS bases FROM index_rows GROUP BY 1")):
    add(f"AGG-16_lane_merge_metadata{'_merged' * merged}", lambda v, merged=merged: a.lane_merge_metadata(v.index_rows.select(F.col("run_id").alias("lane"), (F.floor(F.col("row_no") / (7 if merged else 1)) % 2).alias("layout"), F.col("read_count").alias("reads"), F.col("base_count").alias("bases")), merged), sql)
add("AGG-17_max_deviation", lambda v: a.max_deviation(v.scores.select("lane", "sample", (F.col("sites") % 50).alias("discordance"), F.substring("sample", 2, 9).cast("int").alias("row_no")), "lane"),
    "SELECT lane, sample, sites % 50 AS discordance FROM scores QUALIFY row_number() OVER (PARTITION BY lane ORDER BY sites % 50 DESC, CAST(substr(sample, 2) AS INT) DESC) = 1")
def _all_donors(v):
    donors = sorted(r.donor for r in v.cnvs.select("donor").distinct().collect())
    return a.unpivot_cnv_summary(v.cnvs.groupBy(F.col("state").alias("kind")).pivot("donor", donors).agg(F.sum("num_snps")), donors)


add("AGG-19_unpivot_cnv_summary", _all_donors,
    "SELECT k.kind, s.sample, CAST(sum(num_snps) AS BIGINT) AS value FROM (SELECT DISTINCT state AS kind FROM cnvs) k CROSS JOIN (SELECT DISTINCT donor AS sample FROM cnvs) s LEFT JOIN cnvs c ON c.state = k.kind AND c.donor = s.sample GROUP BY ALL")
_summary = lambda v: v.samples.groupBy(F.col("study_id").alias("file")).agg(F.array_sort(F.collect_list("sample")).alias("s")).select("file", F.explode(F.array(*(F.struct(F.lit(n).alias("row_no"), c.alias("cells")) for n, c in enumerate((F.concat(F.array(F.lit("SM")), F.col("s")), F.concat(F.array(F.lit("ND")), F.transform("s", lambda x: F.length(x).cast("string"))),
    F.concat(F.array(*map(F.lit, ("RG", "20", "5", "95", "90", "8.5", "x"))), F.transform("s", lambda x: F.substring(x, -1, 1)))))))).alias("r")).select("file", "r.*")
add("AGG-19_cnv_summary_scalars", lambda v: a.cnv_summary(_summary(v))[0], "SELECT study_id AS file, sample, 'ND' AS kind, CAST(length(sample) AS STRING) AS value FROM samples")
add("AGG-19_cnv_summary_regions", lambda v: a.cnv_summary(_summary(v))[1].select("file", "sample", "chrom", F.col("start").alias("a"), F.col("end").alias("b"), "length", "quality", "cn"), "SELECT study_id AS file, sample, '20' AS chrom, CAST(5 AS BIGINT) AS a, CAST(95 AS BIGINT) AS b, CAST(90 AS BIGINT) AS length, 8.5 AS quality, right(sample, 1) AS cn FROM samples")
add("AGG-20_infer_gender", lambda v: a.infer_gender(v.cnvs.select(F.col("donor").alias("sample"), F.when(F.col("cnv_id") % 11 < 4, "AG").when(F.col("cnv_id") % 11 < 8, "A").when(F.col("cnv_id") % 2 == 0, "").otherwise("CT").alias("genotype"))),
    """, g AS (SELECT donor, CASE WHEN cnv_id % 11 < 4 OR cnv_id % 11 >= 8 AND cnv_id % 2 = 1 THEN 'M' ELSE 'F' END AS g FROM cnvs) SELECT donor AS sample, CASE WHEN min(g) = max(g) THEN min(g) ELSE 'U' END AS gender FROM g GROUP BY donor""")
add("AGG-21_aberrant_chromosomes", lambda v: a.aberrant_chromosomes(v.cnvs.select(F.concat(F.lit("s"), (F.col("cnv_id") % 100).cast("string")).alias("sample"), F.when(F.col("cnv_id") % 5 == 0, "X").otherwise(F.col("chrom")).alias("chrom"), F.when(F.col("num_snps") % 3 == 0, "2.0").when(F.col("num_snps") % 3 == 1, "1.00").otherwise("2.5").alias("cn")), v.samples.select("sample", F.when(F.col("gender") == "male", "M").alias("gender"))).select("sample", F.array_join("aberrant", ",").alias("aberrant")),
    """, c AS (SELECT concat('s', cnv_id % 100) AS sample, CASE WHEN cnv_id % 5 = 0 THEN 'X' ELSE chrom END AS chrom, CASE WHEN num_snps % 3 = 0 THEN '2.0' WHEN num_snps % 3 = 1 THEN '1.00' ELSE '2.5' END AS cn FROM cnvs)
       SELECT c.sample, string_agg(concat(chrom, ':', cn), ',' ORDER BY concat(chrom, ':', cn)) AS aberrant FROM c LEFT JOIN samples s ON s.sample = c.sample WHERE cn = '2.5' OR CAST(substr(cn, 1, 1) AS INT) <> CASE WHEN gender = 'male' AND chrom = 'X' THEN 1 ELSE 2 END GROUP BY c.sample""")
add("AGG-22_substitution_rate", lambda v: a.substitution_rate(v.variants, v.sequences), "SELECT round((SELECT count(*) FROM variants) / (SELECT sum(ln) FROM sequences), 3) AS rate")
add("AGG-22_file_substitution_rates", lambda v: a.file_substitution_rates(v.variants.select(F.concat(F.lit("f"), (F.col("pos") % 40).cast("string")).alias("file")), v.sequences, v.part.select(F.concat(F.lit("f"), (F.col("p_partkey") % 40).cast("string")).alias("file"), F.concat_ws(",", F.concat(F.lit("q"), (F.col("p_partkey") % 7).cast("string")), F.concat(F.lit("r"), F.col("p_partkey").cast("string"))).alias("source"))),
    """, n AS (SELECT concat('f', pos % 40) AS file, round(count(*) / (SELECT sum(ln) FROM sequences), 3) AS rate FROM variants GROUP BY 1), s AS (SELECT DISTINCT concat('f', p_partkey % 40) AS file, unnest([concat('q', p_partkey % 7), concat('r', p_partkey)]) AS path FROM part)
       SELECT file AS path, rate FROM n UNION ALL SELECT path, arg_max(rate, n.file) AS rate FROM n JOIN s ON s.file = n.file GROUP BY path""")
_made = lambda v: v.files.select("file_id", (F.col("file_id") % 4).alias("setup"), (F.col("file_id") % 3).alias("step"), "path", "size", "withdrawn").unionByName(v.files.filter("file_id % 2 = 0").select("file_id", (F.col("file_id") % 4 + 1).alias("setup"), F.lit(9).alias("step"), "path", "size", "withdrawn"))
_usage = lambda df: df.select("disk", "setup", "bytes", "withdrawn_bytes", F.array_join(F.transform(F.array_sort(F.map_entries("by_step")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ";").alias("by_step"))
USAGE = """SELECT disk, setup, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(w) AS BIGINT) AS withdrawn_bytes, string_agg(concat(step, ':', CAST(b AS BIGINT)), ';' ORDER BY step) AS by_step FROM u GROUP BY 1, 2"""
add("AGG-23_disk_usage", lambda v: _usage(a.disk_usage(_made(v))), f", u AS (SELECT substr(path, 1, 5) AS disk, file_id % 4 AS setup, file_id % 3 AS step, sum(size) AS b, coalesce(sum(size) FILTER (withdrawn), 0) AS w FROM files GROUP BY 1, 2, 3) {USAGE}")
add("AGG-23_disk_usage_resolved", lambda v: _usage(a.disk_usage(_made(v), resolve_files(v.moves), v.files)),
    f""", m AS (SELECT file_id, least(file_id + 3 - file_id % 4, (SELECT count(*) FROM orders) - 1) AS now, withdrawn FROM files), u AS (SELECT substr(f.path, 1, 5) AS disk, m.file_id % 4 AS setup, m.file_id % 3 AS step, sum(f.size) AS b, coalesce(sum(f.size) FILTER (m.withdrawn), 0) AS w FROM m JOIN files f ON f.file_id = m.now GROUP BY 1, 2, 3) {USAGE}""")
add("AGG-24_step_stats", lambda v: a.step_stats(v.step_facts), "SELECT step, setup, count(*) AS n, round(avg(time_s), 0) AS mean, round(stddev_pop(time_s), 0) AS sd, max(time_s) AS most, CAST(sum(time_s) AS BIGINT) AS total FROM step_facts GROUP BY GROUPING SETS ((), (step), (setup))")
add("AGG-25_step_percentile", lambda v: a.step_percentile(v.step_facts, 95), """, r AS (SELECT step, time_s, row_number() OVER (PARTITION BY step ORDER BY time_s DESC) AS rn, count(*) OVER (PARTITION BY step) AS n FROM step_facts) SELECT step, time_s AS value FROM r WHERE rn = least(round(n / 100 * 5, 0) + 1, n)""")
add("AGG-25_recommend", lambda v: a.recommend(v.step_facts), """, r AS (SELECT step, memory, row_number() OVER (PARTITION BY step ORDER BY memory DESC) AS rn, count(*) OVER (PARTITION BY step) AS n FROM step_facts) SELECT step, greatest(100, CAST(ceil(memory / 100) AS BIGINT) * 100) AS memory FROM r WHERE n >= 3 AND rn = least(round(n / 100 * 5, 0) + 1, n)""")
add("AGG-26_failure_summary", lambda v: a.failure_summary(v.states), "SELECT setup, step, count(*) AS failures FROM states WHERE failed = 1 GROUP BY 1, 2")
add("AGG-27_setup_progress", lambda v: a.setup_progress(v.states, 5),
    """, p AS (SELECT setup, element, count(DISTINCT CASE WHEN done = 1 THEN step END) >= 5 AS c FROM states GROUP BY 1, 2), g AS (SELECT setup, count(*) AS elements, count(*) FILTER (c) AS complete FROM p GROUP BY setup)
       SELECT setup, elements, complete, CASE WHEN complete = elements THEN 100.0 WHEN complete = 0 THEN 0.0 ELSE least(greatest(round(100 * complete / elements, 2), 0.01), 99.99) END AS percent FROM g""")
add("AGG-28_donor_rollup", lambda v: a.donor_rollup(v.samples),
    """, x AS (SELECT donor, count(*) FILTER (control) AS c, max(CASE WHEN control THEN sample END) AS cs, first(sample ORDER BY length(sample), sample) AS s, max(created) AS latest, count(*) AS samples FROM samples GROUP BY donor)
       SELECT donor, CASE WHEN c = 1 THEN cs ELSE s END AS example, latest, samples FROM x""")
add("AGG-28_donor_rollup_public", lambda v: a.donor_rollup(v.cohort.select("donor", "sample", F.when(F.col("sample_id") % 3 > 0, F.concat(F.lit("name"), "public_name")).otherwise("").alias("public_name"), "control", F.col("sample_id").alias("created"))),
    """, n AS (SELECT donor, control, sample_id, CASE WHEN sample_id % 3 > 0 THEN concat('name', public_name) ELSE sample END AS name FROM cohort), x AS (SELECT donor, count(*) FILTER (control) AS c, max(CASE WHEN control THEN name END) AS cs, first(name ORDER BY length(name), name) AS s, max(sample_id) AS latest, count(*) AS samples FROM n GROUP BY donor)
       SELECT donor, CASE WHEN c = 1 THEN cs ELSE s END AS example, latest, samples FROM x""")
add("AGG-31_variant_summary", lambda v: a.variant_summary(v.variants), "SELECT chrom, count(*) AS records, count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (kind = 'indel') AS indels, count(*) FILTER (kind = 'snp' AND concat(ref, alt) IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (kind = 'snp' AND ref <> alt AND concat(ref, alt) NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM variants GROUP BY chrom")
add("AGG-31_genotype_counts", lambda v: a.genotype_counts(v.genotypes), "SELECT sample, count(*) FILTER (gt = '0/0') AS hom_ref, count(*) FILTER (gt = '0/1') AS het, count(*) FILTER (gt = '1/1') AS hom_alt FROM genotypes GROUP BY sample")
H = "CAST(sum(('0x' || substr(h, {}, 8))::BIGINT) AS BIGINT) AS h{}"
add("AGG-32_change_marker", lambda v: a.change_marker(v.files, ["path", "sample", "status"]), f", x AS (SELECT md5(concat_ws(chr(9), path, sample, status)) AS h FROM files) SELECT count(*) AS n, {', '.join(H.format(8 * i + 1, i) for i in range(4))} FROM x")
add("AGG-36_sequence_total_length", lambda v: a.sequence_total_length(v.sequences), "SELECT CAST(sum(ln) AS BIGINT) AS total FROM sequences")
add("AGG-37_reference_fingerprint", lambda v: a.reference_fingerprint(v.sequences), "SELECT md5(string_agg(m5, '' ORDER BY idx)) AS fingerprint FROM sequences")
DEPTH = "d AS (SELECT sample, pos AS region, chrom, dp AS depth FROM genotypes), r AS (SELECT sample, d.region, CASE WHEN n >= 5 AND m > 0 AND depth > 0 THEN log2(depth / m) END AS log2_ratio FROM d JOIN (SELECT region, median(depth) AS m, count(DISTINCT sample) AS n FROM d GROUP BY region) x ON d.region = x.region)"
_depth = lambda v: a.log2_ratio(v.genotypes.select("sample", F.col("pos").alias("region"), "chrom", F.col("dp").alias("depth")), 5)
add("AGG-38_log2_ratio", lambda v: _depth(v).withColumn("log2_ratio", F.round("log2_ratio", 6)), f", {DEPTH} SELECT sample, region, round(log2_ratio, 6) AS log2_ratio FROM r")
add("AGG-38_log2_ratio_rpkm", lambda v: a.log2_ratio(v.genotypes.select("sample", F.col("pos").alias("region"), F.when(F.col("pos") % 9 == 0, "X").otherwise(F.col("chrom")).alias("chrom"), F.lit(1).alias("depth"), (F.col("dp") * 2.0).alias("rpkm")), 5, use_rpkm=True).withColumn("log2_ratio", F.round("log2_ratio", 6)),
    """, d AS (SELECT sample, pos AS region, dp * 2.0::DOUBLE AS depth FROM genotypes WHERE pos % 9 > 0) SELECT sample, d.region, CASE WHEN n >= 5 AND m > 0 AND depth > 0 THEN round(log2(depth / m), 6) END AS log2_ratio FROM d JOIN (SELECT region, median(depth) AS m, count(DISTINCT sample) AS n FROM d GROUP BY region) x ON d.region = x.region""")
add("AGG-38_sample_means", lambda v: a.sample_means(_depth(v)).withColumn("mean", F.round("mean", 6)), f", {DEPTH} SELECT sample, round(avg(log2_ratio), 6) AS mean FROM r GROUP BY sample")
_calls = lambda v: v.part.select(F.concat(F.lit("s"), (F.col("p_partkey") % 12).cast("string")).alias("sample"), F.col("p_partkey").alias("call"), F.concat(F.lit("chr"), (F.col("p_size") % 5 + 1).cast("string")).alias("chrom"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") * 3).alias("end"))
add("AGG-39_call_mean_mad", lambda v: a.call_mean_mad(_depth(v).filter("log2_ratio is not null").join(v.genotypes.select("sample", F.col("pos").alias("region"), "chrom"), ["sample", "region"]).withColumn("start", F.col("region")).withColumn("end", F.col("region") + 1), _calls(v)).select("sample", "call", F.round("mean", 6).alias("mean"), F.round("mad", 6).alias("mad")),
    f""", {DEPTH}, q AS (SELECT r.sample, r.region, chrom, log2_ratio FROM r JOIN genotypes g ON g.sample = r.sample AND g.pos = r.region WHERE log2_ratio IS NOT NULL), c AS (SELECT concat('s', p_partkey % 12) AS sample, p_partkey AS call, concat('chr', p_size % 5 + 1) AS chrom, p_partkey AS a, p_partkey + p_size * 3 AS b FROM part),
       x AS (SELECT c.sample, call, log2_ratio FROM q JOIN c ON c.sample = q.sample AND c.chrom = q.chrom AND region <= b AND region + 1 >= a), m AS (SELECT sample, call, avg(log2_ratio) AS mean, median(log2_ratio) AS med FROM x GROUP BY 1, 2)
       SELECT x.sample, x.call, round(any_value(mean), 6) AS mean, round(median(abs(log2_ratio - med)), 6) AS mad FROM x JOIN m ON m.sample = x.sample AND m.call = x.call GROUP BY 1, 2""")
add("AGG-39_mean_mad", lambda v: a.mean_mad(_depth(v).filter("log2_ratio is not null")).select("sample", F.round("mean", 6).alias("mean"), F.round("mad", 6).alias("mad")),
    f", {DEPTH}, q AS (SELECT * FROM r WHERE log2_ratio IS NOT NULL), m AS (SELECT sample, avg(log2_ratio) AS mean, median(log2_ratio) AS med FROM q GROUP BY sample) SELECT q.sample, round(any_value(mean), 6) AS mean, round(median(abs(log2_ratio - med)), 6) AS mad FROM q JOIN m ON m.sample = q.sample GROUP BY q.sample")
add("AGG-40_reference_gc", lambda v: a.reference_gc(v.documents.select(F.col("text").alias("seq")), 100),
    """, w AS (SELECT substr(text, a::INT, 100) AS w FROM documents, unnest(range(1, length(text) + 1, 100)) t(a)) SELECT CAST(floor(100 * (length(w) - length(translate(w, 'GCgc', ''))) / length(w)) AS BIGINT) AS gc_percent, count(*) AS windows FROM w WHERE length(w) > 0 GROUP BY 1""")
add("AGG-40_reference_gc_targets", lambda v: a.reference_gc(v.documents.select(F.col("doc_id").alias("sn"), F.col("text").alias("seq")), 50, targets=v.documents.select(F.col("doc_id").alias("sn"), (F.col("doc_id") % 90).alias("start"), (F.col("doc_id") % 90 + 130).alias("end"))),
    """, t AS (SELECT text, greatest(doc_id % 90, 1) AS a, least(doc_id % 90 + 130, length(text)) AS b FROM documents), w AS (SELECT substr(text, i::INT, least(50, b - i + 1)::INT) AS w FROM t, unnest(range(a, b + 1, 50)) x(i))
       SELECT CAST(floor(100 * (length(w) - length(translate(w, 'GCgc', ''))) / length(w)) AS BIGINT) AS gc_percent, count(*) AS windows FROM w WHERE length(w) > 0 GROUP BY 1""")
add("AGG-41_batch_by_region", lambda v: a.batch_by_region(v.files.select("file_id", F.concat(F.lit("c"), (F.col("file_id") % 5).cast("string")).alias("chrom"), (F.col("file_id") % 2).alias("from"), F.lit(9).alias("to")), 100),
    """, x AS (SELECT file_id, concat('c', file_id % 5, '_', file_id % 2, '_9') AS "group" FROM files) SELECT file_id, "group", (row_number() OVER (PARTITION BY "group" ORDER BY file_id) - 1) // 100 AS batch FROM x""")
