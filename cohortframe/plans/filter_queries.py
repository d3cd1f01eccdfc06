"""Registered queries of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import graph as g
from .book import Book

QUERIES = Book()
add = QUERIES.add

RULES = [("all", "dp", "<", 4.0, "MinDP"), ("snp", "qual", "<", 10.0, "LowQual"), ("indel", "vqslod", "<", 0.0, "LowVQ")]

add("FLT-1_filter_by_metadata", lambda v: f.filter_by_metadata(v.files.select("file_id", "path"), v.file_meta, "sample#^s1,platform#HIGH|LOW"),
    """SELECT file_id, path FROM files WHERE file_id IN (SELECT file_id FROM file_meta WHERE key = 'sample' AND regexp_matches(val, '^s1'))
       AND file_id IN (SELECT file_id FROM file_meta WHERE key = 'platform' AND regexp_matches(val, 'HIGH|LOW'))""")
add("FLT-1_filter_after_grouping", lambda v: f.filter_by_metadata(v.files.select("file_id", "path"), v.file_meta, "sample#^s1,library#5", before_grouping=False),
    """SELECT file_id, path, (file_id IN (SELECT file_id FROM file_meta WHERE key = 'sample' AND regexp_matches(val, '^s1'))
       AND file_id IN (SELECT file_id FROM file_meta WHERE key = 'library' AND regexp_matches(val, '5'))) AS passed FROM files""")
add("FLT-2_group_passes_if_any", lambda v: f.group_passes_if_any(v.files.select("file_id", "sample", (F.col("size") > 480000).alias("passed")), "sample"),
    "SELECT file_id, sample, size > 480000 AS passed FROM files WHERE sample IN (SELECT sample FROM files WHERE size > 480000)")


def _ancestors(v):
    starts = v.nodes.filter("label = 'lane'").select("id")
    return starts, g.related(v.edges, starts, "out", 1, 3).join(v.nodes, F.col("node") == F.col("id")).select("start", "label", "prop")


def _by_ancestor(v):
    starts, reached = _ancestors(v)
    return f.filter_by_ancestor(starts, reached, "sample", "^(BUILDING|MACHINERY)$")


add("FLT-3_filter_by_ancestor", _by_ancestor,
    """SELECT concat('o', o_orderkey) AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
add("FLT-4_flag_is", lambda v: v.reads.select(*(F.count_if(f.flag_is(x)).alias(x) for x in ("paired", "proper_pair", "mapped", "mate_mapped", "reverse", "first", "second", "primary", "passes_qc", "duplicate"))),
    """SELECT count(*) FILTER (flag & 1 > 0) AS paired, count(*) FILTER (flag & 2 > 0) AS proper_pair, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 8 = 0) AS mate_mapped,
       count(*) FILTER (flag & 16 > 0) AS reverse, count(*) FILTER (flag & 64 > 0) AS first, count(*) FILTER (flag & 128 > 0) AS second, count(*) FILTER (flag & 256 = 0) AS "primary",
       count(*) FILTER (flag & 512 = 0) AS passes_qc, count(*) FILTER (flag & 1024 > 0) AS duplicate FROM reads""")
add("FLT-5_select_reads", lambda v: f.select_reads(v.reads, {"paired": True, "unmapped": False, "duplicate": False}, 20, library="R", region=("chr2", 1000, 40000)).select("qname", "row_no", "flag", "pos"),
    "SELECT qname, row_no, flag, pos FROM reads WHERE flag & 1 = 1 AND flag & 1028 = 0 AND mapq >= 20 AND lib = 'R' AND rname = 'chr2' AND pos BETWEEN 1000 AND 40000")
add("FLT-6_project_fields", lambda v: f.project_fields(v.reads.withColumn("tags", F.create_map(F.lit("RG"), "rg", F.lit("NM"), F.col("nm").cast("string"))), ["qname", "row_no"], ("RG", "NM", "XX")),
    "SELECT qname, row_no, rg AS \"RG\", CAST(nm AS STRING) AS \"NM\", CAST(NULL AS STRING) AS \"XX\" FROM reads")
add("FLT-7_filter_index", lambda v: f.filter_index(v.index_rows, "HIGH|URGENT", "^low").select("fastq_file", "run_id"),
    "SELECT fastq_file, run_id FROM index_rows WHERE regexp_matches(instrument_platform, 'HIGH|URGENT') AND regexp_matches(analysis_group, '^low') AND withdrawn = 0")
add("FLT-8_filter_lanes", lambda v: f.filter_lanes(v.lane_stats, library="^lib1", gt_status="confirmed$").select("lane"),
    "SELECT lane FROM lane_stats WHERE regexp_matches(library, '^lib1') AND regexp_matches(gt_status, 'confirmed$')")
add("FLT-8_filter_lanes_by_project", lambda v: f.filter_lanes(v.lane_stats.select("lane", "library", "gt_status"), v.samples.select("sample", F.concat(F.lit("study"), F.col("study_id").cast("string")).alias("project")), v.files.select("library", F.concat(F.lit("s"), F.substring("library", 4, 9)).alias("sample")).distinct(), project="study1", sample="^s[1-3]", gt_status="^(confirmed|wrong)$").select("lane"),
    "SELECT lane FROM lane_stats l JOIN samples s ON s.sample = concat('s', substr(library, 4)) WHERE CAST(study_id AS STRING) LIKE '1%' AND regexp_matches(s.sample, '^s[1-3]') AND gt_status IN ('confirmed', 'wrong')")
add("FLT-9_index_lanes", lambda v: f.index_lanes(v.index_rows, "sample_name", "s7", {"instrument_platform": "low"}),
    "SELECT DISTINCT run_id FROM index_rows WHERE sample_name = 's7' AND NOT regexp_matches(lower(instrument_platform), 'low')")
add("FLT-10_search_files_by_metadata", lambda v: f.search_files_by_metadata(v.file_meta, [("sam%", "s1%"), ("library", "lib%"), ("status", "O")]),
    """SELECT file_id FROM file_meta WHERE key LIKE 'sam%' AND val LIKE 's1%' INTERSECT SELECT file_id FROM file_meta WHERE key = 'library' INTERSECT SELECT file_id FROM file_meta WHERE key = 'status' AND val = 'O'""")
add("FLT-11_filter_outputs_exact", lambda v: f.filter_outputs_exact(v.files, "sample=s5,status=O").select("path"), "SELECT path FROM files WHERE sample = 's5' AND status = 'O'")
add("FLT-12_require_keys", lambda v: f.require_keys(v.file_meta, ["sample", "library"]), "SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
add("FLT-13_soft_filter_variants", lambda v: f.soft_filter_variants(v.variants, RULES).select("chrom", "pos", F.array_join("filter", ";").alias("filter")),
    """SELECT chrom, pos, CASE WHEN t = '' THEN 'PASS' ELSE t END AS filter FROM (SELECT chrom, pos, concat_ws(';', CASE WHEN dp < 4 THEN 'MinDP' END,
       CASE WHEN kind = 'snp' AND qual < 10 THEN 'LowQual' END, CASE WHEN kind = 'indel' AND vqslod < 0 THEN 'LowVQ' END) AS t FROM variants)""")
add("FLT-14_vqslod_cutoff", lambda v: f.vqslod_cutoff(v.part.select((F.col("p_partkey") % 100 + 0.5).alias("target_sensitivity"), (F.col("p_size") - 3).cast("double").alias("min_vqslod")), 60.0),
    "SELECT CAST(max(p_size - 3) AS DOUBLE) AS cutoff FROM part WHERE p_partkey % 100 + 0.5 < 60")
add("FLT-14_apply_vqslod", lambda v: f.apply_vqslod(v.variants, 3.0, 8.0).groupBy("kind", "filter").agg(F.count("*").alias("n")),
    "SELECT kind, CASE WHEN vqslod < CASE WHEN kind = 'indel' THEN 8 ELSE 3 END THEN 'LowVQSLOD' ELSE 'PASS' END AS filter, count(*) AS n FROM variants GROUP BY ALL")
add("FLT-15_filter_cnvs", lambda v: f.filter_cnvs(v.cnvs, 10, 200, 905).select("cnv_id"), 'SELECT cnv_id FROM cnvs WHERE num_snps >= 10 AND "end" - "start" + 1 >= 200 AND confidence >= 905')
_cnv_lines = lambda v: v.cnvs.select(F.when(F.col("cnv_id") % 9 == 0, "NOTICE: x").otherwise(F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), (F.col("start") + F.col("num_snps") * 20_000).cast("string"), F.lit("  numsnp="), F.col("num_snps").cast("string"), F.lit("  length="), F.format_number(F.col("num_snps") * 20_000 + 1, 0), F.lit(" state2,cn=1 "), "donor", F.lit(" startsnp=a endsnp=b conf="), (F.col("confidence") % 30).cast("string"), F.lit(".5"))).alias("line"))
add("FLT-15_filter_cnv_lines", lambda v: f.filter_cnvs(f.parse_cnv_lines(_cnv_lines(v)), min_length="130k").select("chrom", F.col("start").alias("a"), F.col("end").alias("b"), "num_snps", "length", "state", "sample", "confidence"),
    """SELECT substr(chrom, 4) AS chrom, "start" AS a, "start" + num_snps * 20000 AS b, CAST(num_snps AS BIGINT) AS num_snps, CAST(num_snps * 20000 + 1 AS BIGINT) AS length, 'state2,cn=1' AS state, donor AS sample, confidence % 30 + 0.5::DOUBLE AS confidence FROM cnvs
       WHERE cnv_id % 9 > 0 AND num_snps >= 10 AND num_snps * 20000 + 1 >= 130000 AND confidence % 30 + 0.5 >= 10""")
add("FLT-16_filter_sequences", lambda v: f.filter_sequences(v.documents, 2000, "text").select("doc_id"), "SELECT doc_id FROM documents WHERE length(text) >= 2000")
add("FLT-17_complete_genotypes_only", lambda v: f.complete_genotypes_only(v.genotypes.withColumn("gt", F.when(F.col("dp") == 1, "./.").otherwise(F.col("gt"))), 11),
    "SELECT chrom, pos FROM genotypes GROUP BY chrom, pos HAVING count(*) FILTER (dp <> 1) = 11")
add("FLT-18_completed_elements", lambda v: f.completed_elements(v.states, 5), "SELECT setup, element FROM states WHERE done = 1 GROUP BY setup, element HAVING count(DISTINCT step) >= 5")
add("FLT-18_completed_all_required", lambda v: f.completed_elements(v.states, 1, True),
    """, p AS (SELECT setup, element, count(DISTINCT CASE WHEN done = 1 THEN step END) >= 1 AS c FROM states GROUP BY 1, 2)
       SELECT setup, element FROM p WHERE setup IN (SELECT setup FROM p GROUP BY setup HAVING bool_and(c))""")
add("FLT-19_strip_tags", lambda v: f.strip_tags(v.reads.select("qname", "row_no", F.create_map(F.lit("RG"), "rg", F.lit("OQ"), "lib", F.lit("NM"), F.col("nm").cast("string")).alias("tags")), ["OQ"])
    .select("qname", "row_no", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("left_tags")), "SELECT qname, row_no, 'NM,RG' AS left_tags FROM reads")
add("FLT-20_select_outputs", lambda v: f.select_outputs(v.step_facts.select("fact_id", "setup", F.col("step"), F.when(F.col("memory") % 2 == 0, "bam").otherwise("txt").alias("kind")), "3[click:bam,view]|7").select("fact_id"),
    "SELECT fact_id FROM step_facts WHERE setup = 3 AND (step = 'click' AND memory % 2 = 0 OR step = 'view') OR setup = 7")
add("FLT-20_select_outputs_and_inputs", lambda v: f.select_outputs(v.step_facts.select("fact_id", "setup", "step", F.when(F.col("memory") % 2 == 0, "bam").otherwise("txt").alias("kind"), F.when(F.col("step") == "click", 1).otherwise(2).alias("step_no")), "3[1:bam,0]|7[0:fq]|2", v.files.select((-F.col("file_id")).alias("fact_id"), (F.col("file_id") % 10).cast("int").alias("setup"), F.when(F.col("file_id") % 3 == 0, "fq").otherwise("bam").alias("kind"))).select("fact_id"),
    "SELECT fact_id FROM step_facts WHERE (setup = 3 AND step = 'click' AND memory % 2 = 0) OR setup = 2 UNION ALL SELECT -file_id FROM files WHERE file_id % 10 = 3 OR (file_id % 10 = 7 AND file_id % 3 = 0)")
