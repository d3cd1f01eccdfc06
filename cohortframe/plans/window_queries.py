"""Registered queries of windows, sorts, verdicts and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import windows as w
from ..operators.ordering import with_place
from .book import Book

QUERIES = Book()
add = QUERIES.add


def _expected(v):
    return v.scores.select("lane").distinct().filter("lane not like '%7'").select("lane", F.concat(F.lit("s"), (F.substring("lane", 5, 9).cast("int") % 20).cast("string")).alias("expected"))


EXPECTED = "e AS (SELECT DISTINCT lane, concat('s', CAST(substr(lane, 5) AS INT) % 20) AS expected FROM scores WHERE lane NOT LIKE '%7')"
add("WIN-1_genotype_verdict", lambda v: w.genotype_verdict(v.scores, _expected(v), 1.05, 30, 500).select("lane", "best", "next", "ratio", "verdict"),
    f""", {EXPECTED}, r AS (SELECT s.*, expected, row_number() OVER (PARTITION BY s.lane ORDER BY score DESC, CASE WHEN sample = expected THEN 1 ELSE 0 END, sample) AS n FROM scores s LEFT JOIN e ON e.lane = s.lane),
       g AS (SELECT lane, max(sample) FILTER (n = 1) AS best, max(score) FILTER (n = 1) AS b, max(sites) FILTER (n = 1) AS sites, max(sample) FILTER (n = 2) AS nx, max(score) FILTER (n = 2) AS c, max(expected) AS expected, max(score) FILTER (sample = expected) AS es FROM r GROUP BY lane),
       h AS (SELECT *, CAST(round(CAST(b / CASE WHEN coalesce(c, 0) = 0 THEN 1e-6 ELSE c END AS DECIMAL(24, 9)), 2) AS DOUBLE) AS ratio, coalesce(es = b, false) AS tie, b >= 500 AND sites >= 30 AS good FROM g)
       SELECT lane, best, nx AS next, ratio, CASE WHEN es IS NULL AND ratio >= 1.05 AND good THEN 'candidate' WHEN expected IS NULL THEN 'unknown' WHEN tie AND ratio >= 1.05 AND good THEN 'confirmed' WHEN tie THEN 'unconfirmed' WHEN ratio >= 1.05 AND good THEN 'wrong' ELSE 'unconfirmed' END AS verdict FROM h""")
add("WIN-2_latest_per", lambda v: w.latest_per(v.messages.select("subject", "message", F.col("event_id").alias("date")), ["subject", "message"], "date"), "SELECT subject, message, max(event_id) AS date FROM messages GROUP BY 1, 2")
add("WIN-5_split_by_bases", lambda v: w.split_by_bases(v.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("row_no"), F.length("text").cast("long").alias("bases")), 10_000),
    """, d AS (SELECT source AS file, length(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
       r AS (SELECT file, i, b, b AS held, 1 AS chunk FROM d WHERE i = 1 UNION ALL SELECT d.file, d.i, d.b, CASE WHEN r.held > 0 AND r.held + d.b > 10000 THEN d.b ELSE r.held + d.b END, CASE WHEN r.held > 0 AND r.held + d.b > 10000 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN d ON d.file = r.file AND d.i = r.i + 1)
       SELECT file, CAST(chunk AS BIGINT) AS chunk, count(*) AS reads, CAST(sum(b) AS BIGINT) AS bases, round(sum(b) / count(*), 2) AS avg_length FROM r GROUP BY 1, 2""")
add("WIN-6_split_by_reads", lambda v: w.split_by_reads(v.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("row_no")), 1000, 90.0).groupBy("file", "chunk").agg(F.count("*").alias("n"), F.min("row_no").alias("first")),
    """, d AS (SELECT source AS file, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 11 + 1 AS chunk FROM documents) SELECT file, chunk, count(*) AS n, min(doc_id) AS first FROM d GROUP BY 1, 2""")
add("WIN-7_fill_read_group", lambda v: w.fill_read_group(v.messages.select(F.col("subject").alias("file"), F.col("event_id").alias("row_no"), F.when(F.col("event_id") % 3 == 0, F.col("message")).alias("rg"))),
    "SELECT subject AS file, event_id AS row_no, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN message END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY event_id), '*') AS rg FROM messages")
add("WIN-8_number_pairs", lambda v: w.number_pairs(v.orders.select(F.col("o_orderkey").alias("row_no"), F.concat(F.lit("1:s"), (F.col("o_custkey") % 30).cast("string")).alias("sample_a"), F.concat(F.lit("s"), (F.col("o_orderkey") % 30).cast("string")).alias("sample_b"))).select("row_no", "occurrence"),
    """, x AS (SELECT o_orderkey AS row_no, concat('s', o_custkey % 30) AS a, concat('s', o_orderkey % 30) AS b FROM orders) SELECT row_no, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY row_no) AS occurrence FROM x""")
add("WIN-11_sample_offsets", lambda v: w.sample_offsets(v.files.select("sample", F.col("size").alias("reads"))),
    """, p AS (SELECT sample, sum(size) AS r FROM files GROUP BY sample) SELECT sample, CAST(sum(r) OVER (ORDER BY sample) - r AS BIGINT) AS "start", CAST(sum(r) OVER (ORDER BY sample) - 1 AS BIGINT) AS "end" FROM p""")
add("WIN-12_select_for_consistency_check", lambda v: w.select_for_consistency_check(v.lane_stats.select("lane", "library", F.col("total_length").alias("bases"), F.col("lane_no").alias("row_no"), (F.col("gt_status") == "confirmed").alias("confirmed")), 2_000_000_000, 500_000_000).select("lane"),
    """, x AS (SELECT lane, gt_status = 'confirmed' AS c, sum(total_length) OVER (PARTITION BY library) AS tot, coalesce(sum(CASE WHEN gt_status = 'confirmed' THEN total_length END) OVER (PARTITION BY library ORDER BY lane_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lane_stats)
       SELECT lane FROM x WHERE tot >= 2000000000 AND (NOT c OR b < 500000000)""")
add("WIN-12_select_targeted", lambda v: w.select_for_consistency_check(v.lane_stats.select("lane", "library", F.col("total_length").alias("bases"), F.when(F.col("lane_no") % 3 == 0, F.col("reads_paired") * 10).otherwise(0).alias("targeted_bases"), F.col("lane_no").alias("row_no"), (F.col("gt_status") == "confirmed").alias("confirmed")), 300_000_000, 100_000_000).select("lane"),
    """, y AS (SELECT *, CASE WHEN lane_no % 3 = 0 AND reads_paired > 0 THEN reads_paired * 10 ELSE total_length END AS b0 FROM lane_stats), x AS (SELECT lane, gt_status = 'confirmed' AS c, sum(b0) OVER (PARTITION BY library) AS tot,
       coalesce(sum(CASE WHEN gt_status = 'confirmed' THEN b0 END) OVER (PARTITION BY library ORDER BY lane_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM y) SELECT lane FROM x WHERE tot >= 300000000 AND (NOT c OR b < 100000000)""")
add("WIN-13_confirm_library", lambda v: w.confirm_library(v.scores, _expected(v)), f""", {EXPECTED}, t AS (SELECT s.lane, max(score) AS top, max(score) FILTER (sample = expected) AS own FROM scores s LEFT JOIN e ON e.lane = s.lane GROUP BY s.lane) SELECT lane, coalesce(own = top, false) AS confirmed FROM t""")
add("WIN-14_mark_duplicates", lambda v: w.mark_duplicates(v.reads.withColumn("pos", F.col("pos") % 50)).groupBy("lib", "flag").agg(F.count("*").alias("n")),
    """, x AS (SELECT *, pos % 50 AS q FROM reads), e AS (SELECT lib, qname, list_sort(list(DISTINCT concat(rname, ':', CASE WHEN flag & 16 > 0 THEN q + 98 - row_no % 8 - 1 ELSE q - row_no % 8 END, ':', flag & 16))) AS sig, sum(sum_qual) AS s FROM x WHERE flag & 260 = 0 GROUP BY 1, 2),
       d AS (SELECT lib, qname FROM e QUALIFY row_number() OVER (PARTITION BY lib, sig ORDER BY s DESC, qname DESC) > 1)
       SELECT x.lib, CAST((flag & ~1024) | CASE WHEN d.qname IS NOT NULL AND flag & 260 = 0 THEN 1024 ELSE 0 END AS INT) AS flag, count(*) AS n FROM x LEFT JOIN d ON d.lib = x.lib AND d.qname = x.qname GROUP BY ALL""")
# sorts of whole tables, with each row's place
add("SRT-1_sort_coordinate", lambda v: with_place(w.sort_coordinate(v.reads.select("qname", "rname", "pos", "flag"), v.sequences)).select("qname", F.when(F.col("flag").bitwiseAND(F.lit(4)) == 0, F.col("rname")).alias("rname"), "pos", "place"),
    "SELECT qname, CASE WHEN flag & 4 = 0 THEN rname END AS rname, pos, row_number() OVER (ORDER BY CASE WHEN flag & 4 > 0 THEN NULL ELSE idx END NULLS LAST, pos, qname) AS place FROM reads LEFT JOIN sequences ON sn = rname")
add("SRT-3_sort_variants", lambda v: with_place(w.sort_variants(v.variants.select("chrom", "pos"))), "SELECT chrom, pos, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), pos) AS place FROM variants")
add("SRT-4_order_parts", lambda v: with_place(w.order_parts(v.files.select("path", F.col("file_id").cast("string").alias("seq_no")))), "SELECT path, CAST(file_id AS STRING) AS seq_no, row_number() OVER (ORDER BY file_id) AS place FROM files")
add("SRT-5_report_order", lambda v: with_place(w.report_order(v.variants.select("chrom", "qual", "pos"), "~chrom", "-qual", "pos")), "SELECT chrom, qual, pos, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), qual DESC, pos) AS place FROM variants")
add("SRT-2_sort_by_name", lambda v: w.sort_by_name(v.reads.select("qname", "flag", "row_no")), "SELECT qname, flag, row_no FROM reads")
add("SRT-2_shuffle_by_name", lambda v: w.shuffle_by_name(v.reads.select("qname", "flag", "row_no")), "SELECT qname, flag, row_no FROM reads")
add("SRT-6_limit_files", lambda v: w.limit_files(v.files, 25).select("file_id", "path"), "SELECT file_id, path FROM files ORDER BY file_id LIMIT 25")
add("UDF-1_apply_records", lambda v: w.apply_records(v.reads.select("qname", "row_no", "mapq"), lambda pdf: pdf.assign(mapq=pdf["mapq"].clip(upper=30)), "qname string, row_no long, mapq int"), "SELECT qname, row_no, least(mapq, 30) AS mapq FROM reads")
add("UDF-3_with_overrides", lambda v: w.with_overrides(v.regions.select("chrom", F.col("start").alias("from"), F.col("end").alias("to"), F.lit("-q 1").alias("opts")), v.regions.filter("region like '%7'").select(F.concat_ws("", "chrom", F.lit("_"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("key"), F.lit("-q 9").alias("opts")), "opts").select("key", "opts"),
    """SELECT concat(chrom, '_', "start", '-', "end") AS key, CASE WHEN region LIKE '%7' THEN '-q 9' ELSE '-q 1' END AS opts FROM regions""")

SCALARS = {
    "strand_complement": (lambda v: v.variants.select("chrom", "pos", s.strand_complement(F.concat("ref", "alt")).alias("x")), "SELECT chrom, pos, translate(concat(ref, alt), 'ATGC', 'TACG') AS x FROM variants"),
    "split_sample_identifier": (lambda v: v.samples.select("sample", s.split_sample_identifier(F.concat(F.lit("a_b_"), "sample", F.when(F.col("control"), "_CTRL").otherwise(""))).alias("x")).select("sample", "x.name", "x.rest", "x.control"), "SELECT sample, 'a_b' AS name, sample AS rest, control FROM samples"),
    "dcc_filename": (lambda v: v.index_rows.select("row_no", s.dcc_filename(F.col("sample_name"), F.lit("20"), F.lit("ILLUMINA"), F.lit("bwa"), F.lit(None).cast("string"), F.col("analysis_group"), F.lit("20110521")).alias("x")), "SELECT row_no, concat_ws('.', sample_name, 'chrom20', 'ILLUMINA', 'bwa', replace(analysis_group, ' ', '_'), '20110521', 'bam') AS x FROM index_rows"),
    "region_name": (lambda v: v.regions.select("region", s.region_name(F.col("chrom"), F.col("start"), F.col("end")).alias("x")), """SELECT region, concat(chrom, '_', "start", '-', "end") AS x FROM regions"""),
    "parse_region": (lambda v: v.regions.select("region", s.parse_region(s.region_name(F.col("chrom"), F.col("start"), F.col("end"))).alias("x")).select("region", "x.*"), """SELECT region, chrom, "start", "end" FROM regions"""),
    "template_basename": (lambda v: v.files.select("file_id", s.template_basename("%sample%.%x%.bam", {"sample": F.col("sample"), "x": F.when(F.col("file_id") % 2 == 0, F.col("lane"))}, (("^s", "S"),)).alias("x")), "SELECT file_id, concat('S', substr(sample, 2), '.', CASE WHEN file_id % 2 = 0 THEN lane ELSE 'unknown' END, '.bam') AS x FROM files"),
    "paths": (lambda v: v.files.select("file_id", s.basename(F.col("path")).alias("base"), s.without_extension(F.col("path")).alias("stem"), s.join_path(F.lit("/root/"), F.col("path")).alias("joined")), "SELECT file_id, concat('f', file_id, '.bam') AS base, replace(path, '.bam', '') AS stem, concat('/root', path) AS joined FROM files"),
    "mapping_program": (lambda v: v.files.select("file_id", s.mapping_program(F.array(F.lit("GATK"), F.when(F.col("file_id") % 2 == 0, "bwa_aln").otherwise("Smalt"))).alias("x")), "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'bwa' ELSE 'smalt' END AS x FROM files"),
    "rg_line": (lambda v: v.files.select("file_id", s.rg_line({"ID": F.col("lane"), "LB": F.when(F.col("file_id") % 2 == 0, F.col("library")), "SM": F.col("sample")}).alias("x")), "SELECT file_id, concat_ws(chr(9), '@RG', concat('ID:', lane), CASE WHEN file_id % 2 = 0 THEN concat('LB:', library) END, concat('SM:', sample)) AS x FROM files"),
    "qual_to_ints": (lambda v: v.files.select("file_id", F.aggregate(s.qual_to_ints(F.col("lane")), F.lit(0), lambda a, x: a + x).alias("x")), "SELECT file_id, CAST(list_sum(list_transform(string_split(lane, ''), lambda c: ord(c) - 33)) AS INT) AS x FROM files"),
    "cigar_lengths": (lambda v: v.reads.select("qname", "row_no", s.seq_length(F.col("cigar")).alias("seq"), s.mapped_length(F.col("cigar")).alias("mapped")), "SELECT qname, row_no, CAST(100 AS BIGINT) AS seq, 98 - row_no % 8 AS mapped FROM reads"),
    "set_diff_text": (lambda v: v.files.select("file_id", s.set_diff_text(F.array("sample", "lane"), F.array("lane", F.when(F.col("file_id") % 2 == 0, F.col("sample")).otherwise(F.lit("new")))).alias("x")), "SELECT file_id, CASE WHEN file_id % 2 = 1 THEN concat('-', sample, ' +new') END AS x FROM files"),
    "tags_to_map": (lambda v: v.reads.select("qname", "row_no", s.tags_to_map(F.concat(F.lit("RG:Z:"), "rg", F.lit("\tNM:i:"), F.col("nm").cast("string")))["NM"].alias("x")), "SELECT qname, row_no, CAST(nm AS STRING) AS x FROM reads"),
    "decode_flags": (lambda v: v.reads.select("qname", "row_no", F.array_join(s.decode_flags(F.col("flag")), ",").alias("x")), """SELECT qname, row_no, concat_ws(',', CASE WHEN flag & 1 > 0 THEN 'paired' END, CASE WHEN flag & 2 > 0 THEN 'proper_pair' END, CASE WHEN flag & 4 > 0 THEN 'unmapped' END, CASE WHEN flag & 8 > 0 THEN 'mate_unmapped' END, CASE WHEN flag & 16 > 0 THEN 'reverse' END,
        CASE WHEN flag & 64 > 0 THEN 'first' END, CASE WHEN flag & 128 > 0 THEN 'second' END, CASE WHEN flag & 256 > 0 THEN 'secondary' END, CASE WHEN flag & 512 > 0 THEN 'failed_qc' END, CASE WHEN flag & 1024 > 0 THEN 'duplicate' END) AS x FROM reads"""),
    "json_payloads": (lambda v: v.step_facts.select("fact_id").join(v.events.select(F.col("event_id").alias("fact_id"), F.from_json("props", "k int")["k"].alias("k")), "fact_id").select("fact_id", F.to_json(F.struct("k")).alias("x")), "SELECT event_id AS fact_id, concat('{\"k\":', json_extract(props, '$.k'), '}') AS x FROM events"),
    "truncate": (lambda v: v.samples.select("sample", s.truncate((F.col("created") - 500) / 7).alias("x")), "SELECT sample, CAST(trunc((created - 500) / 7) AS BIGINT) AS x FROM samples"),
    "megabytes_text": (lambda v: v.files.select("file_id", s.megabytes_text(F.col("size") * 40).alias("x")), "SELECT file_id, CASE WHEN size * 40 / 1048576 > 10 THEN CAST(CAST(round(size * 40 / 1048576, 0) AS BIGINT) AS STRING) ELSE printf('%.1f', round(size * 40 / 1048576, 1)) END AS x FROM files"),
    "duration_text": (lambda v: v.files.select("file_id", s.duration_text(F.col("size")).alias("x")), "SELECT file_id, concat(size // 86400, ' days, ', size % 86400 // 3600, ' hrs, ', size % 3600 // 60, ' mins, ', size % 60, ' secs') AS x FROM files"),
    "dates": (lambda v: v.files.select("file_id", s.epoch_to_date(F.col("size") * 3000).alias("x"), s.date_to_epoch(s.epoch_to_date(F.col("size") * 3000)).alias("y")), "SELECT file_id, strftime(make_timestamp(size * 3000 * 1000000), '%Y-%m-%d') AS x, size * 3000 // 86400 * 86400 AS y FROM files"),
    "report_time": (lambda v: v.files.select("file_id", F.unix_timestamp(s.report_time(F.concat(F.lit("Mon Sep  7 10:11:"), F.lpad((F.col("file_id") % 60).cast("string"), 2, "0"), F.lit(" 2015")))).alias("x")), "SELECT file_id, 1441620660 + file_id % 60 AS x FROM files"),
    "md5_keys": (lambda v: v.files.select("file_id", s.md5_key(F.col("sample"), F.col("lane")).alias("x"), s.content_address(F.array("path", "lane")).alias("y")), "SELECT file_id, md5(concat(sample, '::', lane)) AS x, md5(concat(least(path, lane), '.', greatest(path, lane))) AS y FROM files"),
    "natural_order": (lambda v: v.sequences.select("sn", F.row_number().over(Window.orderBy(s.natural_key(F.col("sn")))).alias("x")), "SELECT sn, CAST(idx AS BIGINT) AS x FROM sequences"),
}
for name, (plan, sql) in SCALARS.items():
    add(f"SCALAR_{name}", plan, sql)
