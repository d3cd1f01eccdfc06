"""Registered queries of the interval operators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import intervals as i
from ..sources.paths import new_dir
from ..sources.text import read_ploidy
from .book import Book

QUERIES = Book()
add = QUERIES.add

add("JON-1_reads_to_regions", lambda v: i.reads_to_regions(v.reads, v.regions).groupBy("region").agg(F.count("*").alias("n"), F.sum("row_no").alias("rows_sum")),
    """SELECT region, count(*) AS n, CAST(sum(row_no) AS BIGINT) AS rows_sum FROM reads JOIN regions ON rname = chrom AND pos BETWEEN "start" AND "end" GROUP BY region""")
add("JON-1_with_mates", lambda v: i.reads_to_regions(v.reads, v.regions, True).groupBy("region").agg(F.count("*").alias("n")),
    """, x AS (SELECT qname, row_no, flag, region FROM reads JOIN regions ON rname = chrom AND pos BETWEEN "start" AND "end"
               UNION SELECT qname, row_no, flag, region FROM reads JOIN regions ON mrnm = chrom AND mpos BETWEEN "start" AND "end")
       SELECT region, count(*) AS n FROM x GROUP BY region""")
add("JON-2_reads_to_sequence_groups", lambda v: i.reads_to_sequence_groups(v.reads, i.sequence_groups(v.sequences, {"chr[12]$": "small"}), True, True).groupBy("prefix").agg(F.count("*").alias("n")),
    """, g AS (SELECT sn, CASE WHEN sn IN ('chr1', 'chr2') THEN 'small' ELSE sn END AS prefix FROM sequences),
       x AS (SELECT qname, row_no, flag, prefix FROM reads JOIN g ON rname = sn WHERE flag & 4 = 0 UNION SELECT qname, row_no, flag, prefix FROM reads JOIN g ON mrnm = sn WHERE flag & 12 = 0
             UNION SELECT qname, row_no, flag, 'unmapped' FROM reads WHERE flag & 12 = 12)
       SELECT prefix, count(*) AS n FROM x GROUP BY prefix""")
OVERLAP = """EXISTS (SELECT 1 FROM cnvs b WHERE b.is_control AND b.donor = a.donor AND b.chrom = a.chrom AND least(a."end", b."end") - greatest(a."start", b."start") >= 0.5 * (a."end" - a."start")
    AND least(a."end", b."end") - greatest(a."start", b."start") >= 0.5 * (b."end" - b."start"))"""
for keep, sql in (("semi", OVERLAP), ("anti", "NOT " + OVERLAP)):
    add(f"JON-3_reciprocal_overlap_{keep}", lambda v, keep=keep: i.reciprocal_overlap(v.cnvs.filter("not is_control"), v.cnvs.filter("is_control"), 0.5, keep).select("cnv_id", "donor"),
        f"SELECT cnv_id, donor FROM cnvs a WHERE NOT is_control AND {sql}")
add("AGG-18_cnv_control_counts", lambda v: i.cnv_control_counts(v.cnvs.filter("not is_control"), v.cnvs.filter("is_control")),
    f"SELECT donor, count(*) AS total, count(*) FILTER (NOT {OVERLAP}) AS not_in_control FROM cnvs a WHERE NOT is_control GROUP BY donor")
CHUNKS = """c AS (SELECT sn AS chrom, a AS "from", least(a + 49999, ln) AS "to", idx FROM sequences, unnest(range(1, greatest(ln, 2), 50000)) AS t(a))"""
add("JON-4_expand_by_chunks", lambda v: i.expand_by_chunks(v.files.select(F.col("file_id").alias("element"), F.when(F.col("file_id") % 10 < 9, F.concat(F.lit("chrom"), (F.col("file_id") % 25 + 1).cast("string"))).alias("chrom")), i.chunk_genome(v.sequences, 50_000).select("chrom", "from", "to")).groupBy("element").agg(F.count("*").alias("n"), F.min("from").alias("least")),
    f""", {CHUNKS}, e AS (SELECT file_id AS element, CASE WHEN file_id % 10 < 9 THEN concat('chr', file_id % 25 + 1) END AS chrom FROM files)
       SELECT element, count(*) AS n, min("from") AS least FROM e JOIN c ON e.chrom IS NULL OR e.chrom = c.chrom GROUP BY element""")
add("WIN-4_chunk_genome", lambda v: i.chunk_genome(v.sequences, 50_000), f""", {CHUNKS} SELECT chrom, "from", "to", 2 AS male, 2 AS female, row_number() OVER (ORDER BY idx, "from") AS seq_no FROM c""")
add("WIN-4_chunk_genome_ploidy", lambda v: i.chunk_genome(v.sequences, 50_000, 100, ["1", "chr2"], [("1", 10_000, 15_000, 1, 2)]),
    """, p AS (SELECT * FROM (VALUES (1, 'chr1', 1, 9999, 2, 2), (1, 'chr1', 10000, 15000, 1, 2), (1, 'chr1', 15001, 21003, 2, 2), (2, 'chr2', 1, 28004, 2, 2)) t(o, chrom, a, b, male, female))
       SELECT chrom, a AS "from", b AS "to", male, female, row_number() OVER (ORDER BY o, a) AS seq_no FROM p""")
PLOIDY = {"default": 3, "1": [{"from": 10_000, "to": 15_000, "M": 1}], "chr2": [{"from": 5, "to": 90, "M": 0, "F": 1}]}


def _ploidy(v):
    """The definition written as a JSON text, read back, and applied to every sequence."""
    path = new_dir(v.spark, "ploidy")
    v.spark.createDataFrame([(json.dumps(PLOIDY),)], "value string").coalesce(1).write.text(path)
    ploidy, default = read_ploidy(v.spark, path)
    return i.chunk_genome(v.sequences, 0, ploidy=ploidy, default=default)


add("UDF-2_ploidy_definition", _ploidy,
    """, p AS (SELECT sn AS chrom, idx, a, least(b, ln) AS b, male, female FROM sequences JOIN (VALUES ('chr1', 1, 9999, 3, 3), ('chr1', 10000, 15000, 1, 3), ('chr1', 15001, 1000000000, 3, 3), ('chr2', 1, 4, 3, 3), ('chr2', 5, 90, 0, 1), ('chr2', 91, 1000000000, 3, 3)) t(c, a, b, male, female) ON sn = c
        UNION ALL SELECT sn, idx, 1, ln, 3, 3 FROM sequences WHERE sn NOT IN ('chr1', 'chr2'))
       SELECT chrom, a AS "from", b AS "to", male, female, row_number() OVER (ORDER BY idx, a) AS seq_no FROM p WHERE a <= b""")
add("JON-35_variants_to_windows", lambda v: i.variants_to_windows(v.variants.withColumn("pos", F.col("pos") % 20000 + 1), v.sequences, 5000),
    """, w AS (SELECT sn, a AS "from", least(a + 4999, ln) AS "to", row_number() OVER (ORDER BY idx, a) AS seq_no FROM sequences, unnest(range(1, ln + 1, 5000)) AS t(a)),
       x AS (SELECT chrom, pos % 20000 + 1 AS pos, ref FROM variants)
       SELECT chrom, pos, ref, "from", "to", seq_no FROM x JOIN w ON chrom = sn AND pos <= "to" AND pos + length(ref) - 1 >= "from" """)
add("WIN-3_chunk_sites", lambda v: i.chunk_sites(v.variants, 150, 20),
    """, r AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn FROM variants),
       k AS (SELECT chrom, c AS k, min(pos) AS f, max(pos) AS t, count(*) AS n FROM r JOIN (SELECT unnest(range(0, 100000)) AS c) ON rn BETWEEN c * 150 + 1 AND c * 150 + 171 GROUP BY chrom, c),
       l AS (SELECT *, CASE WHEN k > 0 AND n < 0.75 * 170 AND k = max(k) OVER (PARTITION BY chrom) THEN k - 1 ELSE k END AS k2 FROM k)
       SELECT chrom, k2 AS chunk_no, min(f) AS "from", max(t) AS "to", CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY chrom, k2""")
add("AGG-29_region_depth", lambda v: i.region_depth(v.reads, v.regions).select("region", "depth"),
    """SELECT region, count(row_no) AS depth FROM regions LEFT JOIN reads ON rname = chrom AND pos BETWEEN "start" AND "end" GROUP BY region""")
add("AGG-30_region_rpkm", lambda v: i.region_rpkm(i.region_depth(v.reads, v.regions).withColumn("sample", F.col("chrom")), "sample").select("region", F.round("rpkm", 4).alias("rpkm")),
    """, d AS (SELECT region, chrom, "start", "end", count(row_no) AS depth FROM regions LEFT JOIN reads ON rname = chrom AND pos BETWEEN "start" AND "end" GROUP BY ALL)
       SELECT region, round(depth * 1e9 / (("end" - "start" + 1) * sum(depth) OVER (PARTITION BY chrom)), 4) AS rpkm FROM d""")
add("JON-36_reference_panel_chunks", lambda v: i.reference_panel_chunks(v.variants.select("chrom", "pos"), i.chunk_sites(v.variants, 150, 20)).groupBy("chrom", "chunk_no").agg(F.count("*").alias("n")),
    """, r AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn FROM variants),
       k AS (SELECT chrom, c AS k, min(pos) AS f, max(pos) AS t, count(*) AS n FROM r JOIN (SELECT unnest(range(0, 100000)) AS c) ON rn BETWEEN c * 150 + 1 AND c * 150 + 171 GROUP BY chrom, c),
       l AS (SELECT *, CASE WHEN k > 0 AND n < 0.75 * 170 AND k = max(k) OVER (PARTITION BY chrom) THEN k - 1 ELSE k END AS k2 FROM k),
       m AS (SELECT chrom, k2, min(f) AS f, max(t) AS t FROM l GROUP BY chrom, k2)
       SELECT m.chrom, k2 AS chunk_no, count(*) AS n FROM m JOIN variants x ON x.chrom = m.chrom AND pos BETWEEN f AND t GROUP BY m.chrom, k2""")
