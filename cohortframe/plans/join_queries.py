"""Registered queries of the joins and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as c
from ..operators import joins as j
from .book import Book

QUERIES = Book()
add = QUERIES.add



add("JON-5_add_to_all_elements", lambda v: j.add_to_all_elements(v.files.select(F.col("file_id").alias("element"), F.array("path").alias("paths")), v.sequences.select(F.col("sn").alias("path"))).select("element", F.array_join("paths", ",").alias("paths")),
    "SELECT file_id AS element, concat(path, ',', (SELECT string_agg(sn, ',' ORDER BY sn) FROM sequences)) AS paths FROM files")
add("JON-6_enrich_from_warehouse", lambda v: j.enrich_from_warehouse(v.files.select("file_id", "sample"), v.samples, v.samples.filter("sample_id % 5 <> 0").select("sample", F.col("study_id"), F.concat(F.lit("study"), F.col("study_id").cast("string")).alias("study"))
    .unionByName(v.samples.filter("sample_id % 4 = 0").select("sample", F.lit(99).alias("study_id"), F.lit("study99").alias("study"))), 99).select("file_id", "donor", "sex", "study", F.array_join("studies", ",").alias("studies")),
    """, b AS (SELECT sample, study_id, concat('study', study_id) AS study FROM samples WHERE sample_id % 5 <> 0 UNION ALL SELECT sample, 99, 'study99' FROM samples WHERE sample_id % 4 = 0),
       p AS (SELECT sample, string_agg(DISTINCT study, ',' ORDER BY study) AS studies, count(DISTINCT study) AS n, max(CASE WHEN study_id = 99 THEN study END) AS own, min(study) AS one FROM b GROUP BY sample)
       SELECT file_id, donor, CASE WHEN s.sample IS NULL THEN NULL WHEN upper(substr(gender, 1, 1)) IN ('F', 'M') THEN upper(substr(gender, 1, 1)) ELSE 'U' END AS sex, coalesce(own, CASE WHEN n = 1 THEN one END) AS study, studies
       FROM files f LEFT JOIN samples s USING (sample) LEFT JOIN p USING (sample)""")
add("JON-7_attach_qc_files", lambda v: j.attach_qc_files(v.files.select("file_id", "path"), v.files.filter("file_id % 3 = 0").select(F.regexp_replace("path", "/x/(f[0-9]+).bam", "/x/qc/$1.stats").alias("path")).unionByName(v.files.filter("file_id % 2 = 0").select(F.regexp_replace("path", ".bam$", ".gt.json").alias("path"))), [".stats", ".gt.json"]).select("file_id", F.size("qc_files").alias("n")),
    "SELECT file_id, 2 AS n FROM files WHERE file_id % 6 = 0")
add("JON-9_lane_info", lambda v: j.lane_info(v.index_rows, "library_name"),
    """, c AS (SELECT run_id, library_name, count(*) AS n FROM index_rows GROUP BY 1, 2) SELECT run_id, library_name FROM c QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, library_name) = 1""")
add("JON-11_merge_sites_with_genotypes", lambda v: j.merge_sites_with_genotypes(v.variants, v.variants.select("chrom", "pos", F.when(F.col("kind") == "indel", F.concat("ref", F.lit("TT"))).otherwise(F.col("ref")).alias("ref"), F.when(F.col("kind") == "indel", F.concat("alt", F.lit("TT"))).otherwise(F.col("alt")).alias("alt"), F.lit("0/1").alias("gt"))),
    "SELECT chrom, pos, ref, alt, qual, '0/1' AS gt FROM variants")
add("JON-13_merge_samples_control_first", lambda v: j.control_first(v.files.select("sample", "path", "status"), "sample", "status", "^F$").select("path", "has_control", "column_no"),
    """, c AS (SELECT sample, min(path) FILTER (status = 'F') AS c FROM files GROUP BY sample)
       SELECT path, c IS NOT NULL AS has_control, row_number() OVER (PARTITION BY f.sample ORDER BY coalesce(path = c, false) DESC, path) AS column_no FROM files f JOIN c USING (sample)""")
add("JON-14_merge_call_sets", lambda v: j.merge_call_sets(v.variants.select("chrom", "pos", "qual", F.lit("gatk").alias("caller")).filter("pos % 2 = 0").unionByName(v.variants.select("chrom", "pos", (F.col("qual") + 100).alias("qual"), F.lit("samtools").alias("caller"))), ["gatk", "samtools"]),
    "SELECT chrom, pos, CASE WHEN pos % 2 = 0 THEN 'gatk' ELSE 'samtools' END AS caller, CASE WHEN pos % 2 = 0 THEN qual ELSE qual + 100 END AS qual FROM variants")
add("JON-15_sample_region_ploidy", lambda v: j.sample_region_ploidy(v.sequences.select(F.col("sn").alias("chrom"), F.lit(1).alias("from"), F.col("ln").alias("to"), (F.col("idx") % 2).alias("male"), (F.col("idx") % 3).alias("female")), v.samples.select("sample", F.when(F.col("gender") == "Female", "F").when(F.col("gender") == "male", "M").alias("sex"))),
    """, x AS (SELECT sample, sn AS chrom, 1 AS "from", ln AS "to", CASE WHEN gender = 'Female' THEN idx % 3 ELSE idx % 2 END AS ploidy FROM samples, sequences) SELECT * FROM x WHERE ploidy > 0""")
add("JON-16_assign_sex", lambda v: j.assign_sex(v.files.select("file_id", "sample", F.when(F.col("file_id") % 5 == 0, "X").alias("sex")), v.samples.select("sample", F.col("gender").alias("sex")), "M"),
    "SELECT file_id, f.sample, coalesce(CASE WHEN file_id % 5 = 0 THEN 'X' END, gender, 'M') AS sex FROM files f LEFT JOIN samples s USING (sample)")
add("JON-17_pairwise_discordance", lambda v: c.pairwise_discordance(v.genotypes).withColumn("avg_min_depth", F.round("avg_min_depth", 4)),
    """SELECT a.sample AS sample_a, b.sample AS sample_b, count(*) AS sites, count(*) FILTER (a.gt <> b.gt) AS discordant, round(avg(least(a.dp, b.dp)), 4) AS avg_min_depth, CASE WHEN count(*) < 100 THEN 'fluidigm' ELSE 'genotype' END AS type
       FROM genotypes a JOIN genotypes b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample < b.sample GROUP BY a.sample, b.sample""")
add("JON-18_match_to_panel", lambda v: j.match_to_panel(v.genotypes.filter("sample in ('s1', 's2')"), v.genotypes.filter("sample not in ('s1', 's2')")).select("query", "panel_sample", "sites", F.round("concordance", 6).alias("concordance"), F.round("avg_depth", 4).alias("avg_depth")),
    """SELECT a.sample AS query, b.sample AS panel_sample, count(*) AS sites, round(count(*) FILTER (a.gt = b.gt) / count(*), 6) AS concordance, round(avg(a.dp), 4) AS avg_depth
       FROM genotypes a JOIN genotypes b ON a.chrom = b.chrom AND a.pos = b.pos WHERE a.sample IN ('s1', 's2') AND b.sample NOT IN ('s1', 's2') GROUP BY a.sample, b.sample""")
add("JON-25_merge_profiles", lambda v: j.in_all_tables(v.genotypes.select("pos", "sample", "dp"), ["pos"], "sample", 12).groupBy("sample").agg(F.count("*").alias("n"), F.sum("dp").alias("dp")),
    "SELECT sample, count(*) AS n, CAST(sum(dp) AS BIGINT) AS dp FROM genotypes WHERE pos IN (SELECT pos FROM genotypes GROUP BY pos HAVING count(DISTINCT sample) = 12) GROUP BY sample")
add("JON-27_diff_indexes", lambda v: j.diff_indexes(v.index_rows.filter("row_no % 1500 % 17 <> 1"), v.index_rows.filter("row_no % 1500 % 31 <> 1").withColumn("read_count", F.col("read_count") + F.when(F.col("row_no") % 100 == 0, 1).otherwise(0)).withColumn("withdrawn", F.when(F.col("row_no") % 1500 % 40 == 7, 1).otherwise(F.col("withdrawn")))),
    """, a AS (SELECT concat(run_id, '.', replace(analysis_group, ' ', '_')) AS lane, sum(read_count) AS r, sum(base_count) AS b, arg_max(library_name, row_no) AS l, min(withdrawn) AS w FROM index_rows WHERE row_no % 1500 % 17 <> 1 GROUP BY 1),
       n AS (SELECT concat(run_id, '.', replace(analysis_group, ' ', '_')) AS lane, sum(read_count + CASE WHEN row_no % 100 = 0 THEN 1 ELSE 0 END) AS r, sum(base_count) AS b, arg_max(library_name, row_no) AS l, min(CASE WHEN row_no % 1500 % 40 = 7 THEN 1 ELSE withdrawn END) AS w FROM index_rows WHERE row_no % 1500 % 31 <> 1 GROUP BY 1),
       d AS (SELECT coalesce(a.lane, n.lane) AS lane, CASE WHEN a.w IS NULL THEN 'new' WHEN n.w IS NULL THEN 'gone' WHEN a.w = 0 AND n.w = 1 THEN 'withdrawn' WHEN a.w = 1 AND n.w = 0 THEN 'reinstated' WHEN a.r <> n.r OR a.b <> n.b OR a.l <> n.l THEN 'changed' ELSE 'same' END AS what,
         concat_ws(',', CASE WHEN a.r <> n.r THEN 'reads' END, CASE WHEN a.b <> n.b THEN 'bases' END, CASE WHEN a.l <> n.l THEN 'library' END) AS f FROM a FULL JOIN n ON a.lane = n.lane)
       SELECT lane, what, CASE WHEN what = 'changed' THEN f ELSE '' END AS fields FROM d""")
add("JON-29_population_lists", lambda v: j.population_lists(v.files.select("path"), [("A", "^/d1/"), ("B", "7\\.bam$"), ("A", "77\\.bam$")], ["1", "2"]).groupBy("population", "chrom").agg(F.count("*").alias("n")),
    """, x AS (SELECT 'A' AS population FROM files WHERE path LIKE '/d1/%' UNION ALL SELECT 'B' FROM files WHERE path LIKE '%7.bam' UNION ALL SELECT 'A' FROM files WHERE path LIKE '%77.bam')
       SELECT population, chrom, count(*) AS n FROM x, (VALUES ('1'), ('2')) c(chrom) GROUP BY ALL""")
add("JON-30_pair_alignment_with_stats", lambda v: j.pair_alignment_with_stats(v.files.select(F.col("file_id").alias("lane"), "path", F.lit("bam").alias("kind")).unionByName(v.files.select("file_id", F.concat("path", F.lit(".stats")).alias("path"), F.lit("stats").alias("kind")).withColumnRenamed("file_id", "lane")).withColumn("lane", F.col("lane").cast("string"))),
    "SELECT CAST(file_id AS STRING) AS lane, path AS alignment, concat(path, '.stats') AS stats FROM files")
add("JON-31_pair_mates", lambda v: j.pair_mates(v.index_rows),
    """SELECT a.fastq_file, CASE WHEN a.paired_fastq = '' THEN 0 WHEN b.row_no IS NULL OR a.row_no < b.row_no THEN 1 ELSE 2 END AS mate FROM index_rows a LEFT JOIN index_rows b ON a.paired_fastq = b.fastq_file""")
add("JON-32_reads_to_fastq", lambda v: j.reads_to_fastq(v.reads),
    """, p AS (SELECT rg, qname, count(*) FILTER (flag & 64 > 0) AS a, count(*) FILTER (flag & 64 = 0) AS b FROM reads WHERE flag & 256 = 0 GROUP BY 1, 2),
       x AS (SELECT rg, CASE WHEN a > 0 AND b > 0 THEN 'forward' ELSE 'single' END AS kind, a AS n FROM p WHERE a > 0 UNION ALL SELECT rg, CASE WHEN a > 0 AND b > 0 THEN 'reverse' ELSE 'single' END, b FROM p WHERE b > 0)
       SELECT rg, kind, CAST(sum(n) AS BIGINT) AS reads, CAST(sum(n) * 100 AS BIGINT) AS bases, 100.0 AS avg_length FROM x GROUP BY 1, 2""")
add("JON-34_parent_child_elements", lambda v: j.parent_child_elements(v.files.select(F.col("file_id").alias("element"), F.col("status").alias("source")), v.files.select((F.col("file_id") % 500).alias("parent"), F.col("file_id").alias("child")).unionByName(v.files.select((F.col("file_id") % 500).alias("parent"), F.col("file_id").alias("child"))), v.files.select("path", F.col("file_id").alias("element"))),
    "SELECT f.path, f.file_id AS child, f.file_id % 500 AS parent, p.status AS source FROM files f JOIN files p ON p.file_id = f.file_id % 500")
_groups = lambda v: v.files.select(F.col("file_id").alias("rg"), F.when(F.col("file_id") % 3 == 0, "-").otherwise(F.col("sample")).alias("sample"), F.lit("").alias("library"), F.lit("SLX").alias("platform"), F.when(F.col("file_id") % 4 == 0, "st").alias("study"), F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("unit"), F.col("file_id").cast("string"))).alias("pu")).withColumn("rg", F.col("rg").cast("string"))
_by_index = lambda v: v.files.filter("file_id % 2 = 0").select(F.col("file_id").cast("string").alias("rg"), F.lit("xs").alias("sample"), "library", F.lit("unknown_p").alias("platform"), F.lit("ixst").alias("study"))
for by_unit in (False, True):
    add(f"JON-8_bas_metadata{'_by_unit' * by_unit}", lambda v, by_unit=by_unit: j.bas_metadata(v.files.select(F.col("file_id").cast("string").alias("rg"), "size"), _groups(v), _by_index(v), by_unit),
        f"""SELECT {"CASE WHEN file_id % 5 = 0 THEN concat('unit', file_id) ELSE CAST(file_id AS STRING) END" if by_unit else "CAST(file_id AS STRING)"} AS rg, size, CASE WHEN file_id % 4 = 0 THEN 'st' WHEN file_id % 2 = 0 THEN 'ixst' ELSE 'unknown_study' END AS study, CASE WHEN file_id % 3 <> 0 THEN sample WHEN file_id % 2 = 0 THEN 'xs' ELSE 'unknown_sample' END AS sample,
            'ILLUMINA' AS platform, CASE WHEN file_id % 2 = 0 THEN library ELSE 'unknown_library' END AS library FROM files""")
add("JON-9_lane_values", lambda v: j.lane_values(v.index_rows, "library_name").select("run_id", F.array_join("vals", ",").alias("vals")), "SELECT run_id, string_agg(DISTINCT library_name, ',' ORDER BY library_name) AS vals FROM index_rows GROUP BY run_id")
# every fifth SNP is listed twice, on X and Y
_manifest = lambda v: v.part.select((F.col("p_partkey") * 2).alias("row_no"), F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("snp"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.lit("chrX").alias("chrom"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 2 == 0, "-").otherwise("+").alias("strand")).filter("pos % 7 <> 0").unionByName(
    v.part.filter("p_partkey % 5 = 0 and p_partkey % 7 <> 0").select((F.col("p_partkey") * 2 + 1).alias("row_no"), F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("snp"), F.lit("C").alias("ref"), F.lit("T").alias("alt"), F.lit("chrY").alias("chrom"), (F.col("p_partkey") + 9).alias("pos"), F.lit("+").alias("strand")))
add("JON-10_plex_to_variants", lambda v: j.plex_to_variants(v.genotypes.select("sample", F.concat(F.lit("rs"), F.col("pos").cast("string")).alias("snp"), F.when(F.col("dp") == 1, "").when(F.col("gt") == "0/0", "A").when(F.col("gt") == "0/1", "AG").otherwise("TC").alias("genotype")), j.plex_manifest(_manifest(v))),
    """, m AS (SELECT p_partkey, p_size % 2 = 0 AS minus, p_partkey % 5 = 0 AS twice FROM part WHERE p_partkey % 7 <> 0)
       SELECT sample, 'chrX' AS chrom, pos, concat('rs', pos) AS id, CASE WHEN minus THEN 'T' ELSE 'A' END AS ref, CASE WHEN minus AND twice THEN 'G' WHEN twice THEN 'C' WHEN minus THEN 'C' ELSE 'G' END AS alt, twice AS gender_marker,
       CASE WHEN dp = 1 THEN './.' WHEN minus THEN CASE gt WHEN '0/0' THEN '1/1' WHEN '0/1' THEN '1/1' ELSE '0/1' END ELSE CASE gt WHEN '0/0' THEN '0/0' WHEN '0/1' THEN '0/1' ELSE '1/1' END END AS gt FROM genotypes JOIN m ON p_partkey = pos""")
_calls = lambda v: v.genotypes.select("chrom", "pos", F.when(F.col("pos") % 10 == 0, F.when(F.col("sample").isin("s1", "s2"), "AT").otherwise("A")).otherwise("A").alias("ref"), F.when(F.col("sample").endswith("1"), "T,C").when(F.col("sample").endswith("2"), "G").otherwise("C").alias("alt"), "sample", F.when(F.col("sample").endswith("1") & (F.col("gt") == "1/1"), "1|2").otherwise(F.col("gt")).alias("gt"))
CALLS = """g AS (SELECT chrom, pos, sample, CASE WHEN pos % 10 = 0 AND sample IN ('s1', 's2') THEN 'AT' ELSE 'A' END AS ref, CASE WHEN sample LIKE '%1' THEN 1 WHEN sample LIKE '%2' THEN 2 ELSE 3 END AS k, gt FROM genotypes),
    a AS (SELECT chrom, pos, ref, unnest(CASE k WHEN 1 THEN ['T', 'C'] WHEN 2 THEN ['G'] ELSE ['C'] END) AS x FROM g), u AS (SELECT chrom, pos, ref, list_sort(list(DISTINCT x)) AS alts FROM a GROUP BY 1, 2, 3),
    c AS (SELECT g.*, alts, list_position(alts, CASE k WHEN 1 THEN 'T' WHEN 2 THEN 'G' ELSE 'C' END) AS n1, list_position(alts, 'C') AS n2 FROM g JOIN u ON u.chrom = g.chrom AND u.pos = g.pos AND u.ref = g.ref),
    r AS (SELECT chrom, pos, ref, sample, alts, CASE WHEN gt = '0/0' THEN gt WHEN gt = '0/1' THEN concat('0/', n1) WHEN k = 1 THEN concat(n1, '|', n2) ELSE concat(n1, '/', n1) END AS gt FROM c)"""
def _merged(v, finish):
    samples = c.sample_dictionary(v.genotypes)
    return finish(c.merge_samples(_calls(v), samples), samples)


add("JON-12_merge_samples", lambda v: _merged(v, c.named_calls).select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), "sample", "gt"), f", {CALLS} SELECT chrom, pos, ref, array_to_string(alts, ',') AS alt, sample, gt FROM r")
add("JON-12_matrix_rows", lambda v: _merged(v, c.matrix_rows).withColumn("gts", F.array_join("gts", " ")),
    f", {CALLS}, s AS (SELECT DISTINCT sample FROM genotypes), m AS (SELECT u.chrom, u.pos, u.ref, u.alts, s.sample FROM u, s) SELECT m.chrom, m.pos, m.ref, array_to_string(any_value(m.alts), ',') AS alt, string_agg(coalesce(gt, './.'), ' ' ORDER BY m.sample) AS gts FROM m LEFT JOIN r ON r.chrom = m.chrom AND r.pos = m.pos AND r.ref = m.ref AND r.sample = m.sample GROUP BY 1, 2, 3")
add("JON-15_ploidy_by_sex_list", lambda v: j.sample_region_ploidy(v.sequences.select(F.col("sn").alias("chrom"), F.lit(1).alias("from"), F.col("ln").alias("to"), (F.col("idx") % 2).alias("male"), (F.col("idx") % 3).alias("female")), v.samples.select("sample", F.lit("M").alias("sex")), sexes=v.samples.filter("sample_id % 2 = 0").select("sample", F.when(F.col("sample_id") % 4 == 0, "F").alias("sex"))),
    """, x AS (SELECT sample, sn AS chrom, 1 AS "from", ln AS "to", CASE WHEN sample_id % 4 = 0 THEN idx % 3 ELSE idx % 2 END AS ploidy FROM samples, sequences WHERE sample_id % 2 = 0) SELECT * FROM x WHERE ploidy > 0""")
add("JON-25_profiles_in_tag_order", lambda v: j.merge_profiles(v.genotypes.select(F.col("sample").alias("table"), F.col("chrom").alias("key1"), F.col("pos").alias("key2"), F.concat("sample", F.when(F.col("sample").isin("s3", "s4"), "_ctl").otherwise("_x")).alias("column"), F.col("dp").alias("value")), 12, ["_ctl", "_x"]).select("key1", "key2", F.array_join(F.transform("values", lambda x: F.concat(x["column"], F.lit("="), x["value"].cast("string"))), ",").alias("cells")),
    """SELECT chrom AS key1, pos AS key2, string_agg(concat(sample, CASE WHEN sample IN ('s3', 's4') THEN '_ctl' ELSE '_x' END, '=', dp), ',' ORDER BY CASE WHEN sample IN ('s3', 's4') THEN 0 ELSE 1 END, concat(sample, CASE WHEN sample IN ('s3', 's4') THEN '_ctl' ELSE '_x' END)) AS cells FROM genotypes GROUP BY 1, 2 HAVING count(DISTINCT sample) = 12""")
_annotation = lambda v, lacking, odd: v.files.select(*(F.when(F.col("file_id") % odd == 0, F.lit("other")).otherwise(F.col("lane")).alias(c) if c == "SYMBOL" else F.col("path").alias(c) for c in j.ANNOTATION_COLUMNS if c != lacking))
add("JON-33_merge_annotations", lambda v: j.merge_annotations([_annotation(v, "DEFINITION", 3), _annotation(v, None, 5), _annotation(v, None, 7)]).select(F.col("TargetID").alias("target"), F.col("SYMBOL").alias("symbol"), F.col("DEFINITION").alias("definition")),
    """SELECT path AS target, CASE WHEN file_id % 105 = 0 THEN 'other' ELSE lane END AS symbol, 'NaN' AS definition FROM files WHERE file_id % 105 = 0 OR (file_id % 3 > 0 AND file_id % 5 > 0 AND file_id % 7 > 0)""")
add("JON-33_rows_in_all_tables", lambda v: j.in_all_tables(v.genotypes.select("pos", "gt", "sample"), ["pos", "gt"], "sample", 7).select("pos", "gt").distinct(),
    "SELECT pos, gt FROM genotypes GROUP BY pos, gt HAVING count(DISTINCT sample) = 7")
