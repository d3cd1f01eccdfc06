"""Registered queries of the text sources and sinks: each writes text derived from the tables into the shared folder and reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..sources import text as t
from ..sources.paths import new_dir
from .book import Book

QUERIES = Book()
add = QUERIES.add


def written(v, lines, header: str | None = None) -> str:
    """Writes one-column lines as text files, each under a header if given; returns their folder."""
    path = new_dir(v.spark, "text")
    if header is None:
        lines.write.text(path)
    else:
        # one cell a row, so that the header goes into every file as it is
        lines.toDF(header).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return path


def tabbed(*cols):
    return F.concat_ws("\t", *(c if not isinstance(c, str) else F.col(c).cast("string") for c in cols)).alias("value")


_str = lambda c: F.col(c).cast("string")
add("SRC-1_read_list", lambda v: t.read_list(v.spark, written(v, v.files.select(F.when(F.col("file_id") % 5 == 0, "").when(F.col("file_id") % 7 == 0, F.concat(F.lit("#"), "path")).otherwise(F.col("path")).alias("value")))), "SELECT path AS item FROM files WHERE file_id % 5 <> 0 AND file_id % 7 <> 0")
add("SRC-2_read_fofn", lambda v: t.read_fofn(v.spark, written(v, v.files.select("path")), known_files=v.files.filter("file_id % 3 = 0")).select("path", "withdrawn"), "SELECT path, file_id % 3 <> 0 AS withdrawn FROM files")
add("SRC-2_read_fofn_group_all", lambda v: t.read_fofn(v.spark, written(v, v.files.select("path")), "group_all", v.files.filter("file_id % 3 = 0")), "SELECT 'all' AS element, path, true AS withdrawn FROM files")
add("SRC-3_read_delimited", lambda v: t.read_delimited(v.spark, written(v, v.files.select(F.concat_ws(" , ", "path", "sample", "lane"))), r"\s*,\s*", [3, 1]).select(F.col("cells")[0].alias("lane"), F.col("cells")[1].alias("path")), "SELECT lane, path FROM files")


def _metadata(v):
    path = new_dir(v.spark, "csv")
    v.files.select("path", F.when(F.col("file_id") % 2 == 0, F.col("sample")).alias("sample"), "lane").write.option("header", True).option("sep", "\t").csv(path)
    return t.read_file_metadata(v.spark, path).select("path", F.try_element_at("meta", F.lit("sample")).alias("sample"), F.col("meta")["lane"].alias("lane"))


add("SRC-4_read_file_metadata", _metadata, "SELECT path, CASE WHEN file_id % 2 = 0 THEN sample END AS sample, lane FROM files")
add("SRC-5_read_sequence_index", lambda v: t.read_sequence_index(v.spark, written(v, v.index_rows.select(F.concat_ws("\t", "fastq_file", F.lit("m"), "run_id", *([F.lit("x")] * 6), "sample_name", *([F.lit("x")] * 2), "instrument_platform", F.lit("x"), "library_name", *([F.lit("x")] * 4), "paired_fastq", _str("withdrawn"), *([F.lit("x")] * 2), _str("read_count"), _str("base_count"), F.when(F.col("row_no") % 2 == 0, F.col("analysis_group"))))))
    .select("fastq_file", "run_id", "sample_name", "library_name", "paired_fastq", "withdrawn", "read_count", "analysis_group"), "SELECT fastq_file, run_id, sample_name, library_name, paired_fastq, CAST(withdrawn AS BIGINT) AS withdrawn, read_count, CASE WHEN row_no % 2 = 0 THEN analysis_group END AS analysis_group FROM index_rows")
_sam = lambda v: v.reads.select(tabbed("qname", "flag", "rname", "pos", "mapq", "cigar", "mrnm", "mpos", "isize", F.lit("A"), F.lit("I"), F.concat(F.lit("RG:Z:"), "rg"), F.concat(F.lit("NM:i:"), _str("nm"))))
add("SRC-6_read_sam", lambda v: t.read_sam(v.spark, written(v, _sam(v))).select("qname", "flag", "rname", "pos", "mapq", "cigar", "isize", F.col("tags")["RG"].alias("rg"), F.col("tags")["NM"].cast("int").alias("nm")), "SELECT qname, flag, rname, pos, mapq, cigar, CAST(isize AS INT) AS isize, rg, nm FROM reads")
# each lane's read group comes twice, one after the other, and reads follow
_header = lambda v: v.files.select("lane").distinct().select(F.concat(F.lit("@RG\tID:"), "lane", F.lit("\tLB:first\n@RG\tID:"), "lane", F.lit("\tLB:last"), "lane", F.lit("\nread\t0\t*")).alias("value"))
add("SRC-7_read_sam_header", lambda v: t.read_sam_header(v.spark, written(v, _header(v))).select("kind", "id", F.col("tags")["LB"].alias("lb")), "SELECT 'RG' AS kind, lane AS id, concat('last', lane) AS lb FROM (SELECT DISTINCT lane FROM files)")
add("SRC-8_read_fastq", lambda v: t.read_fastq(v.spark, written(v, v.files.select(F.concat(F.lit("@"), "lane", F.lit(" x\n"), "path", F.lit("\n+\n@"), "library")))).select("id", "seq", "qual"), "SELECT lane AS id, path AS seq, concat('@', library) AS qual FROM files")
# the number of lines of each file, and the line that holds its last number
add("HLP-1_numbered_lines", lambda v: t.numbered_lines(v.spark, written(v, v.files.repartition(7, "file_id").select("path"))).groupBy("file").agg((F.max("line_no") - F.count("*")).alias("over"), F.min("line_no").alias("first"), F.countDistinct("line_no").alias("n"), F.count("*").alias("m")).select(F.sum("n").alias("lines"), F.sum(F.col("over") + F.col("first") - 1 + F.col("n") - F.col("m")).alias("off")), "SELECT CAST(count(*) AS BIGINT) AS lines, CAST(0 AS BIGINT) AS off FROM files")
add("SRC-9_read_fasta", lambda v: t.read_fasta(v.spark, written(v, v.files.select(F.concat(F.lit(">"), "lane", F.lit(" d\n"), "sample", F.lit("\n"), "library")))), "SELECT lane AS id, concat(sample, library) AS seq FROM files")
add("SRC-10_read_fai", lambda v: t.read_fai(v.spark, written(v, v.sequences.select(tabbed("sn", "ln", "idx", F.lit("60"), F.lit("61"))))), 'SELECT sn, CAST(ln AS BIGINT) AS ln, CAST(idx AS BIGINT) AS "offset", CAST(60 AS BIGINT) AS linebases, CAST(61 AS BIGINT) AS linewidth FROM sequences')
add("SRC-10_read_dict", lambda v: t.read_dict(v.spark, written(v, v.sequences.select(tabbed(F.lit("@SQ"), F.concat(F.lit("SN:"), "sn"), F.concat(F.lit("LN:"), _str("ln")), F.concat(F.lit("M5:"), "m5"))))), "SELECT sn, CAST(ln AS BIGINT) AS ln, m5 FROM sequences")
add("SRC-11_read_bas", lambda v: t.read_bas(v.spark, written(v, v.files.select(F.when(F.col("file_id") % 3 == 0, F.concat_ws("\t", *(F.lit(str(i)) for i in range(1, 3)), "sample", *(F.lit(str(i)) for i in range(4, 18)))).when(F.col("file_id") % 3 == 1, F.concat_ws("\t", "path", F.lit("st"), "sample", *(F.lit(str(i)) for i in range(4, 19)))).otherwise(F.concat_ws("\t", "path", F.lit("m"), F.lit("st"), "sample", *(F.lit(str(i)) for i in range(5, 22))))))).select("bam_filename", "md5", "study", "sample", "platform", "duplicate_bases"),
    "SELECT CASE WHEN file_id % 3 > 0 THEN path END AS bam_filename, CASE WHEN file_id % 3 = 1 THEN '' WHEN file_id % 3 = 2 THEN 'm' END AS md5, CASE WHEN file_id % 3 = 0 THEN '1' ELSE 'st' END AS study, CASE WHEN file_id % 3 = 0 THEN '2' ELSE sample END AS sample, CASE WHEN file_id % 3 = 0 THEN sample WHEN file_id % 3 = 1 THEN '4' ELSE '5' END AS platform, CASE WHEN file_id % 3 = 2 THEN '21' END AS duplicate_bases FROM files")
_stats = lambda v: written(v, v.lane_stats.select(F.explode(F.array(F.concat(F.lit("SN\t"), "lane", F.lit(":\t"), _str("total_reads")), F.concat(F.lit("SN\t"), "lane", F.lit(" x:\t-nan")), F.concat(F.lit("# "), "lane"), F.lit("CHK\t1"), F.concat(F.lit("COV\t["), _str("n_ins"), F.lit("-"), _str("n_ins"), F.lit("]\t"), _str("n_ins"), F.lit("\t"), _str("reads_paired")), F.concat(F.lit("COV\t[1000<]\t1000\t"), _str("n_del")))).alias("value")))
add("SRC-12_read_lane_stats", lambda v: t.read_lane_stats(v.spark, _stats(v)).select("key", "name", "value"), "SELECT lane AS key, lane AS name, CAST(total_reads AS STRING) AS value FROM lane_stats UNION ALL SELECT concat(lane, ' x'), concat(lane, '_x'), '0' FROM lane_stats")
add("SRC-12_read_lane_sections", lambda v: t.read_lane_sections(v.spark, written(v, v.lane_stats.select(F.concat(F.lit("IS\t"), _str("lane_no"), F.lit("\t"), _str("n_ins"), F.lit("\t-nan\nID\t"), _str("n_del"), F.lit("\t1.5"))))).groupBy("section").agg(F.count("*").alias("n"), F.sum(F.element_at("vals", 1)).alias("first"), F.sum(F.element_at("vals", -1)).alias("last"), (F.sum("row_no") > 0).alias("numbered")),
    "SELECT 'IS' AS section, count(*) AS n, CAST(sum(lane_no) AS DOUBLE) AS first, 0.0::DOUBLE AS last, true AS numbered FROM lane_stats UNION ALL SELECT 'ID', count(*), CAST(sum(n_del) AS DOUBLE), count(*) * 1.5::DOUBLE, true FROM lane_stats")
add("SRC-12_read_coverage", lambda v: t.read_coverage(v.spark, _stats(v)).groupBy("cov").agg(F.sum("n").alias("n")), "SELECT CAST(n_ins AS INT) AS cov, CAST(sum(reads_paired) AS BIGINT) AS n FROM lane_stats GROUP BY 1 UNION ALL SELECT 1001, CAST(sum(n_del) AS BIGINT) FROM lane_stats")
add("SRC-13_read_fastqcheck", lambda v: t.read_fastqcheck(v.spark, written(v, v.files.select(F.concat(F.lit("base  "), _str("file_id"), F.lit("  1.0 2.0 3.0 4.0 5.0  "), (F.col("file_id") % 9).cast("string"), F.lit("  7  31.5"))))).select("cycle", F.array_join(F.transform("quals", lambda x: x.cast("string")), ",").alias("quals")), "SELECT CAST(file_id AS STRING) AS cycle, concat(file_id % 9, ',7') AS quals FROM files")
add("SRC-14_read_tranches", lambda v: t.read_tranches(v.spark, written(v, v.files.select(F.concat_ws(",", (F.col("file_id") % 100).cast("string"), F.lit("5"), F.lit("6"), F.lit("2.0"), F.lit("1.5"), (F.col("file_id") % 7).cast("string"), F.lit("TS"), F.when(F.col("file_id") % 2 == 0, "SNP"), F.lit("10"), F.lit("9"), F.lit("0.9"))))).select("model", "target_sensitivity", "min_vqslod", "accessible_truth"),
    "SELECT CASE WHEN file_id % 2 = 0 THEN 'SNP' END AS model, CAST(file_id % 100 AS DOUBLE) AS target_sensitivity, CAST(file_id % 7 AS DOUBLE) AS min_vqslod, 10.0 AS accessible_truth FROM files")
_vcf = lambda v: written(v, v.variants.select(tabbed("chrom", "pos", F.lit("."), "ref", "alt", "qual", F.lit("PASS"), F.concat(F.lit("DP="), _str("dp")), F.lit("DP:GT"), F.lit("3:0/1"), F.lit("4:1/1"))))
add("SRC-15_read_vcf", lambda v: t.read_vcf(v.spark, _vcf(v)).select("chrom", "pos", "id", "ref", F.col("alt")[0].alias("alt"), "qual", F.col("info")["DP"].cast("int").alias("dp")), "SELECT chrom, pos, CAST(NULL AS STRING) AS id, ref, alt, CAST(qual AS DOUBLE) AS qual, CAST(dp AS INT) AS dp FROM variants")
add("SRC-15_vcf_genotypes", lambda v: t.vcf_genotypes(t.read_vcf(v.spark, _vcf(v))), "SELECT chrom, pos, 0 AS column_no, '0/1' AS gt FROM variants UNION ALL SELECT chrom, pos, 1, '1/1' FROM variants")
add("SRC-16_read_cnv_calls", lambda v: t.read_cnv_calls(v.spark, written(v, v.cnvs.select(F.concat("chrom", F.lit(":"), _str("start"), F.lit("-"), F.when(F.col("cnv_id") % 5 == 0, "x").otherwise(_str("end")), F.lit(" numsnp=3")))), "penncnv"), """SELECT substr(chrom, 4) AS chrom, "start", CAST("end" AS BIGINT) AS "end" FROM cnvs WHERE cnv_id % 5 <> 0""")
add("SRC-17_read_gtcheck", lambda v: t.read_gtcheck(v.spark, written(v, v.scores.select(F.concat_ws("\t", F.lit("CN"), _str("score"), _str("sites"), F.lit("2.5"), "lane", "sample")))), "SELECT CAST(score AS DOUBLE) AS discordance, sites, 2.5 AS avg_min_depth, lane AS sample_a, sample AS sample_b FROM scores")
add("SRC-17_read_gtcheck_likelihood", lambda v: t.read_gtcheck(v.spark, written(v, v.scores.select(F.concat(F.lit("sample "), "sample", F.lit(" likelihood "), _str("score"), F.lit(" over "), _str("sites"), F.lit(" sites, depth 3")))), "likelihood"), "SELECT sample, CAST(score AS DOUBLE) AS score, sites FROM scores")
add("SRC-17_read_gtcheck_five", lambda v: t.read_gtcheck(v.spark, written(v, v.scores.select(F.concat(F.when(F.col("sites") % 10 == 0, "# ").otherwise(" "), _str("score"), F.lit("  0.5 2.5 "), _str("sites"), F.lit(" "), "sample"))), "five"), "SELECT CAST(score AS DOUBLE) AS concordance, 0.5 AS uncertainty, 2.5 AS avg_depth, sites, sample FROM scores WHERE sites % 10 > 0")
_plex = lambda v: v.files.select(F.explode(F.array(*(F.concat_ws("\t", F.lit(al), F.concat(F.lit("W12-rs"), _str("file_id")), F.lit("a"), F.lit("b"), F.lit("c"), F.when(F.col("file_id") % 2 == 0, "G").otherwise("AG"), F.lit(h)) for al, h in (("A", ".5"), ("G", "1.5"))))).alias("value"))
add("SRC-18_read_plex_csv", lambda v: t.read_plex_csv(v.spark, written(v, _plex(v), "ALLELE\tASSAY")).drop("file"), "SELECT concat('rs', file_id) AS assay, CASE WHEN file_id % 2 = 0 THEN 'G' ELSE 'AG' END AS genotype, CASE WHEN file_id % 2 = 0 THEN 'G' ELSE 'A' END AS allele, 'G' AS allele_two, 0.5 AS height, 1.5 AS height_two FROM files")
add("SRC-18_read_plex_csv_fluidigm", lambda v: t.read_plex_csv(v.spark, written(v, v.files.select(F.concat_ws("\t", F.lit("S"), F.concat(F.lit("rs"), _str("file_id")), *(F.lit(x) for x in "cdefghi"), F.when(F.col("file_id") % 3 == 0, "A:A").when(F.col("file_id") % 3 == 1, "A:G").otherwise("No Call"), F.lit(".25"), F.lit("2")))), "fluidigm").select("assay", "genotype", "height", "height_two"),
    "SELECT concat('rs', file_id) AS assay, CASE file_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AG' ELSE '' END AS genotype, 0.25 AS height, 2.0 AS height_two FROM files")


def _split(v):
    path = new_dir(v.spark, "split")
    t.split_multisample_table(v.genotypes.select("sample", "pos", "gt"), "sample", path)
    return v.spark.read.csv(path, header=True).groupBy("sample").agg(F.count("*").alias("n"))


def _split_with_header(v):
    path = new_dir(v.spark, "split")
    t.split_multisample_table(v.genotypes.select("sample", "pos", "gt"), "sample", path, ["Position", "Call"])
    return v.spark.read.csv(path, header=True).groupBy("sample", F.col("Call").alias("call")).agg(F.count("*").alias("n"), F.sum(F.col("Position").cast("long")).alias("p"))


add("SRC-19_split_with_header", _split_with_header, "SELECT sample, gt AS call, count(*) AS n, CAST(sum(pos) AS BIGINT) AS p FROM genotypes GROUP BY 1, 2")
add("SRC-19_split_multisample_table", _split, "SELECT sample, count(*) AS n FROM genotypes GROUP BY sample")
add("SRC-20_read_qc_json", lambda v: t.read_qc_json(v.spark, written(v, v.samples.select(F.to_json(F.struct("sample", F.when(F.col("sample_id") % 2 == 0, 1).alias("pass"), F.when(F.col("sample_id") % 3 == 0, F.struct(F.col("donor").alias("matched_sample_name"))).alias("sample_name_match")))))), "SELECT sample, CASE WHEN sample_id % 2 = 0 THEN 1 ELSE 0 END AS pass, CASE WHEN sample_id % 3 = 0 THEN donor ELSE 'n/a' END AS matched FROM samples")


def _contamination(v):
    path = new_dir(v.spark, "csv")
    v.samples.select(F.col("sample").alias("#SEQ_ID"), F.col("donor").alias("#SNPS"), F.when(F.col("sample_id") % 2 == 0, "NA").otherwise("0.1").alias("FREEMIX")).write.option("header", True).option("sep", "\t").csv(path)
    return t.read_contamination(v.spark, path, columns=None, one_row=False)


add("SRC-21_read_contamination", _contamination, "SELECT sample AS seq_id, 'VBID_N_SNPS' AS key, donor AS val FROM samples UNION ALL SELECT sample, 'VBID_FREEMIX', '0.1' FROM samples WHERE sample_id % 2 <> 0")
_lsf = lambda v: v.step_facts.select(F.concat(F.lit("noise\nSender: LSF System <x>\nSubject: Job "), _str("fact_id"), F.when(F.col("setup") % 3 == 0, "[4]").otherwise(""), F.lit(": <n> Done\n\nJob was executed on host(s) <h>, in queue <long>, as user <u>\nStarted at Thu Jun  7 03:27:56 2012\nResults reported at Thu Jun  7 03:"), F.lpad((F.col("fact_id") % 30 + 28).cast("string"), 2, "0"), F.lit(":56 2012\n\nYour job looked like:\n\n"), F.lit("-" * 60), F.lit("\n# LSBATCH: User input\ncmd "), "step", F.lit("\n"), F.lit("-" * 60),
    F.when(F.col("setup") % 4 == 0, "\n\nSuccessfully completed.").when(F.col("setup") % 4 == 1, "\n\nTERM_MEMLIMIT: job killed after reaching limit.\nExited with exit code 130.").when(F.col("setup") % 4 == 2, "\n\nTERM_OWNER job killed by owner.").otherwise("\n\nExited with exit code 1."), F.lit("\n\n    CPU time   :    "), _str("time_s"), F.lit(".00 sec.\n    Max Memory :   "), _str("memory"), F.when(F.col("setup") % 2 == 0, " MB").otherwise(" GB"),
    F.when(F.col("fact_id") % 50 == 0, "\n").otherwise("\n\nThe output (if any) is above this job summary.\n")).alias("value"))
add("SRC-22_read_job_reports", lambda v: t.read_job_reports(v.spark, written(v, _lsf(v))),
    """SELECT concat('cmd ', step) AS cmd, CASE setup % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'MEMLIMIT' WHEN 2 THEN 'killed' ELSE 'exited' END AS status, CAST(memory * CASE WHEN setup % 2 = 0 THEN 1 ELSE 1024 END AS DOUBLE) AS memory_mb, (fact_id % 30 + 1) * 60 AS wall_s, CAST(time_s AS DOUBLE) AS cpu_s,
       CAST(round(CAST(greatest(time_s, 1) / ((fact_id % 30 + 1) * 60) AS DECIMAL(24, 9)), 2) AS DOUBLE) AS idle, 'long' AS queue, fact_id AS job, CASE WHEN setup % 3 = 0 THEN CAST(4 AS BIGINT) END AS array_idx FROM step_facts WHERE fact_id % 50 > 0""")
_local = lambda v: v.step_facts.select(F.concat(F.lit("#--- runner report start ---\n# Job: "), _str("fact_id"), F.when(F.col("setup") % 3 == 0, "[4]").otherwise(""), F.lit("\n# Started at: 2011-09-26T10:09:29\n# Running on: h\n# Cmd: do "), "step", F.lit("\n#---\nout\n#---\n# Finished at: 2011-09-26T10:"), F.lpad((F.col("fact_id") % 40 + 10).cast("string"), 2, "0"), F.lit(":29\n# Exit code: "),
    F.when(F.col("setup") % 4 == 0, "0 (finished OK)").when(F.col("setup") % 4 == 1, "1 (exited with code 1)").when(F.col("setup") % 4 == 2, "9 (killed by signal 9)").otherwise("?"), F.when(F.col("fact_id") % 50 == 0, "").otherwise("\n#--- runner report end ---")).alias("value"))
add("SRC-22_read_local_reports", lambda v: t.read_job_reports(v.spark, written(v, _local(v)), "local").select("cmd", "status", "wall_s", "job", "array_idx"),
    """SELECT concat('do ', step) AS cmd, CASE setup % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'exited' WHEN 2 THEN 'killed' ELSE 'unknown' END AS status, (fact_id % 40 + 1) * 60 AS wall_s, fact_id AS job, CASE WHEN setup % 3 = 0 THEN CAST(4 AS BIGINT) END AS array_idx FROM step_facts WHERE fact_id % 50 > 0""")


def _logs(v):
    path = new_dir(v.spark, "logs")
    v.files.select(F.col("status").alias("log"), "file_id", F.concat("lane", F.lit("\n"), "sample", F.lit("\n-----")).alias("value")).repartition("log").sortWithinPartitions("log", F.desc("file_id")).select("log", "value").write.partitionBy("log").text(path)
    return path


# a log a status, its blocks from the last file to the first
add("SRC-23_read_concat_log", lambda v: t.read_concat_log(v.spark, _logs(v)).select(F.regexp_extract("file", r"log=(\w+)", 1).alias("log"), "newest", "text"), "SELECT status AS log, CAST(row_number() OVER (PARTITION BY status ORDER BY file_id) AS BIGINT) AS newest, concat(lane, chr(10), sample) AS text FROM files")


def _tracking(v):
    path = new_dir(v.spark, "tracking")
    v.files.select("lane", "library", (F.col("file_id") % 9).alias("type")).write.parquet(f"{path}/lane")
    return t.read_tracking_tables(v.spark, path, tables=("lane",))["lane"].select("lane", t.file_type(F.col("type")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


add("SRC-24_read_tracking_tables", _tracking, "SELECT CASE WHEN file_id % 9 < 4 THEN 'fq' WHEN file_id % 9 < 6 THEN 'bam' WHEN file_id % 9 = 6 THEN 'cram' ELSE 'gtc' END AS type, count(*) AS n FROM files GROUP BY 1")
add("SNK-1_write_partitioned", lambda v: t.write_partitioned(v.reads.select("rname", "qname", "pos"), "rname", new_dir(v.spark, "parts"), v.sequences.select(F.col("sn").alias("rname")), salts=4), 'SELECT sn AS rname, count(r.qname) AS "rows" FROM sequences LEFT JOIN reads r ON r.rname = sn GROUP BY sn')
add("SNK-2_write_vcf", lambda v: v.spark.read.text(written(v, t.vcf_lines(v.variants))), "SELECT concat_ws(chr(9), chrom, pos, '.', ref, alt, qual, 'PASS', '.') AS value FROM variants")
add("SNK-2_write_bed", lambda v: v.spark.read.text(written(v, t.bed_lines(v.regions))), """SELECT concat_ws(chr(9), chrom, "start", "end") AS value FROM regions""")
add("SNK-2_write_bas", lambda v: v.spark.read.text(written(v, t.table_lines(a.read_group_stats(v.reads).select("rg", "total_reads", "mapped_reads")))), "SELECT concat_ws(chr(9), 'rg', 'total_reads', 'mapped_reads') AS value UNION ALL SELECT concat_ws(chr(9), rg, count(*), count(*) FILTER (flag & 4 = 0)) FROM reads GROUP BY rg")


def _lines_of(write):
    def run(v):
        folder = new_dir(v.spark, "sink")
        write(v, folder)
        return v.spark.read.text(folder)

    return run


add("SNK-2_write_vcf_with_header", _lines_of(lambda v, f: t.write_vcf(v.variants, f, ["s1", "s2"], "made", "20110101")),
    """SELECT concat_ws(chr(9), chrom, pos, '.', ref, alt, qual, 'PASS', '.') AS value FROM variants UNION ALL SELECT unnest(['##fileformat=VCFv4.0', '##fileDate=20110101', '##source=made', concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 's1', 's2')])""")
add("SNK-2_write_chunks", _lines_of(lambda v, f: t.write_chunks(v.regions.select("chrom", F.col("start").alias("from"), F.col("end").alias("to"), "region"), f)), """SELECT concat_ws(chr(9), chrom, "start", "end", region) AS value FROM regions""")
