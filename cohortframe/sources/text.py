"""Readers and writers of the text formats (SRC-1 to SRC-24, SNK-1, SNK-2). Every reader keeps the file, and the line number where order matters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import report_time
from ..operators.ordering import last_known, number_within
from .paths import stored

#: Column names of the formats.
INDEX_COLUMNS = "fastq_file md5 run_id study_id study_name center_name submission_id submission_date sample_id sample_name population experiment_id instrument_platform instrument_model library_name run_name run_block_name insert_size library_layout paired_fastq withdrawn withdrawn_date comment read_count base_count analysis_group".split()
BAS_COLUMNS = "bam_filename md5 study sample platform library readgroup total_bases mapped_bases total_reads mapped_reads mapped_reads_paired mapped_reads_properly_paired pct_mismatch avg_qual mean_insert insert_sd median_insert insert_mad duplicate_reads duplicate_bases".split()
SAM_COLUMNS = "qname flag rname pos mapq cigar mrnm mpos isize seq qual".split()
TRANCHE_COLUMNS = "target_sensitivity num_known num_novel known_titv novel_titv min_vqslod filter_name accessible_truth calls_at_truth truth_sensitivity".split()
FILE_TYPES = {0: "fq", 1: "fq", 2: "fq", 3: "fq", 4: "bam", 5: "bam", 6: "cram", 7: "gtc", 8: "gtc"}


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """file, line, and its place: the start of the split it was read in, and a number that grows within the split."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")]
    return spark.read.text(path).select(*at, F.col("value").alias("line"))


def _numbered(placed: DataFrame) -> DataFrame:
    """line_no (from 1) of placed lines within their file: the number within the split plus the counts of earlier splits."""
    held = stored(placed, "lines")
    split = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(split), F.lit(0)))
    joined = held.join(counts, ["file", "_start"])
    return joined.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """HLP-1: file, line_no (from 1) and line of text files. Files are read by splits, a task each, whatever their size.

    Lines get the place that they have in their split, and are written with
    it; a table of one row a split then gives each split the count of the lines before it."""
    return _numbered(_placed(spark, path))


def header_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, line and place (a struct that orders a file's lines) of the lines that fit a pattern; no other line leaves the scan."""
    return _placed(spark, path).filter(F.col("line").rlike(pattern)).select("file", "line", F.struct("_start", "_id").alias("place"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_list(spark: SparkSession, path: str, skip_comments: bool = True) -> DataFrame:
    """SRC-1: an item a line; blank lines go, and lines that begin with # if asked."""
    out = _lines(spark, path).filter(F.trim("line") != "")
    return (out.filter(~F.col("line").startswith("#")) if skip_comments else out).select(F.col("line").alias("item"))


def read_fofn(spark: SparkSession, path: str, mode: str = "all", known_files: DataFrame | None = None) -> DataFrame:
    """SRC-2: element, path and withdrawn: an element a path, or with group_all the one element `all` of every path, a row a path;
    a path not among the known files is withdrawn, and with group_all the element is if any of its paths is."""
    items = read_list(spark, path).select(F.col("item").alias("path")).withColumn("withdrawn", F.lit(False))
    if known_files is not None:
        k = known_files.select(F.col("path").alias("_k")).distinct()
        items = items.join(k, F.col("path") == F.col("_k"), "left").withColumn("withdrawn", F.col("_k").isNull()).drop("_k")
    if mode == "group_all":
        any_one = items.agg(F.bool_or("withdrawn").alias("withdrawn"))  # one row
        return items.select(F.lit("all").alias("element"), "path").crossJoin(F.broadcast(any_one))
    return items.select(F.col("path").alias("element"), "path", "withdrawn")


def read_delimited(spark: SparkSession, path: str, delimiter: str, columns: list[int] | None = None) -> DataFrame:
    """SRC-3: cells of each row, or the given ones (from 1). The delimiter is a pattern."""
    cells = F.split("item", delimiter)
    rows = read_list(spark, path)
    return rows.select((F.array(*(F.get(cells, c - 1) for c in columns)) if columns else cells).alias("cells"))


def read_file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: path and a map of the other columns of a tab file with header."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    keys = [c for c in df.columns if c != "path"]
    return df.select("path", F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k in keys)), F.array(*(F.col(k) for k in keys))), lambda k, v: v.isNotNull()).alias("meta"))


def read_sequence_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: 26 named columns (25 pass, the last being null); a header row goes; another width is an error."""
    cells = F.split("line", "\t")
    rows = _lines(spark, path).filter((F.col("line") != "") & ~F.upper("line").startswith("FASTQ_FILE"))
    ok = F.when(F.size(cells).isin(25, 26), cells).otherwise(F.raise_error(F.concat(F.lit("columns: "), F.size(cells).cast("string"))).cast("array<string>"))
    rows = rows.withColumn("c", ok)
    return rows.select(*(F.get("c", i).alias(n) for i, n in enumerate(INDEX_COLUMNS))).withColumns({c: F.col(c).try_cast("long") for c in ("read_count", "base_count", "withdrawn")})


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: alignments of SAM text, tags as a map."""
    c = F.split("line", "\t")
    tags = F.map_from_entries(F.transform(F.slice(c, 12, F.greatest(F.size(c) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2), F.regexp_replace(x, "^..:.:", ""))))
    whole = {"flag": "int", "pos": "long", "mapq": "int", "mpos": "long", "isize": "int"}
    rows = _lines(spark, path).filter(~F.col("line").startswith("@") & (F.col("line") != ""))
    return rows.select(*((F.get(c, i).cast(whole[n]) if n in whole else F.get(c, i)).alias(n) for i, n in enumerate(SAM_COLUMNS)), tags.alias("tags"))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: kind (SQ, RG, PG, HD), id (SN else ID) and tags of header lines; the last of a repeated id wins. idx numbers a file's
    header lines, by the first of an id. Only header lines leave the scan."""
    rows = _numbered(_placed(spark, path).filter(F.col("line").rlike("^@[A-Z]{2}\t")))
    tags = F.map_from_entries(F.transform(F.slice(F.split("line", "\t"), 2, F.size(F.split("line", "\t"))), lambda x: F.struct(F.substring(x, 1, 2), F.substr(x, F.lit(4)))))
    r = rows.select("file", F.substring("line", 2, 2).alias("kind"), tags.alias("tags"), "line_no").withColumn("id", F.coalesce(F.try_element_at("tags", F.lit("SN")), F.try_element_at("tags", F.lit("ID"))))
    return r.groupBy("file", "kind", "id").agg(F.max_by("tags", "line_no").alias("tags"), F.min("line_no").alias("idx"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: file, row_no, id, seq and qual of four-line records; a record that doesn't begin with @, or whose third line lacks +, is an error."""
    n = numbered_lines(spark, path).withColumn("row_no", F.floor((F.col("line_no") - 1) / 4)).withColumn("k", (F.col("line_no") - 1) % 4)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    r = n.groupBy("file", "row_no").agg(at(0).alias("h"), at(1).alias("seq"), at(2).alias("p"), at(3).alias("qual"))
    ok = F.coalesce(F.col("h").startswith("@") & F.col("p").startswith("+") & F.col("qual").isNotNull(), F.lit(False))
    head = F.when(ok, F.col("h")).otherwise(F.raise_error(F.lit("not a fastq record")).cast("string"))
    return r.select("file", "row_no", F.regexp_extract(head, r"^@(\S*)", 1).alias("id"), "seq", "qual")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: id and sequence of multi-line records."""
    r = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>|>$", "").alias("r")).filter(F.trim("r") != "")
    return r.select(F.regexp_extract("r", r"^(\S*)", 1).alias("id"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("seq"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: five columns or an error."""
    c = F.split("line", "\t")
    ok = F.when(F.size(c) == 5, c).otherwise(F.raise_error(F.lit("not a fasta index")).cast("array<string>"))
    return _lines(spark, path).filter("line <> ''").select(ok[0].alias("sn"), *(ok[i].cast("long").alias(n) for i, n in ((1, "ln"), (2, "offset"), (3, "linebases"), (4, "linewidth"))))


def read_dict(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: @SQ lines: name, length, md5."""
    m = F.str_to_map("line", F.lit("\t"), F.lit(":"))
    return _lines(spark, path).filter(F.col("line").startswith("@SQ")).select(F.try_element_at(m, F.lit("SN")).alias("sn"), F.try_element_at(m, F.lit("LN")).cast("long").alias("ln"), F.try_element_at(m, F.lit("M5")).alias("m5"))


def read_bas(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: 17 to 21 columns: 17 lack file name and md5, 18 lack md5, missing last ones are null; the header goes."""
    c = F.split("line", "\t")
    none = F.array(F.lit(None).cast("string"))
    shaped = F.when(F.size(c) == 17, F.concat(none, none, c)).when(F.size(c) == 18, F.concat(F.slice(c, 1, 1), F.array(F.lit("")), F.slice(c, 2, 17))).when(F.size(c).between(19, 21), c).otherwise(F.raise_error(F.lit("not a bas row")).cast("array<string>"))
    rows = _lines(spark, path).filter(~F.col("line").startswith("bam_filename") & (F.col("line") != "")).withColumn("c", shaped)
    return rows.select(*(F.get("c", i).alias(n) for i, n in enumerate(BAS_COLUMNS)))


#: Sections of a lane statistics text.
SECTIONS = ("SN", "COV", "FFQ", "LFQ", "GCF", "GCL", "IC", "ID", "IS", "GCD", "MPC", "GCC", "RL")
#: Scalars that a whole text has at least.
LEAST_SCALARS = 22


def lane_stat_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: file, line_no, section and cells of a lane statistics text; comments and CHK go, an unknown section is an error."""
    r = numbered_lines(spark, path).filter(~F.col("line").rlike("^(#|CHK)") & (F.col("line") != "")).withColumn("c", F.split("line", "\t"))
    section = F.when(F.col("c")[0].isin(*SECTIONS), F.col("c")[0]).otherwise(F.raise_error(F.concat(F.lit("unknown section "), F.col("c")[0])).cast("string"))
    return r.select("file", "line_no", section.alias("section"), F.transform(F.slice("c", 2, F.size("c")), lambda x: F.when(x == "-nan", "0").otherwise(x)).alias("cells"))


def _scalar_name(key: Column) -> Column:
    """A scalar's key as a name: runs of blanks and hyphens are '_', '1st_fragments' and 'bases_mapped_(cigar)' are spelt out."""
    plain = F.regexp_replace(F.lower(key), r"[\s-]+", "_")
    return F.when(plain == "1st_fragments", "first_fragments").when(plain == "bases_mapped_(cigar)", "bases_mapped_cigar").otherwise(plain)


def read_lane_stats(spark: SparkSession, path: str, least: int = LEAST_SCALARS) -> DataFrame:
    """SRC-12: file, key, name and value of the scalars; a file with fewer than `least` of them is an error."""
    rows = lane_stat_rows(spark, path)
    sn = rows.filter("section = 'SN'").select("file", F.regexp_replace(F.col("cells")[0], ":$", "").alias("key"), F.col("cells")[1].alias("value"))
    n = rows.groupBy(F.col("file").alias("_f")).agg(F.count_if(F.col("section") == "SN").alias("_n"))
    checked = F.when(F.col("_n") >= least, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("only "), F.col("_n").cast("string"), F.lit(" scalars in "), F.col("_f"))).cast("string"))
    joined = n.join(sn, F.col("_f") == F.col("file"), "left").withColumn("key", checked).filter("key is not null")
    return joined.select("file", "key", _scalar_name(F.col("key")).alias("name"), "value")


def read_lane_sections(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: file, section, row_no (from 1, within the section) and vals, numbers, of all sections but SN and COV."""
    r = lane_stat_rows(spark, path).filter(~F.col("section").isin("SN", "COV"))
    r = r.select(F.concat_ws("\n", "file", "section").alias("_g"), "file", "section", "line_no", F.transform("cells", lambda x: x.try_cast("double")).alias("vals"))
    return number_within(r, "_g", "line_no").select("file", "section", F.col("rn").alias("row_no"), "vals")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: file, cov and n; [1000<] is 1001."""
    return lane_stat_rows(spark, path).filter("section = 'COV'").select("file", F.when(F.col("cells")[0] == "[1000<]", 1001).otherwise(F.regexp_extract(F.col("cells")[0], r"(\d+)", 1).try_cast("int")).alias("cov"), F.element_at("cells", -1).cast("long").alias("n"))


def read_fastqcheck(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: cycle and counts (six columns on, without the last) of the rows 'base N' and 'Total'."""
    c = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = _lines(spark, path).withColumn("c", c).filter(F.col("c")[0].isin("base", "Total"))
    at = F.when(F.col("c")[0] == "base", F.concat(F.array(F.lit("")), F.slice("c", 2, 1000))).otherwise(F.col("c"))
    return rows.withColumn("c", at).select(F.when(F.col("c")[0] == "Total", "Total").otherwise(F.col("c")[1]).alias("cycle"), F.transform(F.slice("c", F.when(F.col("c")[0] == "Total", 7).otherwise(8), F.greatest(F.size("c") - F.when(F.col("c")[0] == "Total", 7).otherwise(8), F.lit(0))), lambda x: x.cast("long")).alias("quals"))


def read_tranches(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: ten columns, or eleven with model before accessible_truth; comments and header go."""
    c = F.split("line", ",")
    rows = _lines(spark, path).filter(~F.col("line").rlike("^(#|targetTruthSensitivity)") & (F.col("line") != "")).withColumn("c", c)
    ten = F.when(F.size("c") == 11, F.concat(F.slice("c", 1, 7), F.slice("c", 9, 3))).when(F.size("c") == 10, F.col("c")).otherwise(F.raise_error(F.lit("not a tranche")).cast("array<string>"))
    return rows.select(F.when(F.size("c") == 11, F.col("c")[7]).alias("model"), ten.alias("t")).select("model", *((F.col("t")[i] if n == "filter_name" else F.col("t")[i].cast("double")).alias(n) for i, n in enumerate(TRANCHE_COLUMNS)))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: variants with INFO as a map and the sample cells."""
    c = F.split("line", "\t")
    rows = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.col("line") != "")).withColumn("c", c)
    return rows.select(F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("pos"), F.nullif(F.col("c")[2], F.lit(".")).alias("id"), F.col("c")[3].alias("ref"), F.split(F.col("c")[4], ",").alias("alt"), F.col("c")[5].try_cast("double").alias("qual"), F.split(F.col("c")[6], ";").alias("filter"), F.str_to_map(F.col("c")[7], F.lit(";"), F.lit("=")).alias("info"), F.get("c", 8).alias("format"), F.slice("c", 10, 1_000_000).alias("cells"))


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: file, column number (from 0) and sample of the last header line; no other line leaves the scan."""
    head = header_lines(spark, path, "^#CHROM\t").groupBy("file").agg(F.max_by("line", "place").alias("line"))
    return head.select("file", F.posexplode(F.slice(F.split("line", "\t"), 10, F.size(F.split("line", "\t")))).alias("column_no", "sample"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """PRJ-5: file and md5 of each file's bytes. A checksum goes over a file from its first byte to its last, so a file is one task, and of 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.md5("content").alias("md5"))


def vcf_genotypes(variants: DataFrame) -> DataFrame:
    """SRC-15: long genotypes: chrom, pos, column_no, gt."""
    gt = F.array_position(F.split("format", ":"), "GT").cast("int")
    return variants.filter("format is not null").select("chrom", "pos", gt.alias("_g"), F.posexplode("cells").alias("column_no", "cell")).filter("_g > 0").select("chrom", "pos", "column_no", F.get(F.split("cell", ":"), F.col("_g") - 1).alias("gt"))


def read_cnv_calls(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SRC-16: chrom, start, end; a row whose end isn't all digits goes."""
    if kind == "penncnv":
        p = r"^chr([^:\s]+):(\d+)-(\d+)"
        r = _lines(spark, path).select(*(F.regexp_extract("line", p, i).alias(n) for i, n in ((1, "chrom"), (2, "start"), (3, "end"))))
    else:
        c = F.split(F.trim("line"), r"\s+")
        r = _lines(spark, path).select(F.get(c, 1).alias("chrom"), F.get(c, 2).alias("start"), F.get(c, 3).alias("end"))
    return r.filter(F.col("end").rlike(r"^\d+$")).select("chrom", F.col("start").try_cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def read_gtcheck(spark: SparkSession, path: str, dialect: str = "CN") -> DataFrame:
    """SRC-17: CN rows (discordance, sites, avg_min_depth, sample pair), SM rows (discordance, avg_depth, sites, sample),
    'five' columns (concordance, uncertainty, avg_depth, sites, sample) with # comments,
    or likelihood lines 'sample NAME likelihood X over N sites, …'."""
    c = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    if dialect == "likelihood":
        p = r"sample (\S+) likelihood (\S+) over (\d+) sites"
        return _lines(spark, path).filter(F.col("line").rlike(p)).select(F.regexp_extract("line", p, 1).alias("sample"), F.regexp_extract("line", p, 2).cast("double").alias("score"), F.regexp_extract("line", p, 3).cast("long").alias("sites"))
    if dialect == "five":
        rows = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.size(c) == 5))
        return rows.select(c[0].cast("double").alias("concordance"), c[1].cast("double").alias("uncertainty"), c[2].cast("double").alias("avg_depth"), c[3].cast("double").cast("long").alias("sites"), c[4].alias("sample"))
    rows = _lines(spark, path).filter(F.get(c, 0) == dialect)
    if dialect == "CN":
        return rows.select(c[1].cast("double").alias("discordance"), c[2].cast("long").alias("sites"), c[3].cast("double").alias("avg_min_depth"), c[4].alias("sample_a"), c[5].alias("sample_b"))
    return rows.select(c[1].cast("double").alias("discordance"), c[2].cast("double").alias("avg_depth"), c[3].cast("long").alias("sites"), c[4].alias("sample"))


def read_plex_csv(spark: SparkSession, path: str, kind: str = "sequenom") -> DataFrame:
    """SRC-18: file, assay, genotype, allele, allele_two, height and height_two of tab-separated array exports.

    sequenom: a header, then lines in pairs of one assay (allele, assay, three
    more, genotype, height), an odd line or another assay being an error;
    'W<digits>-' before the assay goes, and a single-letter genotype gives both
    alleles. fluidigm: a line an assay, the second cell, with the call 'A:B' in
    the tenth and heights in the next two; two equal alleles are one letter, a
    call without two is empty. A height '.5' is 0.5."""
    height = lambda c: F.regexp_replace(c, r"^\.", "0.").try_cast("double")
    c = F.split("line", "\t")
    if kind == "fluidigm":
        call = F.split(F.get("c", 9), ":")
        a, b = F.coalesce(F.get(call, 0), F.lit("")), F.coalesce(F.get(call, 1), F.lit(""))
        whole = (a != "") & (b != "")
        genotype = F.when(whole & (a == b), a).when(whole, F.concat(a, b)).otherwise("")
        rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter("line <> ''").withColumn("c", c)
        return rows.select("file", F.get("c", 1).alias("assay"), genotype.alias("genotype"), a.alias("allele"), b.alias("allele_two"), height(F.get("c", 10)).alias("height"), height(F.get("c", 11)).alias("height_two"))
    n = numbered_lines(spark, path).filter("line_no > 1").withColumn("pair", F.floor((F.col("line_no") - 2) / 2)).withColumn("c", c)
    cells = F.struct(F.get("c", 0).alias("allele"), F.get("c", 1).alias("assay"), F.get("c", 5).alias("genotype"), F.get("c", 6).alias("height"))
    g = n.groupBy("file", "pair").agg(F.min_by(cells, "line_no").alias("a"), F.max_by(cells, "line_no").alias("b"), F.count("*").alias("n"))
    ok = F.when((F.col("n") == 2) & (F.col("a.assay") == F.col("b.assay")), F.col("a.assay")).otherwise(F.raise_error(F.concat(F.lit("lines don't pair: "), F.coalesce("a.assay", F.lit("")))).cast("string"))
    single = F.length("a.genotype") == 1
    allele = lambda p: F.when(single, F.col("a.genotype")).otherwise(F.col(f"{p}.allele"))
    return g.select("file", F.regexp_replace(ok, r"^W\d+-", "").alias("assay"), F.col("a.genotype").alias("genotype"), allele("a").alias("allele"), allele("b").alias("allele_two"), height(F.col("a.height")).alias("height"), height(F.col("b.height")).alias("height_two"))


def split_multisample_table(df: DataFrame, sample: str, folder: str, header: list[str] | None = None) -> None:
    """SRC-19: one pass over a multi-sample table, written partitioned by sample, each file with the header row, or with another one
    given in its stead (as many names as there are columns beside the sample)."""
    if header is not None:
        others = [c for c in df.columns if c != sample]
        df = df.select(sample, *(F.col(c).alias(n) for c, n in zip(others, header, strict=True)))
    df.write.partitionBy(sample).option("header", True).csv(folder)


def read_qc_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: pass (0 if absent) and matched name ('n/a' if absent) of QC JSON, an object a line."""
    j = F.from_json("line", "sample string, pass int, sample_name_match struct<matched_sample_name: string, match_score: double>")
    return _lines(spark, path).select(j.alias("j")).select("j.sample", F.coalesce("j.pass", F.lit(0)).alias("pass"), F.coalesce("j.sample_name_match.matched_sample_name", F.lit("n/a")).alias("matched"))


def read_ploidy(spark: SparkSession, path: str) -> tuple[list[tuple[str, int, int, int, int]], tuple[int, int]]:
    """UDF-2: ploidy and default, as chunk_genome takes them, of a definition in JSON: {"default": 2, "X": [{"from": 1, "to": 60000, "M": 1}]}.

    A region's sex that isn't given has the default, which is 2 where the definition has none. The definition is data and never evaluated."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    usual = int(given.pop("default", 2))
    regions = [(c, int(r["from"]), int(r["to"]), int(r.get("M", usual)), int(r.get("F", usual))) for c, rows in given.items() for r in rows]
    if wrong := [r for r in regions if r[1] < 1 or r[2] < r[1]]:
        raise ValueError(f"regions that end before they begin, or begin before 1: {wrong}")
    return regions, (usual, usual)


def read_contamination(spark: SparkSession, path: str, columns: int | None = 19, one_row: bool = True) -> DataFrame:
    """SRC-21: seq_id, and VBID_* keys and values of self-match tables; RG and NA go and # becomes N_.

    A table of other than `columns` columns is an error, and with one_row so is a file of other than one data row."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    if columns is not None and len(df.columns) != columns:
        raise ValueError(f"{len(df.columns)} columns instead of {columns}")
    if one_row:
        placed = df.withColumn("_f", F.col("_metadata.file_path"))
        n = placed.groupBy("_f").agg(F.count("*").alias("_n"))
        first = F.when(F.col("_n") == 1, F.col("`#SEQ_ID`")).otherwise(F.raise_error(F.concat(F.lit("not one data row in "), F.col("_f"))).cast("string"))
        df = placed.join(n, "_f").withColumn("#SEQ_ID", first).drop("_f", "_n")
    keys = [c for c in df.columns if c not in ("#SEQ_ID", "RG")]
    long = df.select(F.col("`#SEQ_ID`").alias("seq_id"), F.explode(F.array(*(F.struct(F.lit("VBID_" + c.replace("#", "N_", 1)).alias("key"), F.col(f"`{c}`").alias("val")) for c in keys))).alias("kv"))
    return long.select("seq_id", "kv.*").filter("val <> 'NA'")


def read_job_reports(spark: SparkSession, path: str, kind: str = "lsf") -> DataFrame:
    """SRC-22: cmd, status, memory_mb, wall_s, cpu_s, idle, queue, job and array_idx of job reports in logs.

    lsf: reports that begin with 'Sender: LSF System' and end with 'The output (if any) is above this job summary'; local: those between 'report
    start' and 'report end' marks, without memory, CPU time and queue. Blocks
    without both marks go. Status is OK, exited, killed, unknown, or the reason
    of a termination; idle is CPU over wall time, each 1 at least, two places."""
    get = lambda p, i=1: F.nullif(F.regexp_extract("b", "(?m)" + p, i), F.lit(""))
    none = lambda t: F.lit(None).cast(t)
    if kind == "local":
        b = spark.read.text(path, lineSep=" report start ---").select(F.col("value").alias("b")).filter(F.col("b").rlike(r"(?m)^#--- \S+ report end ---") & F.col("b").contains("# Started at: "))
        exit_line = get(r"^# Exit code: *(.*)$")
        status = F.when(exit_line.contains("OK"), "OK").when(exit_line.rlike("dumped|exited with code"), "exited").when(exit_line.contains("killed"), "killed").when(exit_line.isNotNull(), "unknown")
        time = lambda p: F.try_to_timestamp(get(p), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        wall = F.unix_timestamp(time(r"^# Finished at:? (\S+)$")) - F.unix_timestamp(time(r"^# Started at: (\S+)$"))
        return b.select(get(r"^# Cmd: (.+)$").alias("cmd"), status.alias("status"), none("double").alias("memory_mb"), wall.alias("wall_s"), none("double").alias("cpu_s"), none("double").alias("idle"), none("string").alias("queue"),
            get(r"^# Job: (\d+)").cast("long").alias("job"), get(r"^# Job: \d+\[(\d+)\]").cast("long").alias("array_idx"))
    b = spark.read.text(path, lineSep="Sender: LSF System").select(F.col("value").alias("b")).filter(F.col("b").contains("The output (if any) is above this job summary"))
    unit = get(r"^\s+Max Memory\s*:\s*\S+\s+(\S+)")
    mem = get(r"^\s+Max Memory\s*:\s*(\S+)\s").try_cast("double") * F.when(unit == "GB", 1024).when(unit == "KB", 1 / 1024).otherwise(1)
    cpu = F.coalesce(get(r"^\s+CPU time\s*:\s*([0-9.]+)").try_cast("double"), F.lit(0.0))
    time = lambda p: F.unix_timestamp(report_time(get(p)))
    wall = time(r"^Results reported at (.+)$") - time(r"^Started at (.+)$")
    # a log tells first what ended a job: later lines count before earlier ones, but a plain exit only where nothing else is known
    status = F.when(get(r"^(Successfully completed)").isNotNull(), "OK").when(get(r"^(Cannot open your job file)").isNotNull(), "unknown").when(get(r"^(TERM_\S+ job killed by)").isNotNull(), "killed").when(get(r"^TERM_([^:]+):").isNotNull(), get(r"^TERM_([^:]+):")).when(get(r"^(Exited with exit code)").isNotNull(), "exited")
    idle = F.round((F.greatest(cpu, F.lit(1.0)) / F.greatest(wall, F.lit(1))).cast("decimal(24,9)"), 2).cast("double")
    return b.select(get(r"# LSBATCH: User input\n([\s\S]*?)\n-{60}").alias("cmd"), status.alias("status"), mem.alias("memory_mb"), wall.alias("wall_s"), cpu.alias("cpu_s"), idle.alias("idle"), get(r"^Job was executed.+in queue <([^>]+)>").alias("queue"),
        get(r"^Subject: Job (\d+)").cast("long").alias("job"), get(r"^Subject: Job \d+\[(\d+)\]").cast("long").alias("array_idx"))


def read_concat_log(spark: SparkSession, path: str, marker: str = "-----") -> DataFrame:
    """SRC-23: file, block_no, text and newest of the blocks of concatenated logs, the last block of a file being newest 1. A marker line ends
    a block or begins one; a block without lines isn't there.

    Blocks are numbered by running counts over range partitions, so a log may be of any size; a block is one text."""
    n = numbered_lines(spark, path)
    marks = number_within(n.filter(F.col("line") == marker).select("file", "line_no"), "file", "line_no")
    lines = n.filter(F.col("line") != marker).select("file", "line_no", "line", F.lit(None).cast("long").alias("block_no"))
    both = lines.unionByName(marks.select("file", "line_no", F.lit(None).cast("string").alias("line"), F.col("rn").cast("long").alias("block_no")))
    known = last_known(both, "block_no", "file", "line_no").filter("line is not null").withColumn("block_no", F.coalesce("block_no", F.lit(0)))
    g = known.groupBy("file", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    g = stored(g, "blocks")
    place = number_within(g.select("file", "block_no").withColumn("_down", -F.col("block_no")), "file", "_down").select("file", "block_no", F.col("rn").alias("newest"))
    return g.join(place, ["file", "block_no"])


def read_tracking_tables(spark: SparkSession, folder: str | None = None, jdbc: dict[str, str] | None = None, tables: tuple[str, ...] = ("lane", "library", "sample", "study")) -> dict[str, DataFrame]:
    """SRC-24: tracking tables from Parquet or a database."""
    if jdbc:
        return {t: spark.read.format("jdbc").options(**jdbc, dbtable=t).load() for t in tables}
    return {t: spark.read.parquet(f"{folder}/{t}") for t in tables}


def file_type(code: Column) -> Column:
    """SRC-24: fq, bam, cram or gtc by type code."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv)), code.cast("int"))


def write_partitioned(df: DataFrame, by: str, folder: str, expected: DataFrame | None = None, salts: int = 1) -> DataFrame:
    """SNK-1: one output a value of `by` (salted where one value is much of the data), and a manifest that has expected values without rows as 0."""
    out = df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(salts))) if salts > 1 else df.repartition(by)
    out.write.partitionBy(by).parquet(folder)
    n = df.groupBy(by).agg(F.count("*").alias("rows"))
    return n if expected is None else expected.select(by).distinct().join(n, by, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def vcf_lines(variants: DataFrame) -> DataFrame:
    """SNK-2: variant lines in file order."""
    return variants.orderBy("chrom", "pos").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("PASS"), F.lit(".")).alias("value"))


def vcf_header(samples: list[str], source: str, date: str, info: dict[str, str] | None = None, formats: dict[str, str] | None = None) -> str:
    """SNK-2: header lines: format version, date, source, INFO and FORMAT fields (name to 'Number,Type,Description'), and the column line."""
    of = lambda kind, name, text: "##{}=<ID={},Number={},Type={},Description=\"{}\">".format(kind, name, *text.split(",", 2))
    lines = ["##fileformat=VCFv4.0", f"##fileDate={date}", f"##source={source}", *(of("INFO", n, t) for n, t in (info or {}).items()), *(of("FORMAT", n, t) for n, t in (formats or {}).items())]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return "\n".join([*lines, "\t".join(columns)])


def bed_lines(intervals: DataFrame) -> DataFrame:
    """SNK-2"""
    return intervals.orderBy("chrom", "start", "end").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """SNK-2: chunk lines in order, without a header: chromosome, from, to and what else there is."""
    rest = [c for c in chunks.columns if c not in ("chrom", "from", "to")]
    return chunks.orderBy("chrom", "from").select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("chrom", "from", "to", *rest))).alias("value"))


def table_lines(df: DataFrame, header: bool = True) -> DataFrame:
    """SNK-2: tab lines of a table (bas, chunks), a header first."""
    rows = df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"), F.lit(1).alias("o"))
    if header:
        rows = df.sparkSession.range(1).select(F.lit("\t".join(df.columns)).alias("value"), F.lit(0).alias("o")).unionByName(rows)
    return rows.orderBy("o", "value").select("value")


def write_lines(lines: DataFrame, folder: str, header: str | None = None) -> None:
    """SNK-2: one-column ordered lines as text files of a folder, a file a range partition; their names keep the order. A header is the
    first lines of the first file, so that the files one after another are one text."""
    if header is not None:
        head = lines.sparkSession.range(1).select(F.lit(header).alias("value"), F.lit(0).cast("long").alias("_o"))
        numbered = lines.withColumn("_o", F.monotonically_increasing_id() + 1)
        lines = head.unionByName(numbered).orderBy("_o").select("value")
    lines.write.text(folder)


def write_vcf(variants: DataFrame, folder: str, samples: list[str] = (), source: str = "", date: str = "") -> None:
    """SNK-2: variants in file order under a header."""
    write_lines(vcf_lines(variants), folder, vcf_header(list(samples), source, date))


def write_bas(stats: DataFrame, folder: str) -> None:
    """SNK-2: statistics rows under their column names."""
    write_lines(table_lines(stats), folder)


def write_bed(intervals: DataFrame, folder: str) -> None:
    """SNK-2"""
    write_lines(bed_lines(intervals), folder)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """SNK-2"""
    write_lines(chunk_lines(chunks), folder)
