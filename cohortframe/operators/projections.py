"""Projections between statistics, indexes, tracking tables and file metadata (PRJ-1 to PRJ-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import normalise_platform

DEPTHS = (1, 2, 5, 10, 20, 50, 100)


def _given(c: str) -> Column:
    """A column's text, null where empty."""
    return F.nullif(F.col(c).cast("string"), F.lit(""))


def two_places(c: Column) -> Column:
    """Rounded to two places, half up in decimals."""
    return F.round(c.cast("decimal(24,9)"), 2).cast("double")


def lane_stats_to_mapstats(stats: DataFrame, targeted: bool = False, prefix: str = "") -> DataFrame:
    """PRJ-1: tracking's mapping statistics of each lane from its file's metadata, whose keys may have a prefix.

    Of targeted sequencing also, for each depth, the fraction of raw bases at
    bases of that coverage, two places (null where there are none), mean target
    coverage and mapped target bases."""
    at = lambda c: F.col(prefix + c)
    out = [
        F.col("lane"), at("reads").alias("raw_reads"), at("bases").alias("raw_bases"), at("reads_mapped").alias("reads_mapped"), at("reads_paired").alias("reads_paired"), at("bases_mapped_c").alias("bases_mapped"), at("error_rate").alias("error_rate"),
        at("rmdup_reads_mapped").alias("rmdup_reads_mapped"), at("rmdup_bases_mapped").alias("rmdup_bases_mapped"), (at("bases") - at("bases_trimmed")).alias("clip_bases"), at("mean_insert_size").alias("mean_insert"), at("sd_insert_size").alias("sd_insert"),
    ]
    if targeted:
        out += [two_places(F.nullif(F.col(f"targeted_bases_of_{d}X_coverage"), F.lit(0)) / F.nullif(at("bases"), F.lit(0))).alias(f"target_bases_{d}x") for d in DEPTHS]
        out += [F.nullif(F.col("targeted_mean_coverage"), F.lit(0)).alias("mean_target_coverage"), F.col("targeted_bases_mapped_c").alias("target_bases_mapped")]
    return stats.select(*out)


def lane_updates(stats: DataFrame) -> DataFrame:
    """PRJ-1: what a lane's own row becomes: raw reads and bases, whether it is paired, its read length as a whole number, the QC status
    (`no_qc` turns `pending`, any other stays), and the sequencing centre's verdict as pass or fail where there is one."""
    npg = F.when(F.col("npg_qc_status").isNotNull(), F.when(F.col("npg_qc_status").cast("int") != 0, "pass").otherwise("fail"))
    return stats.select("lane", F.col("reads").alias("raw_reads"), F.col("bases").alias("raw_bases"), (F.coalesce(F.col("paired").cast("int"), F.lit(0)) != 0).alias("is_paired"), F.col("avg_read_length").cast("long").alias("read_len"),
        F.when(F.col("qc_status") == "no_qc", "pending").otherwise(F.col("qc_status")).alias("qc_status"), npg.alias("npg_status"))


def index_to_file_metadata(index: DataFrame, mates: DataFrame, remote_root: str | None = None) -> DataFrame:
    """PRJ-2: the metadata of each fastq of a sequence index (its columns as read), with mates (fastq_file, mate: 0, 1 or 2) as paired.

    An empty md5 or mate is null; the centre is in upper case; remote_path is under the given root, null without one."""
    of = {"lane": "run_id", "study": "study_id", "study_name": "study_name", "sample_id": "sample_id", "sample": "sample_name", "population": "population", "platform": "instrument_platform", "library": "library_name",
          "insert_size": "insert_size", "withdrawn": "withdrawn", "reads": "read_count", "bases": "base_count", "analysis_group": "analysis_group"}
    remote = F.concat(F.lit((remote_root or "").rstrip("/") + "/"), "fastq_file") if remote_root else F.lit(None).cast("string")
    paired = mates.select("fastq_file", F.col("mate").alias("paired"))
    return index.join(paired, "fastq_file", "left").select("fastq_file", _given("md5").alias("expected_md5"), F.upper("center_name").alias("center_name"), *(F.col(c).alias(n) for n, c in of.items()), "paired", _given("paired_fastq").alias("mate"), remote.alias("remote_path"))


def tracking_to_file_metadata(lanes: DataFrame, files: DataFrame, array_data: bool = False) -> DataFrame:
    """PRJ-3: the metadata of each tracked file (lane, name, md5, raw_reads, raw_bases, lane_id) from its lane's row.

    The individual is its alias where that is given and isn't `change_me`, else
    its name; counts and insert size that are missing are 0. Array data also have
    the analysis id, storage path, library tag, and control by the sample's
    note: 1 is Control, 2 Stem cell, anything else null."""
    alias = _given("individual_alias")
    individual = F.when(F.coalesce(alias, F.lit("change_me")) != "change_me", alias).otherwise(F.col("individual"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    columns = [
        F.col("name").alias("path"), F.col("md5").alias("expected_md5"), F.col("centre").alias("center_name"), "project", "study", _given("species").alias("species"), "population", individual.alias("individual"), "sample", F.col("seq_tech").alias("platform"),
        "library", "lane", zero("withdrawn"), zero("insert_size"), F.coalesce("raw_reads", F.lit(0)).alias("reads"), F.coalesce("raw_bases", F.lit(0)).alias("bases"), F.col("is_paired").alias("paired"), "lane_id",
    ]
    if array_data:
        control = F.when(F.col("note_id") == 1, "Control").when(F.col("note_id") == 2, "Stem cell")
        columns += [F.col("acc").alias("analysis_uuid"), control.alias("control"), "storage_path", _given("library_tag_sequence").alias("library_tag")]
    return files.join(lanes, "lane").select(*columns)


def assign_read_group(reads: DataFrame, files: DataFrame) -> DataFrame:
    """PRJ-4: reads (file_id, …) with their file's lane as read group; Spark broadcasts the files where they are few."""
    return reads.drop("rg").join(files.select("file_id", F.col("lane").alias("rg")), "file_id")


def read_group_rows(files: DataFrame, sample_key: str = "sample") -> DataFrame:
    """PRJ-4: ID, LB, PL, PU, SM, CN and DS of each file: the lane stands for a missing platform unit, the sample for a missing
    sample key, and unknown_* for what else is missing; the platform is normalised."""
    missing = lambda c, what: F.coalesce(_given(c), F.lit(f"unknown_{what}"))
    platform = F.when(_given("platform").isNull(), "unknown_platform").otherwise(normalise_platform(F.col("platform")))
    return files.select("file_id", F.col("lane").alias("id"), missing("library", "library").alias("lb"), platform.alias("pl"), F.coalesce(_given("platform_unit"), F.col("lane")).alias("pu"),
        F.coalesce(_given(sample_key), _given("sample"), F.lit("unknown_sample")).alias("sm"), missing("center_name", "centre").alias("cn"), missing("study", "study").alias("ds"))


def metadata_to_tracking(files: DataFrame) -> dict[str, DataFrame]:
    """PRJ-6: the tracking rows that file metadata make: lane, library, study, sample, species and individual.

    files: file_id, type (bam, cram, gtc, idat), lane, reads (total), library,
    library_id, infinium_sample, sample, sample_id, beadchip, beadchip_section,
    study_id, study_title, study_accession_number, taxon_id, sample_common_name,
    sample_supplier_name, sample_cohort, sample_accession_number, public_name,
    sample_control. Nearly empty alignments (below 1,000 reads) are left out; a
    missing study id, title or taxon is an error. Array data name their library
    by sample and chip, and number it by the chip's last four and the sample
    id's last three characters. Titles keep printable ASCII, other runs become
    '-'. Where files differ on one thing the latest (by file_id) counts; an
    individual's accession is the first given, its alias the first control's
    public name, else the first given."""
    kept = files.filter(~(F.col("type").isin("bam", "cram") & (F.coalesce("reads", F.lit(0)) < 1000)))
    for c in ("study_id", "study_title", "taxon_id"):
        kept = kept.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"missing {c}: file "), F.col("file_id").cast("string"))).cast(kept.schema[c].dataType)))
    array = F.col("type").isin("gtc", "idat")
    library = F.when(F.col("type") == "gtc", F.col("infinium_sample")).when(F.col("type") == "idat", F.concat_ws(".", "sample", "beadchip", "beadchip_section")).otherwise(F.col("library"))
    ssid = F.when(array, F.concat(F.substring("beadchip", -4, 4), F.substring(F.col("sample_id").cast("string"), -3, 3))).otherwise(F.col("library_id").cast("string"))
    tag = F.when(array, F.concat_ws("_", "beadchip", "beadchip_section"))
    f = kept.select("*", library.alias("_library"), ssid.alias("_ssid"), tag.alias("_tag"), F.regexp_replace("study_title", r"[^\x20-\x7f]+", "-").alias("_title"), F.coalesce(_given("sample_cohort"), F.col("sample")).alias("_individual"))
    latest = lambda key, **columns: f.groupBy(F.col(key[1]).alias(key[0])).agg(F.max_by(F.struct(*(F.col(c).alias(n) for n, c in columns.items())), "file_id").alias("r")).select(key[0], "r.*")
    first = lambda value, where: F.min_by(value, F.when(where, F.col("file_id")))
    named = _given("public_name")
    control = F.coalesce(F.col("sample_control").cast("int"), F.lit(0)) != 0
    individual = f.groupBy(F.col("_individual").alias("individual")).agg(
        first(F.col("sample_accession_number"), F.col("sample_accession_number").isNotNull()).alias("acc"),
        F.coalesce(first(named, named.isNotNull() & control), first(named, named.isNotNull())).alias("alias"), F.max_by("taxon_id", "file_id").alias("taxon_id"),
    )
    sample = f.groupBy("sample").agg(F.max_by(F.struct(F.coalesce(_given("sample_supplier_name"), F.col("sample")).alias("hierarchy_name"), F.col("sample_id").alias("ssid"), F.when(F.col("sample_control").isNotNull(), F.when(control, 1).otherwise(2)).alias("note_id"), F.col("_individual").alias("individual"), F.col("study_id").alias("study_id")), "file_id").alias("r")).select("sample", "r.*")
    study = f.groupBy("study_id").agg(F.max_by(F.struct(F.col("_title").alias("name"), F.coalesce(_given("study_accession_number"), F.col("study_id").cast("string")).alias("acc")), "file_id").alias("r")).select("study_id", "r.*")
    return {
        "lane": latest(("lane", "lane"), library="_library", sample="sample"),
        "library": latest(("library", "_library"), ssid="_ssid", tag="_tag", sample="sample"),
        "study": study,
        "sample": sample,
        "species": latest(("taxon_id", "taxon_id"), name="sample_common_name"),
        "individual": individual,
    }
