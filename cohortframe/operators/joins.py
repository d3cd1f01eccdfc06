"""Joins of files, samples, lanes, variants and genotypes (JON-5 to JON-18, JON-25, JON-27, JON-29 to JON-34, PRJ-5)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Old platform names and what they become.
PLATFORMS = {"SLX": "ILLUMINA", "454": "LS454", "SOLID": "ABI_SOLID"}


def normalise_platform(c: Column) -> Column:
    up = F.upper(c)
    return reduce(lambda acc, kv: F.when(up == kv[0], F.lit(kv[1])).otherwise(acc), PLATFORMS.items(), up)


def add_to_all_elements(elements: DataFrame, shared: DataFrame, most: int = 100_000) -> DataFrame:
    """JON-5: elements (element, paths) with all shared paths (sorted) appended; without shared paths no element is left.

    Every element of the result holds all shared paths, so these are a list to
    be added, of `most` paths at most; more are an error."""
    paths = sorted(r["path"] for r in shared.select("path").limit(most + 1).collect())
    if len(paths) > most:
        raise ValueError(f"more than {most} shared paths")
    if not paths:
        return elements.select("element", "paths").limit(0)
    return elements.select("element", F.concat("paths", text_array(paths)).alias("paths"))


def text_array(texts: list[str]) -> Column:
    """A constant array of texts, as one literal whatever its length."""
    return F.from_json(F.lit(json.dumps(texts)), "array<string>")


def enrich_from_warehouse(files: DataFrame, samples: DataFrame, studies: DataFrame, preferred: int | None = None) -> DataFrame:
    """JON-6: files with their sample's donor, gender (F, M or U) and sorted study names; of several studies the preferred is study."""
    per = studies.groupBy("sample").agg(F.array_sort(F.collect_set("study")).alias("studies"), F.max(F.when(F.col("study_id") == preferred, F.col("study"))).alias("own"))
    first = F.upper(F.substring("gender", 1, 1))
    sex = F.when(first.isin("F", "M"), first).otherwise("U")
    return files.join(samples.select("sample", "donor", sex.alias("sex")), "sample", "left").join(per, "sample", "left").withColumn("study", F.coalesce("own", F.when(F.size("studies") == 1, F.col("studies")[0]))).drop("own")


def attach_qc_files(files: DataFrame, listing: DataFrame, suffixes: list[str], require_all: bool = True) -> DataFrame:
    """JON-7: files with the QC files beside them or in qc/ below, named stem + suffix. Both sides are keyed by (folder, stem, suffix)."""
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.coalesce(*(F.when(name.endswith(s), F.lit(s)) for s in suffixes))
    found = listing.select(F.regexp_replace(folder, "/qc$", "").alias("folder"), suffix.alias("suffix"), name.alias("name"), F.col("path").alias("qc")).filter("suffix is not null")
    found = found.withColumn("stem", F.expr("substring(name, 1, length(name) - length(suffix))"))
    per = found.groupBy("folder", "stem").agg(F.array_sort(F.collect_set("qc")).alias("qc_files"), F.countDistinct("suffix").alias("n"))
    out = files.withColumn("folder", folder).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).join(per, ["folder", "stem"], "inner" if require_all else "left")
    return (out.filter(F.col("n") == len(suffixes)) if require_all else out).drop("folder", "stem", "n")


def known(c: Column) -> Column:
    """Null where a value counts as missing: empty, '-' or unknown_x."""
    return F.when(~(c.isin("", "-") | c.startswith("unknown_")), c)


def bas_metadata(stats: DataFrame, read_groups: DataFrame, index: DataFrame, by_unit: bool = False) -> DataFrame:
    """JON-8: stats (rg, …) with study, sample, platform and library from the header's read group, else the index, else unknown_*.

    read_groups: rg, sample, library, platform, study, pu; index: rg, sample,
    library, platform, study. By unit, a read group with a platform unit is given that as rg."""
    fields = ("study", "sample", "library", "platform")
    h = read_groups.select("rg", *(F.col(c).alias(f"h_{c}") for c in fields), *(["pu"] if by_unit else []))
    x = index.select("rg", *(F.col(c).alias(f"x_{c}") for c in fields))
    out = stats.join(h, "rg", "left").join(x, "rg", "left")
    pick = {c: F.coalesce(known(F.col(f"h_{c}")), known(F.col(f"x_{c}")), F.lit(f"unknown_{c}")) for c in fields}
    pick["platform"] = F.when(pick["platform"].startswith("unknown_"), pick["platform"]).otherwise(normalise_platform(pick["platform"]))
    rg = F.coalesce(known(F.col("pu")), "rg") if by_unit else F.col("rg")
    return out.select(rg.alias("rg"), *(c for c in stats.columns if c != "rg"), *(c.alias(n) for n, c in pick.items()))


def lane_info(index: DataFrame, field: str) -> DataFrame:
    """JON-9: each run's most common value of a field; ties go to the smaller value."""
    counts = index.filter(F.col(field).isNotNull()).groupBy("run_id", field).count()
    return counts.groupBy("run_id").agg(F.min_by(field, F.struct((-F.col("count")).alias("n"), F.col(field))).alias(field))


def lane_values(index: DataFrame, field: str) -> DataFrame:
    """JON-9: all distinct values of a field of each run, sorted."""
    return index.groupBy("run_id").agg(F.array_sort(F.collect_set(field)).alias("vals"))


def plex_manifest(rows: DataFrame) -> DataFrame:
    """JON-10: manifest rows (row_no, snp, ref, alt, chrom, pos, strand) by SNP: of one listed twice (on X and Y, a gender marker) the first
    row counts, with the last row's reference as alternative allele."""
    first = F.min_by(F.struct("ref", "alt", "chrom", "pos", "strand"), "row_no")
    g = rows.groupBy("snp").agg(first.alias("f"), F.max_by("ref", "row_no").alias("_last"), F.count("*").alias("_n"))
    return g.select("snp", F.col("f.ref").alias("ref"), F.when(F.col("_n") > 1, F.col("_last")).otherwise(F.col("f.alt")).alias("alt"), "f.chrom", "f.pos", "f.strand", (F.col("_n") > 1).alias("gender_marker"))


def plex_to_variants(calls: DataFrame, manifest: DataFrame) -> DataFrame:
    """JON-10: calls (sample, snp, genotype) on a manifest by SNP, as plex_manifest gives it: the manifest's alleles are complemented
    on '-', and an allele is 0 if it is the reference, else 1; an empty genotype is './.'; unknown assays go. One letter is both alleles."""
    flipped = lambda c: F.when(F.col("strand") == "-", F.translate(c, "ATGCatgc", "TACGtacg")).otherwise(F.col(c))
    a = F.substring("genotype", 1, 1)
    b = F.when(F.length("genotype") > 1, F.substring("genotype", 2, 1)).otherwise(a)
    code = lambda x: F.when(x == F.col("_ref"), "0").otherwise("1")
    gt = F.when(F.coalesce("genotype", F.lit("")) == "", "./.").otherwise(F.concat(code(a), F.lit("/"), code(b)))
    marker = F.col("gender_marker") if "gender_marker" in manifest.columns else F.lit(False)
    joined = calls.join(manifest, "snp").withColumn("_ref", flipped("ref")).withColumn("_alt", flipped("alt"))
    return joined.select("sample", "chrom", "pos", F.col("snp").alias("id"), F.col("_ref").alias("ref"), F.col("_alt").alias("alt"), gt.alias("gt"), marker.alias("gender_marker"))


def merge_sites_with_genotypes(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """JON-11: strict one-to-one join of sites and calls on (chrom, pos, ref, alt), after the reference suffix that an indel's alleles
    share beyond the site's is trimmed; a site or call without partner is an error."""
    s = sites.select("chrom", "pos", "ref", "alt", "qual")
    g = genotypes.join(s.select("chrom", "pos", F.col("ref").alias("site_ref")), ["chrom", "pos"], "left")
    trim = lambda c: F.expr(f"substring({c}, 1, length({c}) - greatest(length(ref) - length(coalesce(site_ref, ref)), 0))")
    g = g.select("chrom", "pos", trim("ref").alias("ref"), trim("alt").alias("alt"), "gt", F.lit(True).alias("_g"))
    both = s.withColumn("_s", F.lit(True)).join(g, ["chrom", "pos", "ref", "alt"], "full_outer")
    whole = F.col("_s") & F.col("_g")
    return both.select("chrom", "pos", "ref", "alt", F.when(F.coalesce(whole, F.lit(False)), F.col("qual")).otherwise(F.raise_error(F.lit("site and genotype don't match")).cast("int")).alias("qual"), "gt")


def control_first(files: DataFrame, group: str, key: str, pattern: str) -> DataFrame:
    """JON-13: files of each group numbered with its control first (the first by path that matches), then by path; error where there is none."""
    is_control = F.col(key).cast("string").rlike(pattern)
    w = Window.partitionBy(group)
    control = F.min(F.when(is_control, F.col("path"))).over(w)
    checked = F.when(control.isNotNull(), F.col("path") == control).otherwise(F.lit(False))
    out = files.withColumn("has_control", control.isNotNull()).withColumn("_c", checked)
    return out.withColumn("column_no", F.row_number().over(w.orderBy(F.desc("_c"), "path"))).drop("_c")


def merge_call_sets(calls: DataFrame, priority: list[str]) -> DataFrame:
    """JON-14: at each site the record of the call set of highest priority; a repeated name is an error."""
    if len(set(priority)) != len(priority):
        raise ValueError("call sets are listed twice")
    order = F.array_position(F.array(*(F.lit(x) for x in priority)), F.col("caller"))
    checked = calls.withColumn("_p", F.when(order > 0, order).otherwise(F.raise_error(F.concat(F.lit("unlisted call set "), F.col("caller"))).cast("long")))
    best = checked.groupBy("chrom", "pos").agg(F.min_by(F.struct("caller", "qual"), "_p").alias("r"))
    return best.select("chrom", "pos", "r.*")


def sample_region_ploidy(regions: DataFrame, samples: DataFrame, assumed: str = "M", sexes: DataFrame | None = None) -> DataFrame:
    """JON-15: samples (sample, sex) with each region's ploidy for their sex (other than F counts as male); ploidy 0 goes. Regions are a few rows a chromosome.

    A list of sexes (sample, sex) restricts the result to its own samples, whose sex it gives."""
    if sexes is not None:
        samples = samples.select("sample").join(sexes.select("sample", "sex"), "sample")
    sex = F.coalesce("sex", F.lit(assumed))
    return samples.crossJoin(regions).select("sample", "chrom", "from", "to", F.when(sex == "F", F.col("female")).otherwise(F.col("male")).alias("ploidy")).filter("ploidy > 0")


def assign_sex(files: DataFrame, table: DataFrame, assumed: str | None = None) -> DataFrame:
    """JON-16: sex of each file: its own, else its sample's, else the assumed; none at all is an error."""
    out = files.join(table.select("sample", F.col("sex").alias("_t")), "sample", "left")
    found = F.coalesce("sex", "_t", F.lit(assumed))
    return out.withColumn("sex", F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no sex for "), F.col("sample"))).cast("string"))).drop("_t")


def match_to_panel(query: DataFrame, panel: DataFrame) -> DataFrame:
    """JON-18: concordance, sites and average depth of each query sample against each panel sample."""
    q = query.select("chrom", "pos", F.col("sample").alias("query"), F.col("gt").alias("q_gt"), F.col("dp").alias("q_dp"))
    p = panel.select("chrom", "pos", F.col("sample").alias("panel_sample"), F.col("gt").alias("p_gt"))
    return q.join(p, ["chrom", "pos"]).groupBy("query", "panel_sample").agg(F.count("*").alias("sites"), (F.count_if(F.col("q_gt") == F.col("p_gt")) / F.count("*")).alias("concordance"), F.avg("q_dp").alias("avg_depth"))


def in_all_tables(long: DataFrame, keys: list[str], table: str, n: int) -> DataFrame:
    """JON-25/33: rows of the long union of n tables whose key is in all of them."""
    whole = long.groupBy(*keys).agg(F.countDistinct(table).alias("_n")).filter(F.col("_n") == n).drop("_n")
    return long.join(whole, keys, "left_semi")


def merge_profiles(long: DataFrame, n: int, tags: list[str]) -> DataFrame:
    """JON-25: profiles (table, key1, key2, column, value) inner-joined on both keys: a row a key pair in all n tables, with the values of its
    columns in the order of the tags in their names (the first tag that a name ends in), then by name; columns without a tag come last.

    values is an array of (column, value) in that order."""
    place = F.coalesce(*(F.when(F.col("column").endswith(t), F.lit(i)) for i, t in enumerate(tags)), F.lit(len(tags))) if tags else F.lit(0)
    kept = in_all_tables(long, ["key1", "key2"], "table", n)
    cells = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "column", "value"))), lambda x: F.struct(x["column"].alias("column"), x["value"].alias("value")))
    return kept.groupBy("key1", "key2").agg(cells.alias("values"))


#: What an annotation table must have.
ANNOTATION_COLUMNS = ("TargetID", "ProbeID", "REFSEQ_ID", "SYMBOL", "PROBE_SEQUENCE", "CHROMOSOME", "PROBE_COORDINATES", "DEFINITION")


def merge_annotations(tables: list[DataFrame], columns: tuple[str, ...] = ANNOTATION_COLUMNS) -> DataFrame:
    """JON-33: rows that all annotation tables have, of the required columns; a column that some table lacks is NaN in all of them."""
    present = [c for c in columns if all(c in t.columns for t in tables)]
    rows = reduce(DataFrame.intersect, [t.select(*(F.col(c) for c in present)) for t in tables])
    return rows.select(*(F.col(c) if c in present else F.lit("NaN").alias(c) for c in columns))


def diff_indexes(old: DataFrame, new: DataFrame) -> DataFrame:
    """JON-27: what became of each lane (run.analysis_group): gone, new, withdrawn, reinstated, changed (with the fields) or same."""
    def lanes(df: DataFrame, p: str) -> DataFrame:
        key = F.concat_ws(".", "run_id", F.regexp_replace("analysis_group", " ", "_"))
        return df.groupBy(key.alias("lane")).agg(F.sum("read_count").alias(f"{p}reads"), F.sum("base_count").alias(f"{p}bases"), F.max_by("library_name", "row_no").alias(f"{p}library"), F.min("withdrawn").alias(f"{p}withdrawn"))

    j = lanes(old, "o_").join(lanes(new, "n_"), "lane", "full_outer")
    diffs = F.array_compact(F.array(*(F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), c) for c in ("reads", "bases", "library"))))
    what = F.when(F.col("o_withdrawn").isNull(), "new").when(F.col("n_withdrawn").isNull(), "gone").when((F.col("o_withdrawn") == 0) & (F.col("n_withdrawn") == 1), "withdrawn").when((F.col("o_withdrawn") == 1) & (F.col("n_withdrawn") == 0), "reinstated").when(F.size(diffs) > 0, "changed").otherwise("same")
    return j.select("lane", what.alias("what"), F.when(what == "changed", F.array_join(diffs, ",")).otherwise("").alias("fields"))


def population_lists(files: DataFrame, patterns: list[tuple[str, str]], chroms: list[str]) -> DataFrame:
    """JON-29: files of each population (name, pattern) and chromosome; a file that fits two patterns comes twice. The patterns are a few literals."""
    groups = F.array_compact(F.array(*(F.when(F.col("path").rlike(p), F.lit(n)) for n, p in patterns)))
    return files.select("path", F.explode(groups).alias("population")).withColumn("chrom", F.explode(F.array(*(F.lit(c) for c in chroms))))


def pair_alignment_with_stats(files: DataFrame) -> DataFrame:
    """JON-30: lanes with their one alignment and one stats file; any other number is an error."""
    g = files.groupBy("lane").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "bam").alias("b"), F.max(F.when(F.col("kind") == "bam", F.col("path"))).alias("alignment"), F.max(F.when(F.col("kind") == "stats", F.col("path"))).alias("stats"))
    return g.select("lane", F.when((F.col("n") == 2) & (F.col("b") == 1), F.col("alignment")).otherwise(F.raise_error(F.concat(F.lit("not one of each for "), F.col("lane"))).cast("string")).alias("alignment"), "stats")


def pair_mates(index: DataFrame) -> DataFrame:
    """JON-31: mate 0 for unpaired files, 1 for the first row of a pair and 2 for the second."""
    other = index.select(F.col("fastq_file").alias("_f"), F.col("row_no").alias("_n"))
    j = index.join(other, F.col("paired_fastq") == F.col("_f"), "left")
    return j.select("fastq_file", F.when(F.col("paired_fastq") == "", 0).when(F.col("_n").isNull() | (F.col("row_no") < F.col("_n")), 1).otherwise(2).alias("mate"))


def reads_to_fastq(reads: DataFrame) -> DataFrame:
    """JON-32: primary reads by (rg, qname): forward and reverse where both ends are there, else single; reads and bases of each kind."""
    primary = reads.filter(F.col("flag").bitwiseAND(F.lit(256)) == 0)
    end = F.when(F.col("flag").bitwiseAND(F.lit(64)) != 0, 1).otherwise(2)
    per = primary.withColumn("_end", end).groupBy("rg", "qname").agg(F.count_if(F.col("_end") == 1).alias("n1"), F.count_if(F.col("_end") == 2).alias("n2"), F.sum(F.when(F.col("_end") == 1, F.col("len"))).alias("b1"), F.sum(F.when(F.col("_end") == 2, F.col("len"))).alias("b2"))
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    parts = F.array(F.struct(F.when(both, "forward").otherwise("single").alias("kind"), F.col("n1").alias("n"), F.coalesce("b1", F.lit(0)).alias("b")), F.struct(F.when(both, "reverse").otherwise("single").alias("kind"), F.col("n2").alias("n"), F.coalesce("b2", F.lit(0)).alias("b")))
    return per.select("rg", F.explode(parts).alias("p")).filter("p.n > 0").groupBy("rg", F.col("p.kind").alias("kind")).agg(F.sum("p.n").alias("reads"), F.sum("p.b").alias("bases")).withColumn("avg_length", F.round(F.col("bases") / F.col("reads"), 2))


def parent_child_elements(elements: DataFrame, links: DataFrame, outputs: DataFrame) -> DataFrame:
    """JON-34: each output file with the parents of the element that made it, each once."""
    made = outputs.select("path", F.col("element").alias("child"))
    return made.join(links.select("parent", "child"), "child").join(elements.select(F.col("element").alias("parent"), "source"), "parent").select("path", "child", "parent", "source").distinct()


def vcf_file_metadata(samples: DataFrame, checksums: DataFrame) -> DataFrame:
    """PRJ-5: file, samples (in the header's order, joined by '#') and md5 of each file. samples: file, column_no, sample; checksums: file, md5."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("column_no", "sample"))), lambda x: x["sample"])
    return samples.groupBy("file").agg(F.array_join(listed, "#").alias("samples")).join(checksums, "file", "left")
