"""Filters and predicates over files, lanes, reads, variants and calls (FLT-1 to FLT-20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bits of the alignment flag.
FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "failed_qc": 512, "duplicate": 1024}
#: Predicates that hold where their bit is not set.
UNSET = {"mapped": "unmapped", "mate_mapped": "mate_unmapped", "primary": "secondary", "passes_qc": "failed_qc"}


def parse_spec(spec: str, parts: int = 2) -> list[list[str]]:
    """'key#regex,key2#regex2' as lists; a malformed spec is an error."""
    found = [x.split("#") for x in spec.split(",")]
    if not spec or any(len(x) != parts or not x[0] for x in found):
        raise ValueError(f"malformed filter: {spec!r}")
    return found


def metadata_matches(eav: DataFrame, spec: str) -> DataFrame:
    """file_id and passed: whether every key of the spec is present with a matching value."""
    rules = parse_spec(spec)
    hits = [F.coalesce(F.bool_or((F.col("key") == k) & F.col("val").rlike(r)), F.lit(False)) for k, r in rules]
    return eav.groupBy("file_id").agg(reduce(lambda a, b: a & b, hits).alias("passed"))


def filter_by_metadata(files: DataFrame, eav: DataFrame, spec: str, before_grouping: bool = True) -> DataFrame:
    """FLT-1: before grouping, files that match; after, all files with passed."""
    keys = [k for k, _ in parse_spec(spec)]
    found = metadata_matches(eav.filter(F.col("key").isin(keys)), spec)
    if before_grouping:
        return files.join(found.filter("passed"), "file_id", "left_semi")
    return files.join(found, "file_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def group_passes_if_any(df: DataFrame, group: str) -> DataFrame:
    """FLT-2: members of groups of which one member passed."""
    return df.join(df.groupBy(group).agg(F.bool_or("passed").alias("any")).filter("any"), group, "left_semi")


def filter_by_ancestor(files: DataFrame, reached: DataFrame, label: str, value: str) -> DataFrame:
    """FLT-3: files (id) with an ancestor of the label whose prop matches value. reached: start, label, prop of every ancestor.

    Value '0' asks for at least one such ancestor, all of them with a false prop."""
    own = reached.filter(F.col("label") == label)
    truthy = F.col("prop").isNotNull() & ~F.col("prop").isin("", "0")
    if value == "0":
        clean = own.groupBy("start").agg(F.bool_or(truthy).alias("bad")).filter("not bad")
        return files.join(clean, files["id"] == clean["start"], "left_semi")
    met = own.filter(F.col("prop").rlike(value)).select("start")
    return files.join(met, files["id"] == met["start"], "left_semi")


def flag_is(what: str, flag: Column | str = "flag") -> Column:
    """FLT-4: a predicate on the alignment flag."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    if what in UNSET:
        return flag.bitwiseAND(F.lit(FLAGS[UNSET[what]])) == 0
    return flag.bitwiseAND(F.lit(FLAGS[what])) != 0


def select_reads(reads: DataFrame, flags: dict[str, bool] | None = None, min_mapq: int = 0, library: str | None = None, read_group: str | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
    """FLT-5: one filter over flags (required or excluded bits), mapping quality, library, read group and region."""
    need = sum(FLAGS[k] for k, v in (flags or {}).items() if v)
    avoid = sum(FLAGS[k] for k, v in (flags or {}).items() if not v)
    tests = [F.col("mapq") >= min_mapq]
    if need:
        tests.append(F.col("flag").bitwiseAND(F.lit(need)) == need)
    if avoid:
        tests.append(F.col("flag").bitwiseAND(F.lit(avoid)) == 0)
    if library is not None:
        tests.append(F.col("lib") == library)
    if read_group is not None:
        tests.append(F.col("rg") == read_group)
    if region is not None:
        tests += [F.col("rname") == region[0], F.col("pos").between(region[1], region[2])]
    return reads.filter(reduce(lambda a, b: a & b, tests))


def project_fields(reads: DataFrame, fields: list[str], tags: tuple[str, ...] = ()) -> DataFrame:
    """FLT-6: chosen fields, and tags as columns (null where absent)."""
    return reads.select(*fields, *(F.try_element_at("tags", F.lit(t)).alias(t) for t in tags))


def filter_index(index: DataFrame, platform: str = ".", analysis_group: str = ".", ignore_withdrawn: bool = True) -> DataFrame:
    """FLT-7"""
    kept = index.filter(F.col("instrument_platform").rlike(platform) & F.col("analysis_group").rlike(analysis_group) & (F.coalesce("run_id", F.lit("")) != ""))
    return kept.filter("withdrawn = 0") if ignore_withdrawn else kept


def filter_lanes(lanes: DataFrame, samples: DataFrame | None = None, libraries: DataFrame | None = None, **patterns: str) -> DataFrame:
    """FLT-8: lanes whose named properties all match their patterns; a null one doesn't.

    project and sample may come from tables of their own: libraries (library,
    sample) and samples (sample, project), joined where given. Patterns name
    columns: project, sample, library, gt_status, qc_status, auto_qc_status, npg_status, …"""
    columns = lanes.columns
    if libraries is not None:
        lanes = lanes.join(libraries.select("library", "sample"), "library", "left")
    if samples is not None:
        lanes = lanes.join(samples.select("sample", "project"), "sample", "left")
    return lanes.filter(reduce(lambda a, b: a & b, (F.col(c).rlike(p) for c, p in patterns.items()), F.lit(True))).select(*columns)


def index_lanes(index: DataFrame, field: str, value: str, ignore: dict[str, str] | None = None) -> DataFrame:
    """FLT-9: distinct runs with a property, without rows that match an ignored pattern (case-insensitive)."""
    kept = index.filter(F.col(field) == value)
    for column, pattern in (ignore or {}).items():
        kept = kept.filter(~F.coalesce(F.col(column).cast("string").rlike(f"(?i){pattern}"), F.lit(False)))
    return kept.select("run_id").distinct()


def search_files_by_metadata(eav: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """FLT-10: files that every (key, value) term hits; % is a wildcard in either."""
    hit = [F.col("key").like(k) & F.col("val").like(v) for k, v in terms]
    wanted = eav.filter(reduce(lambda a, b: a | b, hit))
    found = wanted.groupBy("file_id").agg(*(F.bool_or(h).alias(f"t{i}") for i, h in enumerate(hit)))
    return found.filter(reduce(lambda a, b: a & b, (F.col(f"t{i}") for i in range(len(hit))))).select("file_id")


def filter_outputs_exact(files: DataFrame, spec: str) -> DataFrame:
    """FLT-11: 'k=v,k2=v2' equality on columns."""
    pairs = [x.split("=", 1) for x in spec.split(",")]
    if any(len(x) != 2 for x in pairs):
        raise ValueError(f"malformed filter: {spec!r}")
    return files.filter(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in pairs)))


def require_keys(eav: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-12: files that have every key."""
    return eav.filter(F.col("key").isin(keys)).groupBy("file_id").agg(F.countDistinct("key").alias("n")).filter(F.col("n") == len(set(keys))).select("file_id")


def soft_filter_variants(variants: DataFrame, rules: list[tuple[str, str, str, float, str]]) -> DataFrame:
    """FLT-13: rules (scope all/snp/indel, field, operator, cutoff, name) add the names of those that hold to filter; none gives PASS. No row goes."""
    tests = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}
    named = [F.when((F.lit(scope) == "all") | (F.col("kind") == scope), F.when(tests[op](F.col(field), F.lit(cutoff)), F.lit(name))) for scope, field, op, cutoff, name in rules]
    found = F.array_compact(F.array(*named))
    return variants.withColumn("filter", F.when(F.size(found) == 0, F.array(F.lit("PASS"))).otherwise(found))


def vqslod_cutoff(tranches: DataFrame, sensitivity: float) -> DataFrame:
    """FLT-14: the highest minimum score among tranches of sensitivity below the given one and above 0; no positive cutoff is an error at collection."""
    best = F.max(F.when((F.col("target_sensitivity") < sensitivity) & (F.col("target_sensitivity") > 0), F.col("min_vqslod")))
    return tranches.agg(F.when(best > 0, best).otherwise(F.raise_error(F.lit("no positive cutoff")).cast("double")).alias("cutoff"))


def apply_vqslod(variants: DataFrame, snp_cut: float, indel_cut: float) -> DataFrame:
    """FLT-14: soft filter by score and class; the row count is unchanged."""
    low = F.col("vqslod") < F.when(F.col("kind") == "indel", indel_cut).otherwise(snp_cut)
    return variants.withColumn("filter", F.when(low, "LowVQSLOD").otherwise("PASS"))


def filter_cnvs(calls: DataFrame, min_snps: int = 10, min_length: int | str = 130_000, min_confidence: float = 10) -> DataFrame:
    """FLT-15: calls (num_snps, start, end, confidence) that are large and sure enough; min_length may be text as '130k'."""
    least = size_with_suffix(F.lit(min_length)) if isinstance(min_length, str) else F.lit(min_length)
    return calls.filter((F.col("num_snps") >= min_snps) & (F.col("end") - F.col("start") + 1 >= least) & (F.col("confidence") >= min_confidence))


def parse_cnv_lines(lines: DataFrame) -> DataFrame:
    """FLT-15: lines 'chr1:1-500 numsnp=3 length=500 state2,cn=1 FILE startsnp=a endsnp=b conf=12.5' as line, chrom, start, end, num_snps, length, state, sample and confidence; other lines go."""
    at = lambda p: F.regexp_extract("line", p, 1)
    number = lambda key: size_with_suffix(at(rf"\b{key}=([0-9,]+[kKmM]?)"))
    return lines.filter(F.col("line").rlike(r"^chr[^:\s]+:\d+-\d+\s.*numsnp=")).select("line", at(r"^chr([^:\s]+):").alias("chrom"), at(r":(\d+)-").cast("long").alias("start"), at(r":\d+-(\d+)").cast("long").alias("end"),
        number("numsnp").alias("num_snps"), number("length").alias("length"), at(r"(state\d+,cn=\d+)").alias("state"), at(r"state\d+,cn=\d+\s+(\S+)").alias("sample"), F.nullif(at(r"conf=([0-9.]+)"), F.lit("")).cast("double").alias("confidence"))


def size_with_suffix(text: Column) -> Column:
    """FLT-15: '130k', '1m' or '1,234' as a number; null if it is none."""
    digits = F.regexp_replace(F.lower(text), r"[,km]", "").try_cast("long")
    return digits * F.when(F.lower(text).endswith("k"), 1000).when(F.lower(text).endswith("m"), 1_000_000).otherwise(1)


def filter_sequences(df: DataFrame, min_length: int | None = None, column: str = "seq") -> DataFrame:
    """FLT-16: without a minimum length nothing comes out."""
    return df.filter(F.lit(False)) if min_length is None else df.filter(F.length(column) >= min_length)


def complete_genotypes_only(genotypes: DataFrame, samples: int) -> DataFrame:
    """FLT-17: sites at which all samples have a genotype without a missing allele."""
    return genotypes.groupBy("chrom", "pos").agg(F.count_if(~F.col("gt").contains(".")).alias("n")).filter(F.col("n") == samples).select("chrom", "pos")


def completed_elements(states: DataFrame, total_steps: int, all_required: bool = False) -> DataFrame:
    """FLT-18: elements of each setup finished by every step; with all_required, none of a setup that has an unfinished one."""
    per = states.groupBy("setup", "element").agg(F.countDistinct(F.when(F.col("done") == 1, F.col("step"))).alias("n")).withColumn("complete", F.col("n") >= total_steps)
    if all_required:
        whole = per.groupBy("setup").agg(F.bool_and("complete").alias("all")).filter("all")
        per = per.join(whole, "setup", "left_semi")
    return per.filter("complete").select("setup", "element")


def strip_tags(reads: DataFrame, tags: list[str]) -> DataFrame:
    """FLT-19"""
    return reads.withColumn("tags", F.map_filter("tags", lambda k, v: ~k.isin(tags)))


def parse_outputs(spec: str) -> list[tuple[str, str | None, str | None]]:
    """FLT-20: 'setup[step:kind,…]|setup2[…]' as (setup, step, kind); no brackets mean all steps."""
    out: list[tuple[str, str | None, str | None]] = []
    for part in spec.split("|"):
        setup, bracket, rest = part.partition("[")
        if not setup or bracket and not rest.endswith("]"):
            raise ValueError(f"malformed outputs: {spec!r}")
        for item in rest[:-1].split(",") if bracket else [""]:
            step, _, kind = item.partition(":")
            out.append((setup, step or None, kind or None))
    return out


def select_outputs(outputs: DataFrame, spec: str, inputs: DataFrame | None = None) -> DataFrame:
    """FLT-20: outputs (setup, step, kind, …) that the spec names; the parsed spec is a handful of rows and becomes one predicate.

    step, a column of either step names or numbers (or step_no beside step), is
    compared as text. Step 0 is a setup's inputs: with inputs (the same columns
    but step) they are given as step 0. No brackets mean all steps, without the inputs."""
    numbered = "step_no" in outputs.columns
    if inputs is not None:
        as_step = inputs.withColumn("step", F.lit("0").cast(outputs.schema["step"].dataType))
        outputs = outputs.unionByName(as_step.withColumn("step_no", F.lit(0)) if numbered else as_step, allowMissingColumns=True)
    tests = []
    for setup, step, kind in parse_outputs(spec):
        t = F.col("setup").cast("string") == setup
        own = F.col("step").cast("string")
        t = t & ((own == step) | (F.col("step_no").cast("string") == step) if numbered else own == step) if step else t & (own != "0")
        tests.append(t & (F.col("kind") == kind) if kind else t)
    return outputs.filter(reduce(lambda a, b: a | b, tests))


def latest_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each group: the first by the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
