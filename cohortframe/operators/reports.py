"""Reports over the lab hierarchy, releases, files and elements (JON-19 to JON-24, JON-26, JON-28, JON-37, JON-38)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import stored
from .filters import latest_first
from .graph import nearest_labelled


def sequencing_hierarchy(nodes: DataFrame, edges: DataFrame, start: DataFrame, only_preferred: bool = False) -> DataFrame:
    """JON-19: of each start node (id) the nearest lane at most 20 steps up, with library, sample, gender, taxon, study and donor above it;
    where there is no lane, the nearest array section, with its chip as library.

    nodes: id, label; edges: src, dst, type, preferred. The preferred study of
    the sample counts, the smallest id of several; else, unless only that is
    wanted, its smallest. A start without lane and section has no row."""
    above = stored(nearest_labelled(edges, nodes, start, ["Lane", "Section"]), "above")
    lanes = above.filter("label = 'Lane'").select("start", F.col("nearest").alias("lane"))
    sections = above.filter("label = 'Section'").select("start", F.col("nearest").alias("lane")).join(lanes.select("start"), "start", "left_anti")
    to = lambda kind, src, dst: edges.filter(F.col("type") == kind).groupBy(F.col("dst").alias(dst)).agg(F.min("src").alias(src))
    sequenced = lanes.join(to("sequenced", "library", "lane"), "lane").join(to("prepared", "sample", "library"), "library")
    placed = sections.join(to("section", "library", "lane"), "lane").join(to("placed", "sample", "lane"), "lane")
    kind = lambda df, what: df.select("start", F.lit(what).alias("kind"), "lane", "library", "sample")
    found = kind(sequenced, "lane").unionByName(kind(placed, "section"))
    label = lambda what: nodes.filter(F.col("label") == what).select(F.col("id").alias("src"))
    gender = edges.filter(F.col("type") == "gender").groupBy(F.col("src").alias("sample")).agg(F.min("dst").alias("gender"))
    member = edges.filter(F.col("type") == "member")
    taxon = member.join(label("Taxon"), "src").groupBy(F.col("dst").alias("sample")).agg(F.min("src").alias("taxon"))
    best, any_one = F.min(F.when(F.coalesce("preferred", F.lit(0)) == 1, F.col("src"))), F.min("src")
    study = member.join(label("Study"), "src").groupBy(F.col("dst").alias("sample")).agg((best if only_preferred else F.coalesce(best, any_one)).alias("study"))
    donor = to("sample", "donor", "sample")
    return reduce(lambda a, b: a.join(b, "sample", "left"), (gender, taxon, study, donor), found)


def donor_gender_check(samples: DataFrame, genders: DataFrame) -> DataFrame:
    """JON-20: expected and measured gender of samples that haven't failed QC. genders: sample, source (expected/measured), gender."""
    of = lambda s: genders.filter(F.col("source") == s).select("sample", F.col("gender").alias(s))
    return samples.filter("not qc_failed").join(of("expected"), "sample", "left").join(of("measured"), "sample", "left").select("donor", "sample", "expected", "measured")


def _comparisons(results: DataFrame, kind: str) -> DataFrame:
    """sample, key, discordance, sites, depth and other of the latest result of a kind of each sample (sample, type, date, cns: JSON of key to [discordance, sites, depth, other])."""
    latest = latest_first(results.filter(F.col("type") == kind), ["sample"], F.desc("date"), F.desc("cns"))
    found = latest.select("sample", F.explode(F.from_json("cns", "map<string,array<string>>")).alias("key", "c"))
    return found.select("sample", "key", F.get("c", 0).cast("double").alias("discordance"), F.get("c", 1).cast("long").alias("sites"), F.get("c", 2).cast("double").alias("avg_min_depth"), F.get("c", 3).alias("other"))


def donor_discordance(results: DataFrame, samples: DataFrame, studies: DataFrame, kind: str = "genotype") -> DataFrame:
    """JON-21: comparisons between the samples of each donor, by the latest result of a kind: donor, discordance, sites, avg_min_depth and of
    both samples name, public name, control and studies.

    samples: sample, donor, public_name, control, qc_failed; studies: sample,
    study_id. Samples that failed QC are left out; a key that two samples have
    counts once. The first of a pair is that of the smaller study text, then the control, then
    the smaller public name. Fluidigm results, where a donor's samples are in
    several sets of studies, count only within the set with the most samples, or
    between it and another if both samples have one public name."""
    sets = studies.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.col("study_id").cast("long"))), lambda x: x.cast("string")), ",").alias("study"))
    known = samples.join(sets, "sample", "left").withColumn("study", F.coalesce("study", F.lit("0")))
    largest = known.groupBy("donor", "study").count().groupBy("donor").agg(F.min_by("study", F.struct((-F.col("count")).alias("n"), F.col("study"))).alias("largest"), F.count("*").alias("sets"))
    ok = known.filter("not qc_failed").select("donor", "sample", F.struct("study", (~F.col("control")).alias("not_control"), "public_name", F.col("sample").alias("name")).alias("m"))
    found = _comparisons(results, kind).join(ok.select("donor", "sample", F.col("m").alias("m1")), "sample")
    met = found.join(ok.select("donor", F.col("sample").alias("other"), F.col("m").alias("m2")), ["donor", "other"])
    once = met.groupBy("donor", "key").agg(F.min_by(F.struct("discordance", "sites", "avg_min_depth", F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")), "sample").alias("r")).select("donor", "r.*")
    if kind == "fluidigm":
        once = once.join(largest, "donor")
        inside = lambda m: F.col(f"{m}.study") == F.col("largest")
        same_name = F.col("a.public_name") == F.col("b.public_name")
        once = once.filter((F.col("sets") == 1) | (inside("a") & inside("b")) | ((inside("a") | inside("b")) & same_name))
    of = lambda m, n: [F.col(f"{m}.name").alias(f"sample{n}"), F.col(f"{m}.public_name").alias(f"public_name{n}"), (~F.col(f"{m}.not_control")).alias(f"control{n}"), F.col(f"{m}.study").alias(f"study{n}")]
    return once.select("donor", "discordance", "sites", "avg_min_depth", *of("a", 1), *of("b", 2))


def sample_discordance(results: DataFrame, samples: DataFrame, studies: DataFrame, groups: DataFrame, asked: DataFrame) -> DataFrame:
    """JON-21: of each asked sample the comparisons of its latest fluidigm result with all samples of the studies in its groups, other than the
    group of all studies: sample, other, discordance, sites, avg_min_depth, and the other's public name, control and donor.

    groups: name, study_id. Others that failed QC are left out. rank orders
    them: likely the same individual (discordance below 3 on over 15 sites)
    first, then by sites that agree, controls first, then public name."""
    # pairs come from the comparisons alone, each with both samples' groups; no group is paired with itself
    own = studies.join(groups.filter("name <> 'all_studies'"), "study_id").groupBy("sample").agg(F.collect_set("name").alias("names"))
    meta = samples.filter("not qc_failed").select(F.col("sample").alias("other"), "public_name", "control", "donor").join(own.toDF("other", "other_names"), "other")
    found = _comparisons(results.join(asked.select("sample"), "sample", "left_semi"), "fluidigm").drop("key").join(own, "sample").join(meta, "other").filter(F.arrays_overlap("names", "other_names"))
    same = F.coalesce((F.col("discordance") < 3) & (F.col("sites") > 15), F.lit(False))
    order = F.struct((~same).alias("a"), (F.col("discordance") - F.col("sites")).alias("b"), (~F.col("control")).alias("c"), F.col("public_name").alias("d"), F.col("other").alias("e"))
    return found.select("sample", "other", "discordance", "sites", "avg_min_depth", "public_name", "control", "donor", order.alias("rank"))


def _samples(samples: DataFrame) -> DataFrame:
    return samples.filter("not qc_failed").select("sample", "donor", "control", F.concat_ws("_", "public_name", "sample").alias("name"))


def donor_cnv_report(samples: DataFrame, cnvs: DataFrame, loh: DataFrame, plots: DataFrame) -> DataFrame:
    """JON-22: rows of each donor by type: copy_number_plot, copy_number_summary (key, value), aberrant_regions and loh_calls (chrom, start,
    end, …), aberrant_polysomy (plots of chromosomes without an aberrant region).

    samples: sample, donor, public_name, control, qc_failed; cnvs: sample, date,
    data (JSON of values and RG, an array of regions); loh: sample, date, data
    (JSON array of calls); plots: donor, path, chrom, query_sample, control_sample, the last three null for
    the plot that all samples share. The latest result of a sample counts, and
    samples that failed QC are left out. Text that isn't such JSON gives no rows."""
    own = _samples(samples)
    last = lambda df: latest_first(df, ["sample"], F.desc("date"), F.desc("data")).join(own, "sample")
    c, calls = last(cnvs), last(loh)
    per_sample = plots.filter("chrom is not null and query_sample is not null")
    graph = per_sample.groupBy("donor", "chrom", F.col("query_sample").alias("name")).agg(F.max("path").alias("graph"))
    control = per_sample.groupBy("donor").agg(F.min("control_sample").alias("control_sample"))
    summary = c.select("donor", "name", F.explode(F.from_json("data", "map<string,string>")).alias("key", "value")).filter("key <> 'RG'")
    region = "struct<chr:string,start:long,end:long,length:long,quality:string,cn:string>"
    regions = c.select("donor", "name", F.explode(F.from_json("data", f"RG array<{region}>")["RG"]).alias("r")).select("donor", "name", F.col("r.chr").alias("chrom"), "r.start", "r.end", "r.quality", "r.cn").join(graph, ["donor", "chrom", "name"], "left")
    lost = calls.select("donor", "name", F.explode(F.from_json("data", "array<struct<chr:string,start:long,end:long,count:string>>")).alias("r")).select("donor", "name", F.col("r.chr").alias("chrom"), "r.start", "r.end", F.col("r.count").alias("value")).join(control, "donor", "left")
    polysomy = graph.join(regions.select("donor", "chrom").distinct(), ["donor", "chrom"], "left_anti").join(own.select("donor", "name").distinct(), ["donor", "name"], "left_semi")
    shared = plots.filter("chrom is null or query_sample is null").groupBy("donor").agg(F.max("path").alias("graph"))
    kinds = {"copy_number_plot": shared, "copy_number_summary": summary, "aberrant_regions": regions, "loh_calls": lost, "aberrant_polysomy": polysomy}
    rows = [df.withColumn("type", F.lit(kind)) for kind, df in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def snake_key(c: Column) -> Column:
    """JON-23: runs of blanks and hyphens as one underscore."""
    return F.regexp_replace(c, "[- ]+", "_")


#: Pluripotency plots in their order, and how large they are shown.
PLOTS = {"pluripotency": (1, "big"), "novelty": (2, "big"), "pluripotency_vs_novelty": (3, "small"), "clustering": (4, "small"), "intensity": (5, "small")}


def donor_pluritest_report(samples: DataFrame, results: DataFrame, plots: DataFrame) -> DataFrame:
    """JON-23: rows of each donor: pluritest_plot (path, order, display_size) of plots (donor, path, type, size) that aren't empty, and
    pluritest_summary (name, control, key, value) of the latest result (sample, date, data: JSON) of each sample that hasn't failed QC;
    runs of blanks and hyphens in keys become one underscore. A donor has rows only if it has a summary and a plot."""
    latest = latest_first(results, ["sample"], F.desc("date"), F.desc("data")).join(_samples(samples), "sample")
    summary = latest.select("donor", "name", "control", F.explode(F.from_json("data", "map<string,string>")).alias("key", "value")).withColumn("key", snake_key(F.col("key")))
    pick = lambda i: F.coalesce(*(F.when(F.col("type") == t, F.lit(v[i])) for t, v in PLOTS.items()))
    shown = plots.filter("size > 0").select("donor", "path", pick(0).alias("order"), pick(1).alias("display_size"))
    both = summary.select("donor").distinct().join(plots.select("donor").distinct(), "donor", "left_semi")
    parts = shown.withColumn("type", F.lit("pluritest_plot")).unionByName(summary.withColumn("type", F.lit("pluritest_summary")), allowMissingColumns=True)
    return parts.join(both, "donor", "left_semi")


def sample_status(samples: DataFrame, events: DataFrame) -> DataFrame:
    """JON-24: status of each sample (sample, public_name, qc_failed, qc_selected) with who set it, on which day and why: failed wins over
    selected over pending. events: sample, type (failed_by, selected_by), username, time (epoch seconds), reason; the latest of a type counts."""
    of = lambda kind, p: latest_first(events.filter(F.col("type") == kind), ["sample"], F.desc("time"), "username").select("sample", F.col("username").alias(f"{p}_by"), F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd").alias(f"{p}_day"), F.col("reason").alias(f"{p}_reason"))
    j = samples.join(of("failed_by", "f"), "sample", "left").join(of("selected_by", "s"), "sample", "left")
    failed = F.coalesce("qc_failed", F.lit(False))
    status = F.when(failed, "failed").when(F.col("qc_selected"), "selected").otherwise("pending")
    return j.select("sample", "public_name", status.alias("status"), F.when(failed, F.col("f_by")).otherwise(F.col("s_by")).alias("qc_by"), F.when(failed, F.col("f_day")).otherwise(F.col("s_day")).alias("qc_day"), F.col("f_reason").alias("reason"))


def check_release_metadata(files: DataFrame, read_groups: DataFrame, index: DataFrame) -> DataFrame:
    """JON-26: file_id and the sorted, distinct checks that fail between each file's metadata, its header's read groups and the sequence index.

    files: file_id, sample, platform, analysis_group, population, reads,
    records; read_groups: file_id, id, SM, CN, PL, LB, DS; index as read. Of the
    index the lanes of the file's sample, platform and group that aren't
    withdrawn are expected: lane_count, and unexpected_lane for read groups that
    aren't there. Each read group's lane then has seven checks: sample and
    platform three ways, centre (upper case), library and study between header
    and index, population and group between metadata and index. reads: what is
    expected against the records counted."""
    lanes = index.filter("withdrawn = 0").select("run_id", F.col("sample_name").alias("sample"), F.col("instrument_platform").alias("platform"), "analysis_group").distinct()
    expected = files.select("file_id", "sample", "platform", "analysis_group").join(lanes, ["sample", "platform", "analysis_group"]).select("file_id", F.col("run_id").alias("id")).withColumn("_expected", F.lit(True))
    # one row a lane of the index, as its most frequent value would be looked up
    names = {"sample": "sample_name", "center": "center_name", "platform": "instrument_platform", "library": "library_name", "study": "study_id", "population": "population", "group": "analysis_group"}
    of = index.groupBy(F.col("run_id").alias("id")).agg(*(F.mode(c, True).alias(f"i_{n}") for n, c in names.items()))
    f = files.select("file_id", *(F.col(c).alias(f"m_{c}") for c in ("sample", "platform", "population", "analysis_group")))
    rg = read_groups.join(expected, ["file_id", "id"], "left").join(of, "id", "left").join(f, "file_id")
    same = lambda *cs: reduce(lambda a, b: a & b, (F.col(cs[0]).eqNullSafe(F.col(c)) for c in cs[1:]))
    checks = {
        "unexpected_lane": F.col("_expected").isNotNull(), "sample": same("m_sample", "SM", "i_sample"), "center_name": F.col("CN").eqNullSafe(F.upper("i_center")), "platform": same("m_platform", "PL", "i_platform"), "library": same("LB", "i_library"),
        "study": same("DS", "i_study"), "population": same("m_population", "i_population"), "analysis_group": same("m_analysis_group", "i_group"),
    }
    failed = rg.select("file_id", F.explode(F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in checks.items())))).alias("check"))
    n_header, n_index = read_groups.groupBy("file_id").agg(F.countDistinct("id").alias("h")), expected.groupBy("file_id").agg(F.count("*").alias("x"))
    counts = files.select("file_id").join(n_header, "file_id", "left").join(n_index, "file_id", "left").filter(F.coalesce("h", F.lit(0)) != F.coalesce("x", F.lit(0))).select("file_id", F.lit("lane_count").alias("check"))
    reads = files.filter(~F.col("reads").eqNullSafe(F.col("records"))).select("file_id", F.lit("reads").alias("check"))
    all_failed = failed.unionByName(counts).unionByName(reads).groupBy("file_id").agg(F.array_sort(F.collect_set("check")).alias("failed"))
    return files.select("file_id").join(all_failed, "file_id", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))


def header_mistakes(read_groups: DataFrame, expected: DataFrame) -> DataFrame:
    """JON-28: of each file the number of header fields that don't hold what is expected, with the first [actual, expected] of each.

    read_groups: file_id, line_no, LB, SM, DS; expected: file_id, library_id,
    library_name, sample, study. LB may be either of two values; DS counts from
    'Study ' to a colon, and a line without that isn't looked at; a field that
    any read group has right is right; fields absent on either side don't count."""
    study = F.nullif(F.regexp_extract("DS", r"^Study ([^:]+)", 1), F.lit(""))
    j = read_groups.join(expected, "file_id")
    one = lambda field, actual, *wanted: [F.struct(F.lit(field).alias("field"), actual.alias("actual"), F.col(w).cast("string").alias("expected"), F.lit(k).alias("k")) for k, w in enumerate(wanted)]
    tests = one("LB", F.col("LB"), "library_id", "library_name") + one("SM", F.col("SM"), "sample") + one("DS", study, "study")
    t = j.select("file_id", "line_no", F.explode(F.array(*tests)).alias("t")).select("file_id", "line_no", "t.*").filter("actual is not null and expected is not null")
    wrong = t.groupBy("file_id", "field").agg(F.bool_or(F.col("actual") == F.col("expected")).alias("ok"), F.min_by(F.array("actual", "expected"), F.struct("line_no", "k")).alias("diff")).filter("not ok")
    diff = lambda f: F.max(F.when(F.col("field") == f, F.col("diff"))).alias(f.lower())
    per = wrong.groupBy("file_id").agg(F.count("*").alias("mistakes"), diff("LB"), diff("SM"), diff("DS"))
    return expected.select("file_id").join(per, "file_id", "left").withColumn("mistakes", F.coalesce("mistakes", F.lit(0)))


def file_report(files: DataFrame, outputs: DataFrame, inputs: DataFrame, elements: DataFrame, resolved: DataFrame, eav: DataFrame, keys: list[str]) -> DataFrame:
    """JON-37: of each file its maker 'setup[step:key]', element, that element's input paths, size, lines, md5 and chosen keys.

    files: file_id, path, parent, size, lines, md5; outputs: file_id, setup,
    step, output_key, element; inputs: file_id, element; elements: element,
    path; resolved: file_id, current (GRF-2). A file that nothing made by its own
    id is looked up by what its parent (or itself) resolves to; one that nothing made has the element that
    it is an input of. Several outputs of one file count by the smallest setup and step. Missing values are 'unknown', an
    element without paths has 'n/a'; several values of a key are comma-joined."""
    made = outputs.groupBy("file_id").agg(F.min(F.struct("setup", "step", "output_key", "element")).alias("m"))
    fed = inputs.groupBy("file_id").agg(F.min("element").alias("e"))
    target = resolved.select(F.col("file_id").alias("_f"), F.col("current").alias("_to"))
    f = files.withColumn("_f", F.coalesce("parent", "file_id")).join(target, "_f", "left").withColumn("_to", F.coalesce("_to", "_f"))
    by = lambda df, key, a, b: df.select(F.col("file_id").alias(key), F.col(a).alias(b))
    f = f.join(made, "file_id", "left").join(by(made, "_to", "m", "m2"), "_to", "left").join(fed, "file_id", "left").join(by(fed, "_to", "e", "e2"), "_to", "left")
    m = F.coalesce("m", "m2")
    f = f.withColumn("maker", F.concat(m["setup"].cast("string"), F.lit("["), m["step"].cast("string"), F.coalesce(F.concat(F.lit(":"), m["output_key"]), F.lit("")), F.lit("]"))).withColumn("element", F.coalesce(m["element"], "e", "e2"))
    paths = elements.groupBy("element").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("inputs"))
    wide = eav.filter(F.col("key").isin(keys)).groupBy("file_id").pivot("key", keys).agg(F.array_join(F.array_sort(F.collect_set("val")), ","))
    out = f.join(paths, "element", "left").join(wide, "file_id", "left")
    text = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(c)
    given = F.when(F.col("element").isNull(), "unknown").otherwise(F.coalesce("inputs", F.lit("n/a")))
    return out.select("file_id", "path", text("maker"), text("element"), given.alias("inputs"), text("size"), text("lines"), text("md5"), *(text(k) for k in keys))


def element_report(elements: DataFrame, submissions: DataFrame, steps: DataFrame, permanent_at: int = 3) -> DataFrame:
    """JON-38: of each element of a setup the last completed step's name, the current one's, and the submissions of that: permanent and
    temporary failures, done, running and scheduled; status is complete, STALLED with a permanent failure, else working.

    elements: setup, element, completed; submissions: setup, element, step,
    failed, done, alive, retries; steps: setup, step (from 1), name."""
    total = steps.groupBy("setup").agg(F.max("step").alias("_steps"))
    name = lambda at, n: steps.select("setup", F.col("step").alias(at), F.col("name").alias(n))
    failed, done = F.col("failed") == 1, F.col("done") == 1
    counts = submissions.groupBy("setup", "element", F.col("step").alias("_now")).agg(
        F.count_if(failed & (F.col("retries") >= permanent_at)).alias("permanent"), F.count_if(failed & (F.col("retries") < permanent_at)).alias("temporary"), F.count_if(~failed & done).alias("done"),
        F.count_if(~failed & ~done & F.col("alive")).alias("running"), F.count_if(~failed & ~done & ~F.col("alive")).alias("scheduled"),
    )
    e = elements.withColumn("_now", F.col("completed") + 1).join(total, "setup", "left").join(name("completed", "last_step"), ["setup", "completed"], "left").join(name("_now", "current_step"), ["setup", "_now"], "left")
    j = e.join(counts, ["setup", "element", "_now"], "left")
    numbers = ("permanent", "temporary", "done", "running", "scheduled")
    status = F.when(F.col("completed") >= F.col("_steps"), "complete").when(F.col("permanent") > 0, "STALLED").otherwise("working")
    return j.select("setup", "element", F.coalesce("last_step", F.lit("no_steps_complete")).alias("last_step"), "current_step", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), status.alias("status"))
