"""Aggregations over reads, statistics, metadata, usage and facts (AGG-1 to AGG-41 apart from intervals and QC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import stored
from .intervals import bin_width, bins
from .ordering import group_medians, number_within


def _bit(n: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(n)) != 0


def half(total: Column) -> Column:
    """total / 2 rounded half to even."""
    return F.bround(total / 2, 0)


def histogram_median(bins: DataFrame, key: str, value: str = "value", n: str = "n") -> DataFrame:
    """AGG-2: per key the first value at which the cumulative count reaches half of all, half rounded to even."""
    w = Window.partitionBy(key).orderBy(value)
    cum = bins.withColumn("_cum", F.sum(n).over(w)).withColumn("_all", F.sum(n).over(Window.partitionBy(key)))
    return cum.filter(F.col("_cum") >= half(F.col("_all"))).groupBy(key).agg(F.min(value).alias("median"))


def histogram_quartiles(bins: DataFrame, key: str, value: str = "value", n: str = "n") -> DataFrame:
    """AGG-2: q1, q2 and q3: the first value with cumulative count of q x total or more."""
    cum = bins.withColumn("_cum", F.sum(n).over(Window.partitionBy(key).orderBy(value))).withColumn("_all", F.sum(n).over(Window.partitionBy(key)))
    return cum.groupBy(key).agg(*(F.min(F.when(F.col("_cum") >= q * F.col("_all"), F.col(value))).alias(a) for a, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))


def histogram_mean_sd(bins: DataFrame, key: str, value: str = "value", n: str = "n") -> DataFrame:
    """AGG-2: mean and population standard deviation."""
    g = bins.groupBy(key).agg(F.sum(n).alias("_n"), F.sum(F.col(value) * F.col(n)).alias("_s"), F.sum(F.col(value) * F.col(value) * F.col(n)).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    return g.select(key, mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("sd"))


def histogram_mad(bins: DataFrame, key: str, value: str = "value", n: str = "n") -> DataFrame:
    """AGG-2: median and median absolute deviation, from a histogram of the deviations."""
    med = histogram_median(bins, key, value, n)
    dev = bins.join(med, key).groupBy(key, F.abs(F.col(value) - F.col("median")).alias(value)).agg(F.sum(n).alias(n))
    return med.join(histogram_median(dev, key, value, n).withColumnRenamed("median", "mad"), key)


def read_group_stats(reads: DataFrame) -> DataFrame:
    """AGG-1: fourteen statistics a read group: one grouped pass, and one over the insert-size histogram for median and MAD.

    Mapped counts need a mapped read; duplicates count mapped or not; insert
    statistics take proper pairs of mapping quality above 0 and positive insert
    size; the deviation is that of the population."""
    mapped, dup = ~_bit(4), _bit(1024)
    proper = mapped & _bit(2)
    ins = proper & (F.col("mapq") > 0) & (F.col("isize") > 0)
    has_nm = mapped & F.col("nm").isNotNull()
    when = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    main = reads.groupBy("rg").agg(
        F.sum("len").alias("total_bases"), when(mapped, "len").alias("mapped_bases"), F.count("*").alias("total_reads"), F.count_if(mapped).alias("mapped_reads"),
        F.count_if(mapped & _bit(1)).alias("mapped_paired"), F.count_if(proper).alias("proper_pairs"),
        F.round(100 * when(has_nm, "nm") / when(has_nm, "len"), 2).alias("pct_mismatch"), F.round(when(mapped, "sum_qual") / when(mapped, "n_qual"), 2).alias("avg_qual"),
        F.count_if(dup).alias("duplicate_reads"), when(dup, "len").alias("duplicate_bases"),
    )
    hist = reads.filter(ins).groupBy("rg", F.col("isize").alias("value")).agg(F.count("*").alias("n"))
    inserts = histogram_mean_sd(hist, "rg").select("rg", F.round("mean", 0).alias("mean_insert"), F.when(F.round("mean", 0) == 0, 0.0).otherwise(F.round("sd", 2)).alias("insert_sd"))
    mad = histogram_mad(hist, "rg").select("rg", F.col("median").alias("median_insert"), F.col("mad").alias("insert_mad"))
    return main.join(inserts, "rg", "left").join(mad, "rg", "left")


def bas_totals(bas: DataFrame) -> DataFrame:
    """AGG-3"""
    sums = ["total_reads", "mapped_reads", "total_bases", "mapped_bases", "duplicate_reads", "duplicate_bases"]
    return bas.agg(*(F.sum(c).alias(c) for c in sums)).withColumn("percent_mapped", F.round(100 * F.col("mapped_reads") / F.col("total_reads"), 2))


def mean_coverage(cov: DataFrame, key: str = "lane") -> DataFrame:
    """AGG-4: mean over coverage 1 to 1000, two places; 0 without data."""
    ok = F.col("cov").between(1, 1000)
    mean = F.sum(F.when(ok, F.col("n") * F.col("cov"))) / F.sum(F.when(ok, F.col("n")))
    return cov.groupBy(key).agg(F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("mean_coverage"))


def cumulative_coverage(cov: DataFrame, depths: tuple[int, ...] = (1, 2, 5, 10, 20, 50, 100), key: str = "lane") -> DataFrame:
    """AGG-4: bases of at least each depth; the bin above 1000 counts."""
    return cov.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("cov") >= d, F.col("n"))), F.lit(0)).alias(f"cov_{d}") for d in depths))


def _cigar_sum(ops: str) -> Column:
    return F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def alignment_summary(reads: DataFrame, key: str = "rg") -> DataFrame:
    """AGG-5: scalars of each lane computed from reads; but for their own count, secondary ones are left out."""
    own, mapped, dup = ~_bit(256), ~_bit(4) & ~_bit(256), _bit(1024) & ~_bit(256)
    count = lambda c, n: F.count_if(own & c).alias(n)
    total = lambda c, x, n: F.coalesce(F.sum(F.when(own & c, x)), F.lit(0)).alias(n)
    cigar, yes = _cigar_sum("MI"), F.lit(True)
    pair = mapped & _bit(1) & ~_bit(8)
    return reads.groupBy(key).agg(
        count(yes, "raw_reads"), count(_bit(64), "first_fragments"), count(_bit(128), "last_fragments"), count(mapped, "reads_mapped"), count(~mapped, "reads_unmapped"), count(_bit(1), "reads_paired"), count(~_bit(1), "reads_unpaired"),
        count(pair, "reads_mapped_and_paired"), count(pair & _bit(2), "reads_properly_paired"), count(dup, "reads_duplicated"), count(mapped & (F.col("mapq") == 0), "reads_mq0"), count(_bit(512), "reads_qc_failed"), F.count_if(_bit(256)).alias("non_primary_alignments"),
        count(pair & _bit(64) & (F.col("mrnm") != F.col("rname")), "pairs_on_different_chromosomes"), total(yes, F.col("len"), "total_length"), total(mapped, F.col("len"), "bases_mapped"), total(mapped, cigar, "bases_mapped_cigar"),
        total(dup, F.col("len"), "bases_duplicated"), total(mapped, F.col("nm"), "mismatches"), F.round(F.sum(F.when(mapped, F.col("nm"))) / F.nullif(F.sum(F.when(mapped, cigar)), F.lit(0)), 6).alias("error_rate"),
        F.round(F.avg(F.when(own, F.col("len"))), 0).alias("average_length"), F.max(F.when(own, F.col("len"))).alias("maximum_length"), F.round(F.sum(F.when(own, F.col("sum_qual"))) / F.nullif(F.sum(F.when(own, F.col("n_qual"))), F.lit(0)), 1).alias("average_quality"),
    )


def indel_cycle_section(reads: DataFrame, key: str = "rg") -> DataFrame:
    """AGG-5: IC rows: insertions and deletions of first and last fragments by the cycle before which they lie, counted along the read as
    sequenced, so from the end of a reversed one."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    size = lambda o: F.regexp_extract(o, r"^(\d+)", 1).cast("long")
    uses = lambda o: F.when(o.rlike("[MIS=X]$"), size(o)).otherwise(0)
    # bases of the read before each operation, from a running sum over the operations before it
    placed = F.transform(ops, lambda o, i: F.struct(o.alias("o"), F.aggregate(F.slice(ops, 1, i), F.lit(0).cast("long"), lambda a, x: a + uses(x)).alias("at")))
    o = reads.filter(~_bit(4) & ~_bit(256)).select(key, "flag", "len", F.explode(F.filter(placed, lambda x: x["o"].rlike("[ID]$"))).alias("p"))
    length = F.when(F.col("p.o").endswith("I"), size(F.col("p.o"))).otherwise(0)
    cycle = F.when(_bit(16), F.col("len") - F.col("p.at") - length).otherwise(F.col("p.at"))
    ins, first = F.col("p.o").endswith("I"), ~_bit(128)
    kinds = ((ins & first, "ins_first"), (ins & ~first, "ins_last"), (~ins & first, "del_first"), (~ins & ~first, "del_last"))
    return o.withColumn("cycle", cycle).groupBy(key, "cycle").agg(*(F.count_if(c).alias(n) for c, n in kinds))


def gc_section(reads: DataFrame, key: str = "rg", column: str = "seq") -> DataFrame:
    """AGG-5: GCF and GCL rows: reads of first and last fragments by the percentage of G and C in them, a whole number."""
    gc = F.length(column) - F.length(F.translate(column, "GCgc", ""))
    r = reads.filter(~_bit(256) & (F.length(column) > 0)).withColumn("gc", F.floor(100 * gc / F.length(column)))
    return r.groupBy(key, "gc").agg(F.count_if(~_bit(128)).alias("first"), F.count_if(_bit(128)).alias("last"))


def base_content_section(reads: DataFrame, key: str = "rg", column: str = "seq") -> DataFrame:
    """AGG-5: GCC rows: counts of A, C, G, T and other bases by cycle, pre-aggregated by numpy in each Arrow batch before the shuffle."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        kind = np.full(256, 4, np.int64)
        for i, letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
            kind[[ord(x) for x in letters]] = i
        for batch in batches:
            out = []
            groups: dict = {}
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s:
                    groups.setdefault(k, []).append(s.encode("latin-1", "replace"))
            for k, seqs in groups.items():
                lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
                cycles = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                v, c = np.unique(cycles * 5 + kind[np.frombuffer(b"".join(seqs), np.uint8)], return_counts=True)
                out.append(pa.table({"key": [k] * len(v), "cycle": v // 5 + 1, "base": v % 5, "n": c}))
            yield from (pa.concat_tables(out).to_batches() if out else [])

    rows = reads.select(F.col(key).cast("string").alias("key"), column).mapInArrow(run, "key string, cycle long, base long, n long")
    return rows.groupBy("key", "cycle").agg(*(F.coalesce(F.sum(F.when(F.col("base") == i, F.col("n"))), F.lit(0)).alias(b) for i, b in enumerate(("a", "c", "g", "t", "other"))))


def insert_size_section(reads: DataFrame, key: str = "rg") -> DataFrame:
    """AGG-5: IS rows: pairs by insert size, each counted at its first read."""
    return reads.filter(_bit(64) & ~_bit(4) & ~_bit(8)).groupBy(key, F.abs("isize").alias("insert_size")).agg(F.count("*").alias("pairs"), F.count_if(_bit(2)).alias("inward"))


def indel_section(reads: DataFrame, key: str = "rg") -> DataFrame:
    """AGG-5: ID rows: insertions and deletions by length, from the CIGAR."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[ID])"), F.lit(1))
    o = reads.filter(~_bit(4)).select(key, F.explode(ops).alias("o")).select(key, F.regexp_extract("o", r"^(\d+)", 1).cast("long").alias("length"), F.col("o").endswith("I").alias("ins"))
    return o.groupBy(key, "length").agg(F.count_if("ins").alias("insertions"), F.count_if(~F.col("ins")).alias("deletions"))


def read_length_section(reads: DataFrame, key: str = "rg") -> DataFrame:
    """AGG-5: RL rows."""
    return reads.groupBy(key, F.col("len").alias("length")).agg(F.count("*").alias("n"))


def cycle_qualities(fastq: DataFrame, key: str = "file") -> DataFrame:
    """AGG-5/HLP-3: counts of (key, cycle, quality), pre-aggregated by numpy in each Arrow batch before the shuffle; qualities of any length."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            groups: dict = {}
            for k, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if q:
                    groups.setdefault(k, []).append(q.encode("latin-1", "replace"))
            out = []
            for k, quals in groups.items():
                lengths = np.fromiter(map(len, quals), np.int64, len(quals))
                cycles = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                v, c = np.unique(cycles * 256 + np.frombuffer(b"".join(quals), np.uint8), return_counts=True)
                out.append(pa.table({"key": [k] * len(v), "cycle": v // 256 + 1, "quality": v % 256 - 33, "n": c}))
            yield from (pa.concat_tables(out).to_batches() if out else [])

    rows = fastq.select(F.col(key).cast("string").alias("key"), "qual").mapInArrow(run, "key string, cycle long, quality long, n long")
    return rows.groupBy("key", "cycle", "quality").agg(F.sum("n").alias("n"))


def with_quality_sums(reads: DataFrame, column: str = "qual") -> DataFrame:
    """HLP-3: reads with sum_qual and n_qual of their quality text ('*' or null has none), by numpy over each Arrow batch; what AGG-1 takes."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            quals = [b"" if q is None or q == "*" else q.encode("latin-1", "replace") for q in batch.column(column).to_pylist()]
            lengths = np.fromiter(map(len, quals), np.int64, len(quals))
            sums = np.r_[0, np.cumsum(np.frombuffer(b"".join(quals), np.uint8).astype(np.int64) - 33)]
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[ends] - sums[ends - lengths]), pa.array(lengths)], [*batch.schema.names, "sum_qual", "n_qual"])

    kept = reads.select(*(c for c in reads.columns if c not in ("sum_qual", "n_qual")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, sum_qual long, n_qual long")


def avg_base_quals(rows: DataFrame) -> DataFrame:
    """AGG-6: average quality of each cycle from counts (cycle, quals array of counts by quality); 0 without data."""
    e = rows.select("cycle", F.posexplode("quals").alias("q", "n"))
    return e.groupBy("cycle").agg(F.round(F.coalesce(F.sum(F.col("q") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), 2).alias("avg_qual"))


def sequence_stats(reads: DataFrame, key: str) -> DataFrame:
    """AGG-7"""
    return reads.groupBy(key).agg(F.count("*").alias("reads"), F.sum("len").alias("bases"), F.round(F.sum("len") / F.count("*"), 2).alias("avg_length"), F.max("len").alias("max_length"))


def group_by_metadata(eav: DataFrame, keys: list[str], missing: str = "skip") -> DataFrame:
    """AGG-8: group (values of the keys joined by '|') and its sorted files. A missing key is skipped in the name, or, with 'error', an error.

    Several values of a key are sorted and comma-joined."""
    wide = eav.filter(F.col("key").isin(keys)).groupBy("file_id", "path").pivot("key", keys).agg(F.array_join(F.array_sort(F.collect_set("val")), ","))
    cols = [F.nullif(F.col(k), F.lit("")) for k in keys]
    if missing == "error":
        cols = [F.coalesce(c, F.raise_error(F.lit(f"missing {k}")).cast("string")) for c, k in zip(cols, keys, strict=True)]
    named = wide.withColumn("group", F.concat_ws("|", *cols))
    return named.groupBy("group").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def group_column(df: DataFrame, column: str, by: str) -> DataFrame:
    """AGG-9/10"""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(column)).alias("items"))


def common_metadata(eav: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG-11: keys that every file of a group has with one and the same value."""
    sizes = groups.groupBy("group").agg(F.countDistinct("file_id").alias("_n"))
    per = eav.groupBy("file_id", "key").agg(F.array_join(F.array_sort(F.collect_set("val")), ",").alias("val"))
    g = per.join(groups, "file_id").groupBy("group", "key").agg(F.min("val").alias("val"), F.max("val").alias("_x"), F.countDistinct("file_id").alias("_c"))
    return g.join(sizes, "group").filter("_c = _n and val = _x").select("group", "key", "val")


def combined_metadata(eav: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG-12: all distinct values of each key in a group, sorted."""
    return eav.join(groups, "file_id").groupBy("group", "key").agg(F.array_sort(F.collect_set("val")).alias("vals"))


def group_lanes(lanes: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """AGG-13: groups of lanes with their files, without groups in which some lane has none."""
    n = files.groupBy("lane").agg(F.count("*").alias("_n"))
    g = lanes.join(n, "lane", "left").groupBy(key).agg(F.bool_and(F.coalesce(F.col("_n") > 0, F.lit(False))).alias("_ok"), F.countDistinct("lane").alias("lanes"), F.coalesce(F.sum("_n"), F.lit(0)).alias("files"))
    return g.filter("_ok").drop("_ok")


def derive_dedup_stats(stats: DataFrame, rmdup: bool = False) -> DataFrame:
    """AGG-14: reads and bases after duplicates, with mapped bases estimated as cigar - int(cigar x duplicates / mapped)."""
    out = stats.withColumn("reads_after", F.col("reads_mapped") - F.col("reads_duplicated")).withColumn("bases_after", F.col("total_length") - F.col("bases_duplicated"))
    if rmdup:
        return out
    return out.withColumn("bases_mapped_after", F.col("bases_mapped_cigar") - F.expr("cast(bases_mapped_cigar * reads_duplicated / reads_mapped as bigint)"))


def consensus(rows: DataFrame, key: str, attribute: str, default: Column | None = None) -> DataFrame:
    """AGG-20: the one value of the rows that have it, else the default (null)."""
    one = F.when(F.min(attribute) == F.max(attribute), F.min(attribute))
    return rows.groupBy(key).agg((F.coalesce(one, default) if default is not None else one).alias(attribute))


#: Header attributes of a read group and the file metadata that they give.
RG_METADATA = {"pu": "lane", "lb": "library", "sm": "sample", "cn": "center_name", "pl": "platform", "ds": "study"}


def consensus_rg_metadata(read_groups: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-15: lane, library, sample, center_name, platform and study of each file from its read groups (file_id, id, pu, lb, sm, cn, pl, ds).

    What files (file_id, md5 and those names) have already wins; else a value
    that all read groups which have one share. The lane of a file with one read group
    is its unit or id; with several, or where it comes out as 1, the file's md5."""
    value = lambda c: F.nullif(F.col(c), F.lit(""))
    one = lambda c: F.when(F.min(value(c)) == F.max(value(c)), F.min(value(c)))
    g = read_groups.groupBy("file_id").agg(F.count("*").alias("_n"), F.min("id").alias("_id"), *(one(c).alias(f"_{n}") for c, n in RG_METADATA.items()))
    j = files.join(g, "file_id")
    lane = F.coalesce("lane", F.when(F.col("_n") == 1, F.coalesce("_lane", "_id")).otherwise(F.col("_lane")))
    lane = F.when((F.col("_n") != 1) | (lane == "1"), F.col("md5")).otherwise(lane)
    return j.select("file_id", lane.alias("lane"), *(F.coalesce(n, f"_{n}").alias(n) for n in RG_METADATA.values() if n != "lane"))


def lane_merge_metadata(parts: DataFrame, merge_layouts: bool = False) -> DataFrame:
    """AGG-16: reads and bases by lane and layout; merged, layouts 0 and 1 together are layout 2."""
    if not merge_layouts:
        return parts.groupBy("lane", "layout").agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"))
    layout = F.when(F.min("layout") != F.max("layout"), 2).otherwise(F.min("layout"))
    return parts.groupBy("lane").agg(layout.alias("layout"), F.sum("reads").alias("reads"), F.sum("bases").alias("bases"))


def max_deviation(rows: DataFrame, key: str) -> DataFrame:
    """AGG-17: the sample of highest discordance; the later row wins a tie."""
    return rows.groupBy(key).agg(F.max_by(F.struct("sample", "discordance"), F.struct("discordance", "row_no")).alias("r")).select(key, "r.*")


def unpivot_cnv_summary(wide: DataFrame, samples: list[str]) -> DataFrame:
    """AGG-19: kind and sample columns as (kind, sample, value) rows."""
    return wide.unpivot(["kind"], samples, "sample", "value")


def cnv_summary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-19: the rows (file, row_no, cells) of a copy number summary as two tables: file, sample, kind, value of the scalars, and file,
    sample, chrom, start, end, length, quality, cn of the regions.

    The first cell is the row's kind. SM rows name the samples of the columns
    that follow; in RG rows the values begin at the eighth column, in the same order."""
    names = rows.filter(F.col("cells")[0] == "SM").select("file", "row_no", F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("column_no", "sample"))
    names = names.groupBy("file", "column_no").agg(F.min_by("sample", "row_no").alias("sample"))
    other = rows.filter(~F.col("cells")[0].isin("SM", "RG") & ~F.col("cells")[0].startswith("#"))
    values = other.select("file", F.col("cells")[0].alias("kind"), F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("column_no", "value"))
    scalars = values.join(names, ["file", "column_no"]).select("file", "sample", "kind", "value")
    rg = rows.filter(F.col("cells")[0] == "RG")
    fixed = [F.get("cells", i).cast(t).alias(n) for i, (n, t) in enumerate((("chrom", "string"), ("start", "long"), ("end", "long"), ("length", "long"), ("quality", "double")), 1)]
    cells = rg.select("file", *fixed, F.posexplode(F.slice("cells", 8, F.size("cells"))).alias("column_no", "cn"))
    regions = cells.join(names, ["file", "column_no"]).select("file", "sample", "chrom", "start", "end", "length", "quality", "cn")
    return scalars, regions


def infer_gender(calls: DataFrame) -> DataFrame:
    """AGG-20: M if a marker's genotype has two letters, F otherwise (an empty one too); unanimous or U."""
    g = calls.withColumn("g", F.when(F.length(F.coalesce("genotype", F.lit(""))) == 2, "M").otherwise("F"))
    return consensus(g, "sample", "g", F.lit("U")).withColumnRenamed("g", "gender")


def aberrant_chromosomes(cn: DataFrame, gender: DataFrame) -> DataFrame:
    """AGG-21: chromosomes whose copy number (text) isn't N.0… of the expected: 1 on a male X, else 2; unknown gender counts as 2."""
    expected = F.when((F.col("gender") == "M") & F.col("chrom").isin("X", "chrX"), 1).otherwise(2)
    j = cn.join(gender, "sample", "left")
    return j.filter(~F.col("cn").rlike(r"^\d+\.0+$") | (F.regexp_extract("cn", r"^(\d+)", 1).cast("int") != expected)).groupBy("sample").agg(F.array_sort(F.collect_list(F.concat_ws(":", "chrom", "cn"))).alias("aberrant"))


def substitution_rate(variants: DataFrame, sequences: DataFrame) -> DataFrame:
    """AGG-22: calls a base of reference, three places."""
    return variants.agg(F.count("*").alias("calls")).crossJoin(sequences.agg(F.sum("ln").alias("total"))).select(F.round(F.col("calls") / F.col("total"), 3).alias("rate"))


def file_substitution_rates(variants: DataFrame, sequences: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG-22: path and rate of each file (variants: file, …) and of the files that it was made from (sources: file, and source, comma-separated
    paths); of several files made from one source the greatest path's rate counts."""
    total = sequences.agg(F.sum("ln").alias("total"))
    rates = variants.groupBy("file").agg(F.count("*").alias("calls")).crossJoin(total).select("file", F.round(F.col("calls") / F.col("total"), 3).alias("rate"))
    made = rates.join(sources.select("file", F.explode(F.split("source", ",")).alias("path")).filter("path <> ''"), "file")
    both = rates.select(F.col("file").alias("path"), "rate", "file").unionByName(made.select("path", "rate", "file"))
    return both.groupBy("path").agg(F.max_by("rate", "file").alias("rate"))


def disk_of(path: Column, parts: int = 2) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, parts), "/"))


def disk_usage(outputs: DataFrame, resolved: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """AGG-23: bytes by disk and setup, of all and of withdrawn files, and a map of them by step.

    outputs: file_id, setup, step, path, size, withdrawn. Each file counts once,
    for the smallest setup and step that made it. With resolved (file_id, current, of GRF-2) and
    files (file_id, path, size), where it is now and how large it is there counts;
    a file that leads into a cycle or away from all known files, or is empty, doesn't."""
    once = outputs.groupBy("file_id").agg(F.min(F.struct("setup", "step", "path", "size", "withdrawn")).alias("o")).select("file_id", "o.*")
    if resolved is not None:
        now = files.select(F.col("file_id").alias("current"), F.col("path").alias("_p"), F.col("size").alias("_s"))
        once = once.drop("path", "size").join(resolved, "file_id").join(now, "current").withColumnRenamed("_p", "path").withColumnRenamed("_s", "size")
    per = once.filter("size > 0").groupBy(disk_of(F.col("path")).alias("disk"), "setup", "step").agg(F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.col("withdrawn"), F.col("size"))), F.lit(0)).alias("withdrawn_bytes"))
    steps = F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "bytes"))))
    return per.groupBy("disk", "setup").agg(F.sum("bytes").alias("bytes"), F.sum("withdrawn_bytes").alias("withdrawn_bytes"), steps.alias("by_step"))


def step_stats(facts: DataFrame) -> DataFrame:
    """AGG-24: count, mean and population deviation (whole numbers), maximum and total of time, overall, by step and by setup, in one pass."""
    g = facts.groupingSets([[], ["step"], ["setup"]], "step", "setup")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("time_s"), 0).alias("mean"), F.round(F.stddev_pop("time_s"), 0).alias("sd"), F.max("time_s").alias("most"), F.sum("time_s").alias("total"))


def step_percentile(facts: DataFrame, p: int, value: str = "time_s", key: str = "step") -> DataFrame:
    """AGG-25: the value at place round(n / 100 x (100 - p)) + 1 from the top, not interpolated; from the histogram of values, so no step is one task."""
    hist = facts.groupBy(key, value).agg(F.count("*").alias("n"))
    total = hist.groupBy(key).agg(F.sum("n").alias("all"))
    cum = hist.withColumn("cum", F.sum("n").over(Window.partitionBy(key).orderBy(F.desc(value))))
    place = F.round(F.col("all") / 100 * (100 - p), 0) + 1
    return cum.join(total, key).filter(F.col("cum") >= F.least(place, F.col("all"))).groupBy(key).agg(F.max(value).alias("value"))


def recommend(facts: DataFrame) -> DataFrame:
    """AGG-25: memory for each step: its 95th percentile rounded up to hundreds, 100 at least; none below three facts."""
    n = facts.groupBy("step").agg(F.count("*").alias("n")).filter("n >= 3")
    return step_percentile(facts, 95, "memory").join(n, "step").select("step", F.greatest(F.lit(100), F.ceil(F.col("value") / 100) * 100).cast("long").alias("memory"))


def failure_summary(states: DataFrame) -> DataFrame:
    """AGG-26"""
    return states.filter("failed = 1").groupBy("setup", "step").agg(F.count("*").alias("failures"))


def clamped_percent(part: Column, whole: Column) -> Column:
    """AGG-27: percent, two places, never 100 unless all and never 0 unless none."""
    p = F.round(100 * part / whole, 2)
    return F.when(part == whole, 100.0).when(part == 0, 0.0).otherwise(F.least(F.greatest(p, F.lit(0.01)), F.lit(99.99)))


def setup_progress(states: DataFrame, steps: int) -> DataFrame:
    """AGG-27: elements of each setup, complete ones and percent."""
    per = states.groupBy("setup", "element").agg((F.countDistinct(F.when(F.col("done") == 1, F.col("step"))) >= steps).alias("c"))
    g = per.groupBy("setup").agg(F.count("*").alias("elements"), F.count_if("c").alias("complete"))
    return g.withColumn("percent", clamped_percent(F.col("complete"), F.col("elements")))


def progress_by_step(elements: DataFrame, submissions: DataFrame, steps: DataFrame) -> DataFrame:
    """AGG-27: setup, step, status, elements and percent of all elements of the setup: complete ones at the last step; of the others, by the
    step that they are at, how many have a submission that runs, is being processed, is pending or has failed (an element with several kinds counts
    in each), and at the step completed before, as unknown, those without any unfinished submission.

    elements: setup, element, completed; submissions: setup, element, step, done, failed, ended, alive; steps: setup, steps (their number)."""
    e = elements.join(steps, "setup")
    total = e.groupBy("setup").agg(F.count("*").alias("_all"))
    complete = e.filter("completed >= steps").groupBy("setup", F.col("completed").alias("step")).agg(F.count("*").alias("elements")).withColumn("status", F.lit("complete"))
    status = F.when(F.col("failed") == 1, "failed").when(F.col("ended"), "processing").when(F.col("alive"), "running").otherwise("pending")
    open_ones = e.filter("completed < steps").select("setup", "element", (F.col("completed") + 1).alias("step"))
    met = submissions.filter("done = 0").join(open_ones, ["setup", "element", "step"]).select("setup", "step", "element", status.alias("status")).distinct()
    busy = met.groupBy("setup", "step", "status").agg(F.count("*").alias("elements"))
    idle = open_ones.join(met.select("setup", "step", "element").distinct(), ["setup", "step", "element"], "left_anti").groupBy("setup", (F.col("step") - 1).alias("step")).agg(F.count("*").alias("elements")).withColumn("status", F.lit("unknown"))
    rows = complete.unionByName(busy).unionByName(idle)
    return rows.join(total, "setup").select("setup", "step", "status", "elements", clamped_percent(F.col("elements"), F.col("_all")).alias("percent"))


def setup_percent(elements: DataFrame, steps: DataFrame) -> DataFrame:
    """AGG-27: percent complete of each setup: steps done of all steps of all its elements."""
    g = elements.join(steps, "setup").groupBy("setup").agg(F.sum("completed").alias("_d"), F.sum("steps").alias("_s"))
    return g.select("setup", clamped_percent(F.col("_d"), F.col("_s")).alias("percent"))


def donor_rollup(samples: DataFrame) -> DataFrame:
    """AGG-28: example sample (the single control, else the shortest name, then alphabetical), latest date and samples of each donor; a
    sample is named by its public name where it has one."""
    name = F.coalesce(F.nullif(F.col("public_name"), F.lit("")), "sample") if "public_name" in samples.columns else F.col("sample")
    shortest = F.min(F.struct(F.length(name).alias("l"), name.alias("s")))["s"]
    return samples.groupBy("donor").agg(F.when(F.count_if("control") == 1, F.max(F.when(F.col("control"), name))).otherwise(shortest).alias("example"), F.max("created").alias("latest"), F.count("*").alias("samples"))


def variant_summary(variants: DataFrame) -> DataFrame:
    """AGG-31: records, classes and transitions to transversions."""
    ts = (F.col("kind") == "snp") & F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")
    snp = (F.col("kind") == "snp") & (F.col("ref") != F.col("alt"))
    return variants.groupBy("chrom").agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "snp").alias("snps"), F.count_if(F.col("kind") == "indel").alias("indels"), F.count_if(ts).alias("ts"), F.count_if(snp & ~ts).alias("tv"))


def genotype_counts(genotypes: DataFrame) -> DataFrame:
    """AGG-31: genotypes of each sample."""
    return genotypes.groupBy("sample").agg(*(F.count_if(F.col("gt") == g).alias(a) for a, g in (("hom_ref", "0/0"), ("het", "0/1"), ("hom_alt", "1/1"))))


def change_marker(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-32: one marker of all rows whatever their order: count, and sum of row hashes; null counts as 'NULL'."""
    row = F.md5(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns)))
    part = lambda a: F.conv(F.substring(row, a, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), *(F.sum(part(a)).alias(f"h{i}") for i, a in enumerate((1, 9, 17, 25))))


def sequence_total_length(sequences: DataFrame) -> DataFrame:
    """AGG-36"""
    return sequences.agg(F.sum("ln").alias("total"))


def reference_fingerprint(sequences: DataFrame) -> DataFrame:
    """AGG-37: md5 of the sequences' md5s in header order."""
    return sequences.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "m5"))), lambda x: x["m5"]), "")).alias("fingerprint"))


def log2_ratio(depth: DataFrame, min_samples: int = 25, include_x: bool = False, use_rpkm: bool = False) -> DataFrame:
    """AGG-38: log2 of depth (or rpkm) over the region's exact median over samples; null if fewer than min_samples."""
    value = F.col("rpkm" if use_rpkm else "depth")
    d = (depth if include_x else depth.filter(~F.col("chrom").isin("X", "chrX"))).withColumn("_v", value)
    d = stored(d.select("sample", "region", "_v"), "depths")
    med = group_medians(d, ["region"], "_v").withColumnRenamed("median", "m").join(d.groupBy("region").agg(F.countDistinct("sample").alias("n")), "region")
    return d.join(med, "region", "left").select("sample", "region", F.when((F.col("n") >= min_samples) & (F.col("m") > 0) & (F.col("_v") > 0), F.log2(F.col("_v") / F.col("m"))).alias("log2_ratio"))


def sample_means(ratios: DataFrame) -> DataFrame:
    """AGG-38: mean log2 ratio of each sample."""
    return ratios.groupBy("sample").agg(F.avg("log2_ratio").alias("mean"))


def mean_mad(ratios: DataFrame, key: str = "sample", value: str = "log2_ratio") -> DataFrame:
    """AGG-39: mean and exact median absolute deviation."""
    return _mean_mad(ratios, [key], value)


def call_mean_mad(ratios: DataFrame, calls: DataFrame, value: str = "log2_ratio") -> DataFrame:
    """AGG-39: the same for each call (sample, call, chrom, start, end), over its sample's regions (chrom, start, end) that touch it."""
    width = bin_width(calls)
    c = calls.select("sample", "call", "chrom", F.col("start").alias("_a"), F.col("end").alias("_b"), F.explode(bins(F.col("start"), F.col("end"), width)).alias("_bin"))
    r = ratios.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    met = r.join(c, ["sample", "chrom", "_bin"]).filter((F.col("start") <= F.col("_b")) & (F.col("end") >= F.col("_a")))
    once = met.filter(F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("_a") / width)))
    return _mean_mad(once.select("sample", "call", value), ["sample", "call"], value)


def _mean_mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = stored(rows.select(*keys, F.col(value).alias("_v")), "deviations")
    same = lambda: [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in keys]
    of = lambda medians: medians.select(*(F.col(k).alias(f"_{k}_of") for k in keys), F.col("median").alias("_m"))
    away = rows.join(of(group_medians(rows, keys, "_v")), same()).select(*keys, F.abs(F.col("_v") - F.col("_m")).alias("_d"))
    means = rows.groupBy(*keys).agg(F.avg("_v").alias("mean"))
    return means.join(of(group_medians(away, keys, "_d")), same(), "left").select(*keys, "mean", F.col("_m").alias("mad"))


def reference_gc(sequences: DataFrame, window: int, column: str = "seq", targets: DataFrame | None = None) -> DataFrame:
    """AGG-40: histogram of the percentage of G and C over consecutive windows, the last being shorter.

    With targets (sn, start, end; from 1, ends included) windows lie in each
    target instead, from its start; sequences then have sn, and a target ends with its sequence."""
    text, lo, hi = F.col(column), F.lit(1), F.length(column)
    if targets is not None:
        sequences = sequences.join(targets.select("sn", F.col("start").alias("_a"), F.col("end").alias("_b")), "sn")
        lo, hi = F.greatest(F.col("_a"), F.lit(1)).cast("int"), F.least(F.col("_b"), F.length(column)).cast("int")
    starts = F.when(hi >= lo, F.sequence(lo, hi, F.lit(window)))
    w = sequences.select(F.explode(F.transform(starts, lambda s: F.substr(text, s, F.least(F.lit(window), hi - s + 1)))).alias("w")).filter(F.length("w") > 0)
    gc = F.length("w") - F.length(F.translate("w", "GCgc", ""))
    return w.groupBy(F.floor(100 * gc / F.length("w")).alias("gc_percent")).agg(F.count("*").alias("windows"))


def batch_by_region(files: DataFrame, most: int) -> DataFrame:
    """AGG-41: batches of at most `most` files of one (chrom, from, to); a single file without region puts all in one group."""
    any_missing = files.agg(F.count_if(F.col("chrom").isNull()).alias("n")).withColumn("all_one", F.col("n") > 0).select("all_one")
    f = files.crossJoin(F.broadcast(any_missing)).withColumn("group", F.when(F.col("all_one"), "all").otherwise(F.concat_ws("_", "chrom", F.col("from").cast("string"), F.col("to").cast("string"))))
    return number_within(f.select("file_id", "group"), "group", "file_id").select("file_id", "group", F.floor((F.col("rn") - 1) / most).alias("batch"))
