"""Interval joins by bins, chunking of genomes and variants, and depth over regions (HLP-2, JON-1 to JON-4, JON-35/36, WIN-3/4, AGG-29/30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_within, with_place


def bin_width(intervals: DataFrame, lo: str = "start", hi: str = "end") -> int:
    """A bin width from the intervals' own lengths: about their 90th percentile, 64 at least."""
    q = intervals.select(F.percentile_approx(F.col(hi) - F.col(lo) + 1, 0.9, 1000)).first()[0]
    return max(64, int(q or 64))


def bins(lo: Column, hi: Column, width: int) -> Column:
    """The bins that [lo, hi] touches."""
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def points_in_intervals(points: DataFrame, pos: str, intervals: DataFrame, keys: list[str], lo: str = "start", hi: str = "end") -> DataFrame:
    """HLP-2 for points: each point with every interval that contains it, ends included.

    The intervals go into all bins they touch and the point into one, so no
    pair comes twice; the join is on (keys, bin)."""
    width = bin_width(intervals, lo, hi)
    dealt = intervals.withColumn("_bin", F.explode(bins(F.col(lo), F.col(hi), width)))
    return points.withColumn("_bin", F.floor(F.col(pos) / width)).join(dealt, [*keys, "_bin"]).filter(F.col(pos).between(F.col(lo), F.col(hi))).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """HLP-2 for intervals (a_start, a_end) and (b_start, b_end), half-open: pairs that overlap, each once.

    Both go into all bins they touch; a pair counts in the first bin they share."""
    width = bin_width(b, "b_start", "b_end")
    x = a.withColumn("_bin", F.explode(bins(F.col("a_start"), F.greatest("a_start", F.col("a_end") - 1), width)))
    y = b.withColumn("_bin", F.explode(bins(F.col("b_start"), F.greatest("b_start", F.col("b_end") - 1), width)))
    met = x.join(y, [*keys, "_bin"]).filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return met.filter(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_bin")


def reads_to_regions(reads: DataFrame, regions: DataFrame, include_mate: bool = False) -> DataFrame:
    """JON-1: qname, row_no and region for every region that contains the read's start (or its mate's); a read enters a region once."""
    keep = ["qname", "row_no", "flag"]
    r = regions.select("region", "chrom", "start", "end")
    own = points_in_intervals(reads.select(*keep, F.col("rname").alias("chrom"), "pos"), "pos", r, ["chrom"]).select(*keep, "region")
    if not include_mate:
        return own
    mate = points_in_intervals(reads.select(*keep, F.col("mrnm").alias("chrom"), F.col("mpos").alias("pos")), "pos", r, ["chrom"]).select(*keep, "region")
    return own.unionByName(mate).distinct()


#: Fixed value: names of sequences that are no chromosomes.
NON_CHROMOSOMAL = r"^(?:N[TC]_\d+|GL\d+|hs\S+)"


def sequence_groups(sequences: DataFrame, merge: dict[str, str] | None = None, ignore: str | None = None, only: str | None = None, non_chrom: bool = True) -> DataFrame:
    """JON-2: sn and prefix, the output groups of each sequence."""
    name = F.when(F.col("sn").contains("chr"), F.col("sn")).otherwise(F.concat(F.lit("chrom"), F.col("sn")))
    groups = []
    for pattern, prefix in (merge or {}).items():
        groups.append(F.when(F.col("sn").rlike(pattern), F.lit(prefix)))
    merged = F.array_compact(F.array(*groups)) if groups else F.array().cast("array<string>")
    other = F.when(F.lit(non_chrom and only is None) & F.col("sn").rlike(NON_CHROMOSOMAL), F.array(F.lit("nonchrom"))).otherwise(F.array(name))
    kept = sequences
    if ignore:
        kept = kept.filter(~F.col("sn").rlike(ignore))
    if only:
        kept = kept.filter(F.col("sn").rlike(only))
    return kept.select("sn", F.explode(F.when(F.size(merged) > 0, merged).otherwise(other)).alias("prefix"))


def reads_to_sequence_groups(reads: DataFrame, groups: DataFrame, include_mate: bool = False, make_unmapped: bool = False, all_unmapped: bool = False) -> DataFrame:
    """JON-2: reads with every group of their sequence (and their mate's), each once; unmapped ones apart.

    The groups are one row a sequence of the reference, so they are broadcast by their size."""
    unmapped, mate_unmapped = F.col("flag").bitwiseAND(F.lit(4)) != 0, F.col("flag").bitwiseAND(F.lit(8)) != 0
    keep = ["qname", "row_no", "flag"]
    own = reads.filter(~unmapped).join(groups, F.col("rname") == F.col("sn")).select(*keep, "prefix")
    if include_mate:
        own = own.unionByName(reads.filter(~unmapped & ~mate_unmapped).join(groups, F.col("mrnm") == F.col("sn")).select(*keep, "prefix"))
    if make_unmapped:
        lost = reads.filter(unmapped if all_unmapped else unmapped & mate_unmapped)
        own = own.unionByName(lost.select(*keep, F.lit("unmapped").alias("prefix")))
    return own.distinct()


def reciprocal_overlap(a: DataFrame, b: DataFrame, share: float = 0.5, keep: str = "semi") -> DataFrame:
    """JON-3: calls of a (donor, chrom, start, end, cnv_id) that overlap (semi) or don't overlap (anti) some call of b by share of both, half-open."""
    x = a.select("donor", "chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"), "cnv_id")
    y = b.select("donor", "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    met = overlapping(x, y, ["donor", "chrom"]).filter((both >= share * (F.col("a_end") - F.col("a_start"))) & (both >= share * (F.col("b_end") - F.col("b_start"))))
    return a.join(met.select("cnv_id").distinct(), "cnv_id", f"left_{keep}")


def cnv_control_counts(calls: DataFrame, controls: DataFrame, share: float = 0.5) -> DataFrame:
    """AGG-18: total calls of each donor and those that its control lacks; shared and lacking ones are all of them, or it is an error."""
    count = lambda keep, n: reciprocal_overlap(calls, controls, share, keep).groupBy("donor").agg(F.count("*").alias(n))
    j = calls.groupBy("donor").agg(F.count("*").alias("total")).join(count("semi", "_shared"), "donor", "left").join(count("anti", "not_in_control"), "donor", "left").fillna(0, ["_shared", "not_in_control"])
    whole = F.when(F.col("_shared") + F.col("not_in_control") == F.col("total"), F.col("total")).otherwise(F.raise_error(F.concat(F.lit("calls are missing of "), "donor")).cast("long"))
    return j.select("donor", whole.alias("total"), "not_in_control")


def expand_by_chunks(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """JON-4: elements (element, chrom or null) with every chunk, or with those of their own chromosome; a leading 'chrom' or 'chr' doesn't count."""
    bare = lambda c: F.regexp_replace(c, "^chr(om)?", "")
    own = elements.filter("chrom is not null").join(chunks.withColumn("_c", bare(F.col("chrom"))).drop("chrom"), bare(F.col("chrom")) == F.col("_c")).drop("_c")
    rest = elements.filter("chrom is null").select("element").crossJoin(chunks)
    return own.select("element", "chrom", "from", "to").unionByName(rest.select("element", "chrom", "from", "to"))


def variants_to_windows(variants: DataFrame, sequences: DataFrame, window: int = 10_000_000) -> DataFrame:
    """JON-35: variants with every window of their chromosome that [pos, pos + len(ref) - 1] touches, and its number over all sequences in order."""
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    lengths = sequences.withColumn("n", F.ceil(F.col("ln") / window)).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    last = F.col("pos") + F.length("ref") - 1
    dealt = variants.withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos") - 1) / window), F.floor((last - 1) / window))))
    met = dealt.join(lengths.select(F.col("sn").alias("chrom"), "ln", "n", "before"), "chrom").filter("bin < n")
    return met.select("chrom", "pos", "ref", (F.col("bin") * window + 1).alias("from"), F.least((F.col("bin") + 1) * window, F.col("ln")).alias("to"), (F.col("before") + F.col("bin") + 1).alias("seq_no"))


def chunk_sites(variants: DataFrame, chunk: int = 100_000, buffer: int = 0) -> DataFrame:
    """WIN-3: chrom, chunk_no, from, to and n of chunks of chunk + buffer + 1 consecutive sites, each sharing buffer + 1 with the next;
    a last chunk of under 75 % of chunk + buffer joins the one before it, its sites being counted again.

    Sites get their number by range partitions and prefix counts, so no chromosome is one task."""
    held = chunk + buffer
    numbered = number_within(variants.select("chrom", "pos"), "chrom", "pos")
    k_last = F.floor((F.col("rn") - 1) / chunk)
    k_first = F.greatest(F.lit(0), F.ceil((F.col("rn") - held - 1) / chunk))
    in_chunks = numbered.withColumn("k", F.explode(F.sequence(k_first, k_last)))
    made = in_chunks.groupBy("chrom", "k").agg(F.min("pos").alias("from"), F.max("pos").alias("to"), F.count("*").alias("n"))
    w = Window.partitionBy("chrom").orderBy("k")
    made = made.withColumn("last", F.lead("k").over(w).isNull())
    small = F.col("last") & (F.col("n") < 0.75 * held) & (F.col("k") > 0)
    made = made.withColumn("k2", F.when(small, F.col("k") - 1).otherwise(F.col("k")))
    return made.groupBy("chrom", F.col("k2").alias("chunk_no")).agg(F.min("from").alias("from"), F.max("to").alias("to"), F.sum("n").alias("n"))


def chunk_genome(sequences: DataFrame, size: int = 1_000_000, overlap: int = 0, chroms: list[str] | None = None, ploidy: list[tuple[str, int, int, int, int]] = (), default: tuple[int, int] = (2, 2)) -> DataFrame:
    """WIN-4, UDF-2: chrom, from, to, male, female and seq_no. ploidy: (chrom, from, to, male, female), elsewhere the default (male, female).

    A new chunk begins while its start is before the region's end, so a tail of one base is dropped; size 0 gives a chunk a region."""
    bare = lambda c: F.lower(F.regexp_replace(c, "(?i)^chr(om)?", ""))
    kept = sequences.withColumn("_c", bare(F.col("sn")))
    if chroms:
        kept = kept.filter(F.col("_c").isin([c.lower().removeprefix("chrom").removeprefix("chr") for c in chroms]))
    by_chrom: dict[str, list] = {}
    for c, a, b, m, f in sorted(ploidy):
        by_chrom.setdefault(c.lower().removeprefix("chrom").removeprefix("chr"), []).append((a, b, m, f))
    part = lambda a, b, m, f: F.struct(*(x.cast("long").alias(n) for n, x in zip(("a", "b", "m", "f"), (a, b, m, f), strict=True)))
    rest = tuple(F.lit(x) for x in default)
    whole = F.array(part(F.lit(1), F.col("ln"), *rest))
    regions = whole
    for c, rows in by_chrom.items():
        parts, at = [], 1
        for a, b, m, f in rows:
            if a > at:
                parts.append(part(F.lit(at), F.lit(a - 1), *rest))
            parts.append(part(F.lit(a), F.least(F.lit(b), F.col("ln")), F.lit(m), F.lit(f)))
            at = b + 1
        tail = F.when(F.col("ln") >= at, F.array(part(F.lit(at), F.col("ln"), *rest))).otherwise(F.array().cast("array<struct<a:long,b:long,m:long,f:long>>"))
        regions = F.when(F.col("_c") == c, F.concat(F.array(*parts), tail)).otherwise(regions)
    r = kept.select("sn", "idx", F.explode(regions).alias("r")).filter("r.a <= r.b")
    if size:
        step = size - overlap
        starts = F.when(F.col("r.a") < F.col("r.b"), F.sequence(F.col("r.a"), F.col("r.b") - 1, F.lit(step).cast("long"))).otherwise(F.array(F.col("r.a")))
        r = r.withColumn("from", F.explode(starts)).withColumn("to", F.least(F.col("from") + size - 1, F.col("r.b")))
        r = r.filter((F.col("from") == F.col("r.a")) | (F.col("from") + overlap <= F.col("r.b")))
    else:
        r = r.withColumn("from", F.col("r.a")).withColumn("to", F.col("r.b"))
    placed = with_place(r.select("idx", F.col("sn").alias("chrom"), "from", "to", F.col("r.m").alias("male"), F.col("r.f").alias("female")).orderBy("idx", "from"))
    return placed.select("chrom", "from", "to", "male", "female", F.col("place").cast("int").alias("seq_no"))


def region_depth(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """AGG-29: reads that start in each region; regions without any have 0."""
    met = reads_to_regions(reads, regions).groupBy("region").agg(F.count("*").alias("depth"))
    return regions.join(met, "region", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def region_rpkm(depth: DataFrame, sample: str = "sample") -> DataFrame:
    """AGG-30: reads x 10^9 / (region length x all reads of the sample)."""
    total = depth.groupBy(sample).agg(F.sum("depth").alias("total"))
    return depth.join(total, sample).withColumn("rpkm", F.col("depth") * 1e9 / ((F.col("end") - F.col("start") + 1) * F.col("total"))).drop("total")


def reference_panel_chunks(panel: DataFrame, chunks: DataFrame) -> DataFrame:
    """JON-36: sites of each panel in each chunk (chrom, chunk_no, from, to), ends included."""
    c = chunks.select("chrom", "chunk_no", F.col("from").alias("start"), F.col("to").alias("end"))
    return points_in_intervals(panel, "pos", c, ["chrom"]).drop("start", "end")
