"""Scalar functions as column expressions (section 2.8, HLP-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strand_complement(c: Column) -> Column:
    return F.translate(c, "ATGCatgc", "TACGtacg")


def split_sample_identifier(c: Column) -> Column:
    """Struct of name (before the last underscore), rest and control (ends in _CTRL)."""
    bare = F.regexp_replace(c, "_CTRL$", "")
    has = bare.contains("_")
    return F.struct(F.when(has, F.regexp_extract(bare, "^(.*)_([^_]*)$", 1)).otherwise(bare).alias("name"), F.when(has, F.regexp_extract(bare, "^(.*)_([^_]*)$", 2)).alias("rest"), c.endswith("_CTRL").alias("control"))


def dcc_filename(sample: Column, chrom: Column, platform: Column, algorithm: Column, pop: Column, group: Column, date: Column) -> Column:
    """Parts joined by dots; a null part is left out."""
    return F.concat_ws(".", sample, F.when(chrom.isNotNull(), F.concat(F.lit("chrom"), chrom)), platform, algorithm, pop, F.regexp_replace(group, " ", "_"), date, F.lit("bam"))


def region_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit("_"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_region(c: Column) -> Column:
    p = r"^(.*)_(\d+)-(\d+)$"
    return F.struct(F.regexp_extract(c, p, 1).alias("chrom"), F.regexp_extract(c, p, 2).try_cast("long").alias("start"), F.regexp_extract(c, p, 3).try_cast("long").alias("end"))


def template_basename(template: str, values: dict[str, Column], replacements: tuple[tuple[str, str], ...] = ()) -> Column:
    """'x.%key%.y' filled from columns, null as 'unknown', then patterns replaced in turn."""
    filled = reduce(lambda acc, kv: F.replace(acc, F.lit(f"%{kv[0]}%"), F.coalesce(kv[1].cast("string"), F.lit("unknown"))), values.items(), F.lit(template))
    return reduce(lambda acc, pr: F.regexp_replace(acc, pr[0], pr[1]), replacements, filled)


def basename(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^./]*$", "")


def join_path(root: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def mapping_program(programs: Column, order: tuple[str, ...] = ("bwa", "stampy", "smalt", "star")) -> Column:
    """The first program, in the given order, that an id of the array begins with."""

    def begins(p: str) -> Column:
        return F.exists(programs, lambda x: F.lower(x).startswith(p))

    return F.coalesce(*(F.when(begins(p), F.lit(p)) for p in order))


def rg_line(values: dict[str, Column]) -> Column:
    """@RG header line: tags with a value, in the given order."""
    return F.concat_ws("\t", F.lit("@RG"), *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c.cast("string"))) for k, c in values.items()))


def qual_to_ints(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: F.ascii(x) - 33)


def cigar_length(c: Column, ops: str) -> Column:
    """Sum of the lengths of the given operations."""
    return F.aggregate(F.regexp_extract_all(c, F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def seq_length(c: Column, stored: Column | None = None) -> Column:
    """S, H, I and M operations; without a CIGAR the stored length."""
    n = cigar_length(c, "SHIM")
    return n if stored is None else F.when(F.coalesce(c, F.lit("*")) == "*", stored).otherwise(n)


def mapped_length(c: Column) -> Column:
    return cigar_length(c, "M")


def set_diff_text(a: Column, b: Column) -> Column:
    """Null where two arrays hold the same values, else what each lacks."""
    gone, new = F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))
    return F.when((F.size(gone) + F.size(new)) > 0, F.concat(F.lit("-"), F.array_join(gone, ","), F.lit(" +"), F.array_join(new, ",")))


def tags_to_map(c: Column) -> Column:
    """'RG:Z:x<TAB>NM:i:1' as a map of tag to value."""
    parts = F.filter(F.split(c, "\t"), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.substring(x, 1, 2), F.regexp_replace(x, "^..:.:", ""))))


def decode_flags(c: Column) -> Column:
    """Names of the set bits, in bit order."""
    from ..operators.filters import FLAGS

    return F.array_compact(F.array(*(F.when(c.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in FLAGS.items())))


def truncate(c: Column) -> Column:
    """Towards zero, as a whole number."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")


def megabytes_text(c: Column) -> Column:
    """MB with no decimals above 10, else one."""
    mb = c / 1048576
    return F.when(mb > 10, F.round(mb, 0).cast("long").cast("string")).otherwise(F.format_string("%.1f", F.round(mb, 1)))


def duration_text(c: Column) -> Column:
    """Seconds as 'd days, h hrs, m mins, s secs'."""
    s = c.cast("long")
    return F.concat_ws(", ", F.concat(F.floor(s / 86400).cast("string"), F.lit(" days")), F.concat(F.floor(s % 86400 / 3600).cast("string"), F.lit(" hrs")), F.concat(F.floor(s % 3600 / 60).cast("string"), F.lit(" mins")), F.concat((s % 60).cast("string"), F.lit(" secs")))


def epoch_to_date(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")


def date_to_epoch(c: Column) -> Column:
    return F.unix_timestamp(c, "yyyy-MM-dd")


def report_time(c: Column) -> Column:
    """'Mon Sep  7 10:11:12 2015' or ISO text as a timestamp."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[A-Z][a-z]{2} ", ""), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("MMM d HH:mm:ss yyyy")), F.try_to_timestamp(c))


def md5_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("::", *parts))


def content_address(paths: Column) -> Column:
    """Identity of a set of paths: their order doesn't matter."""
    return F.md5(F.concat_ws(".", F.array_sort(paths)))


def natural_key(c: Column) -> Column:
    """Sort key of a chromosome name: numbers first by value, then X, Y, MT, then other names."""
    bare = F.regexp_replace(c, "(?i)^chr(om)?", "")
    number = bare.try_cast("int")
    special = F.when(F.upper(bare) == "X", 1001).when(F.upper(bare) == "Y", 1002).when(F.upper(bare).isin("MT", "M"), 1003)
    return F.struct(F.coalesce(number, special, F.lit(2000)).alias("n"), F.when(number.isNull() & special.isNull(), bare).otherwise("").alias("s"))
