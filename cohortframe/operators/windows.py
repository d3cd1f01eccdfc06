"""Ranking and order-dependent work (WIN) and sorts (SRT)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import natural_key
from ..sources.paths import stored
from .filters import latest_first
from .ordering import last_known, number_within, running_total


def genotype_verdict(scores: DataFrame, expected: DataFrame, min_ratio: float = 1.05, min_sites: int = 0, min_concordance: float = 0.94) -> DataFrame:
    """WIN-1: per lane best and next match and what they say of the expected sample: confirmed, unconfirmed, wrong, candidate or unknown.

    Ratio of best to next to two places, a divisor of 0 being 1e-6; where the
    expected sample ties with another for best, the other comes first."""
    s = scores.join(expected, "lane", "left")
    w = Window.partitionBy("lane").orderBy(F.desc("score"), F.coalesce((F.col("sample") == F.col("expected")).cast("int"), F.lit(0)), "sample")
    r = s.withColumn("_n", F.row_number().over(w))
    g = r.groupBy("lane").agg(
        F.max(F.when(F.col("_n") == 1, F.col("sample"))).alias("best"), F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("best_score"), F.max(F.when(F.col("_n") == 1, F.col("sites"))).alias("sites"),
        F.max(F.when(F.col("_n") == 2, F.col("sample"))).alias("next"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("next_score"), F.max("expected").alias("expected"), F.max(F.when(F.col("sample") == F.col("expected"), F.col("score"))).alias("expected_score"),
    )
    ratio = F.round(F.col("best_score") / F.when(F.coalesce("next_score", F.lit(0)) == 0, 1e-6).otherwise(F.col("next_score")), 2)
    tie = (F.col("expected_score") == F.col("best_score")) | (F.col("best") == F.col("expected"))
    good = (F.col("best_score") >= min_concordance) & (F.col("sites") >= min_sites)
    verdict = (
        F.when(F.col("expected_score").isNull() & (ratio >= min_ratio) & good, "candidate").when(F.col("expected").isNull(), "unknown")
        .when(tie & (ratio >= min_ratio) & good, "confirmed").when(tie, "unconfirmed").when((ratio >= min_ratio) & good, "wrong").otherwise("unconfirmed")
    )
    return g.withColumn("ratio", ratio).withColumn("verdict", verdict)


def latest_per(df: DataFrame, keys: list[str], date: str, *ties: Column) -> DataFrame:
    """WIN-2: the newest row of each group; a missing date is the default one."""
    return latest_first(df, keys, F.desc(F.coalesce(F.col(date), F.lit(0))), *ties)


def split_by_bases(fastq: DataFrame, chunk_size: int, file: str = "file") -> DataFrame:
    """WIN-5/HLP-4: greedy chunks a file, in file order: a new one begins where the bases of the chunk so far and the next read pair
    would exceed the size, so a pair larger than that is a chunk of its own.

    Where a chunk that began at a row would end follows from the file's running
    totals, so every row has a pointer to the next chunk's first row. From a
    file's first row the pointers lead to all chunks; as many pointers as were
    followed are followed at once in the next round. So no file is gathered, and
    rounds grow with the logarithm of the chunks."""
    rows = number_within(fastq.select(F.col(file).cast("string").alias("file"), "row_no", "bases"), "file", "row_no").withColumnRenamed("rn", "i")
    totals = running_total(rows, "bases", "file", "row_no")
    first = totals.filter("i = 1").select("file", (F.col("total") - F.col("bases")).alias("_base"))
    held = stored(totals.join(first, "file").select("file", "i", "bases", (F.col("total") - F.col("_base")).cast("long").alias("cum")), "totals")
    # the first row whose running total is above that before a row, and above it by more than the size
    before = F.col("cum") - F.col("bases")
    asked = held.select("file", F.col("i").alias("of"), F.explode(F.array(F.struct(before.alias("x"), F.lit(0).alias("k")), F.struct((before + chunk_size).alias("x"), F.lit(1).alias("k")))).alias("q")).select("file", (-F.col("q.x")).alias("down"), F.lit(0).alias("kind"), F.col("of").alias("_o"), "of", "q.k", F.lit(None).cast("long").alias("above"))
    marks = held.select("file", (-F.col("cum")).alias("down"), F.lit(1).alias("kind"), (-F.col("i")).alias("_o"), F.lit(None).cast("long").alias("of"), F.lit(None).cast("int").alias("k"), F.col("i").cast("long").alias("above"))
    swept = last_known(asked.unionByName(marks), "above", "file", "down", "kind", "_o").filter("kind = 0")
    both = swept.groupBy("file", "of").agg(F.max(F.when(F.col("k") == 0, F.col("above"))).alias("some"), F.max(F.when(F.col("k") == 1, F.col("above"))).alias("over"))
    pointers = stored(both.filter("over is not null").select("file", F.col("of").alias("i"), F.greatest("over", F.col("some") + 1).alias("next")).join(held.select("file", F.col("i").alias("next")), ["file", "next"]).select("file", "i", "next"), "pointers")
    starts = stored(held.filter("i = 1").select("file", F.col("i").cast("long").alias("i")), "starts")
    while not pointers.isEmpty():
        starts = stored(starts.unionByName(starts.join(pointers, ["file", "i"]).select("file", F.col("next").alias("i"))), "starts")
        pointers = stored(pointers.join(pointers.toDF("file", "next", "further"), ["file", "next"]).select("file", "i", F.col("further").alias("next")), "pointers")
    numbered = number_within(starts, "file", "i").select("file", "i", F.col("rn").cast("long").alias("chunk"))
    dealt = last_known(held.join(numbered, ["file", "i"], "left"), "chunk", "file", "i")
    return dealt.groupBy("file", "chunk").agg(F.count("*").alias("reads"), F.sum("bases").alias("bases"), F.round(F.sum("bases") / F.count("*"), 2).alias("avg_length"))


def split_by_reads(fastq: DataFrame, chunk_size: int, avg_lengths: float, file: str = "file") -> DataFrame:
    """WIN-6: floor(chunk / sum of average lengths) reads a chunk, in file order."""
    n = max(1, int(chunk_size // avg_lengths))
    return number_within(fastq, file, "row_no").withColumn("chunk", F.floor((F.col("rn") - 1) / n) + 1).drop("rn")


def fill_read_group(reads: DataFrame, file: str = "file") -> DataFrame:
    """WIN-7: a missing read group takes the previous read's; '*' before the first."""
    return last_known(reads, "rg", file, "row_no").withColumn("rg", F.coalesce("rg", F.lit("*")))


def number_pairs(pairs: DataFrame) -> DataFrame:
    """WIN-8: occurrence number of each unordered pair; a leading 'digits:' is not part of a name."""
    a, b = F.regexp_replace("sample_a", r"^\d+:", ""), F.regexp_replace("sample_b", r"^\d+:", "")
    keyed = pairs.withColumn("_pair", F.concat_ws("\u0001", F.least(a, b), F.greatest(a, b)))
    return number_within(keyed, "_pair", "row_no").withColumnRenamed("rn", "occurrence").drop("_pair")


def sample_offsets(fastqs: DataFrame) -> DataFrame:
    """WIN-11: first and last read index of each sample in the concatenation, samples in alphabetical order."""
    per = fastqs.groupBy("sample").agg(F.sum("reads").alias("reads"))
    return running_total(per, "reads", "sample").select("sample", (F.col("total") - F.col("reads")).alias("start"), (F.col("total") - 1).alias("end"))


def select_for_consistency_check(lanes: DataFrame, min_total: int, min_confirmed: int) -> DataFrame:
    """WIN-12: lanes to check in each library, of (lane, library, bases, targeted_bases, confirmed, row_no): targeted bases count where
    there are any. None where a library's bases are below min_total; all where its confirmed ones are below min_confirmed; else the
    unconfirmed ones, and confirmed ones as long as those taken before, in order, are below min_confirmed.

    Both bounds are in bases; the tracking side's habit of comparing one in megabases and the other in bases isn't kept."""
    size = F.coalesce(F.nullif(F.col("targeted_bases"), F.lit(0)), "bases") if "targeted_bases" in lanes.columns else F.col("bases")
    t = lanes.withColumn("_size", size)
    w = Window.partitionBy("library")
    before = F.coalesce(F.sum(F.when(F.col("confirmed"), F.col("_size"))).over(w.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("_all", F.sum("_size").over(w)).withColumn("_before", before)
    return t.filter((F.col("_all") >= min_total) & (~F.col("confirmed") | (F.col("_before") < min_confirmed))).drop("_all", "_before", "_size")


def confirm_library(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """WIN-13: whether the expected sample has the top score, alone or tied."""
    top = scores.groupBy("lane").agg(F.max("score").alias("top"))
    e = scores.join(expected, "lane").filter("sample = expected").select("lane", F.col("score").alias("own"))
    return top.join(e, "lane", "left").select("lane", F.coalesce(F.col("own") == F.col("top"), F.lit(False)).alias("confirmed"))


def mark_duplicates(reads: DataFrame) -> DataFrame:
    """WIN-14: adds the duplicate bit to all but the best pair of a library and position signature.

    Pairs by (lib, qname); the signature holds both ends' chromosome, strand
    and 5' position, clipped bases included: the position less the leading
    clips of a forward read, the last reference base plus the trailing clips of
    a reverse one. Best is the highest quality sum, then the greater name. The
    best pair of a signature is an aggregate, so a hot signature is not one task."""
    reverse = (F.col("flag").bitwiseAND(F.lit(16)) != 0).cast("int")
    mapped = F.col("flag").bitwiseAND(F.lit(4 + 256)) == 0
    of = lambda p: F.aggregate(F.regexp_extract_all("cigar", F.lit(p), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    leading = of(r"(\d+)[SH](?=.*[MIDNP=X])")
    trailing = of(r"(\d+)[SH](?!.*[MIDNP=X])")
    five_prime = F.when(reverse == 1, F.col("pos") + of(r"(\d+)[MDN=X]") - 1 + trailing).otherwise(F.col("pos") - leading)
    end = F.struct("rname", five_prime.alias("p"), reverse.alias("r"))
    pairs = reads.filter(mapped).groupBy("lib", "qname").agg(F.array_sort(F.collect_set(end)).alias("sig"), F.sum("sum_qual").alias("q"))
    best = pairs.groupBy("lib", "sig").agg(F.max_by("qname", F.struct("q", F.col("qname"))).alias("best"), F.count("*").alias("c")).filter("c > 1")
    dup = pairs.join(best, ["lib", "sig"]).filter("qname <> best").select("lib", "qname").withColumn("dup", F.lit(True))
    clean = F.col("flag").bitwiseAND(F.lit(~1024))
    return reads.join(dup, ["lib", "qname"], "left").withColumn("flag", F.when(F.col("dup") & mapped, clean.bitwiseOR(F.lit(1024))).otherwise(clean)).drop("dup")


def sort_coordinate(reads: DataFrame, sequences: DataFrame) -> DataFrame:
    """SRT-1: by the header's sequence order and position, unmapped last; range partitions, each sorted.

    Spark broadcasts the header's sequences where they are small."""
    r = reads.join(sequences.select(F.col("sn").alias("rname"), F.col("idx").alias("_i")), "rname", "left").withColumn("_i", F.when(F.col("flag").bitwiseAND(F.lit(4)) != 0, None).otherwise(F.col("_i")))
    return r.orderBy(F.asc_nulls_last("_i"), "pos", "qname").drop("_i")


def sort_by_name(reads: DataFrame) -> DataFrame:
    """SRT-2"""
    return reads.orderBy("qname", "flag")


def shuffle_by_name(reads: DataFrame) -> DataFrame:
    """SRT-2: pairs together, in any order."""
    return reads.repartition("qname").sortWithinPartitions("qname")


def sort_variants(variants: DataFrame) -> DataFrame:
    """SRT-3"""
    return variants.orderBy(natural_key(F.col("chrom")), "pos")


def order_parts(parts: DataFrame) -> DataFrame:
    """SRT-4: by numeric seq_no."""
    return parts.orderBy(F.col("seq_no").cast("long"))


def report_order(df: DataFrame, *columns: str) -> DataFrame:
    """SRT-5: '-name' sorts down, '~name' by natural chromosome order."""
    key = lambda c: F.desc(c[1:]) if c[0] == "-" else natural_key(F.col(c[1:])) if c[0] == "~" else F.asc(c)
    return df.orderBy(*(key(c) for c in columns))


def limit_files(files: DataFrame, n: int) -> DataFrame:
    """SRT-6: the first n by id."""
    return files.orderBy("file_id").limit(n)


def apply_records(df: DataFrame, fn, schema: str, keep_rows: bool = True) -> DataFrame:
    """UDF-1: a user's function over batches (pandas) of records; with keep_rows a batch of another length is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf)
            if keep_rows and len(out) != len(pdf):
                raise ValueError(f"{len(pdf)} records in, {len(out)} out")
            yield out

    return df.mapInPandas(run, schema)


def with_overrides(chunks: DataFrame, overrides: DataFrame, option: str) -> DataFrame:
    """UDF-3: an option's value of a chunk (key chrom_from-to), overridden where given."""
    key = F.concat(F.col("chrom"), F.lit("_"), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string"))
    return chunks.withColumn("key", key).join(overrides.select("key", F.col(option).alias("_o")), "key", "left").withColumn(option, F.coalesce("_o", option)).drop("_o")
