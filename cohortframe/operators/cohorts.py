"""Cohorts of many samples: numbered samples, sparse genotype vectors, and blocked comparison of all pairs (JON-12, JON-17).

Samples are numbered once by a dictionary table. A site's calls are an array of
(sample number, genotype) sorted by number, so merging and export go along
it once. Pairs of samples are compared in tiles of sites and blocks of samples by matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import stored
from .ordering import with_place

#: Samples of a block, calls of a tile of sites (about), rows of a dictionary that are broadcast at most.
BLOCK, TILE_CALLS, BROADCAST_ROWS = 256, 1 << 20, 1_000_000


def sample_dictionary(genotypes: DataFrame) -> DataFrame:
    """JON-12: sample and sample_no, from 0 in the order of names."""
    ordered = genotypes.select("sample").filter("sample is not null").distinct().orderBy("sample")
    return stored(with_place(ordered).select("sample", (F.col("place") - 1).cast("int").alias("sample_no")), "samples")


def _numbered(genotypes: DataFrame, dictionary: DataFrame) -> DataFrame:
    few = dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return genotypes.join(F.broadcast(dictionary) if few else dictionary, "sample")


def merge_samples(genotypes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JON-12: sites (chrom, pos, ref) of all call sets as one matrix row each: alts, the alternative alleles of all sets, sorted, and calls, an
    array of (sample_no, gt) sorted by number, with alleles numbered by alts.

    genotypes: chrom, pos, ref, alt (comma-separated), sample, gt. Of a sample
    called twice at a site the greater genotype text counts. Samples that a site lacks take no room; `matrix_rows` fills them in."""
    each = F.split("alt", ",")
    g = _numbered(genotypes, dictionary).groupBy("chrom", "pos", "ref").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(each)))).alias("alts"), F.collect_set(F.struct("sample_no", each.alias("own"), "gt")).alias("_c"))
    number = lambda c, alts: lambda x: F.when(~x.rlike(r"^[1-9]\d*$"), x).otherwise(F.array_position(alts, F.get(c["own"], x.cast("int") - 1)).cast("string"))
    numbered = lambda c, alts: F.transform(F.split(c["gt"], "[/|]"), number(c, alts))
    renumbered = lambda c, alts: F.when(c["gt"].contains("|"), F.array_join(numbered(c, alts), "|")).otherwise(F.array_join(numbered(c, alts), "/"))
    g = g.withColumn("_s", F.array_sort(F.transform("_c", lambda c: F.struct(c["sample_no"].alias("sample_no"), renumbered(c, F.col("alts")).alias("gt")))))
    # of neighbours with one number the last counts
    last = F.filter("_s", lambda x, i: ~F.coalesce(F.get("_s", i + 1)["sample_no"] == x["sample_no"], F.lit(False)))
    return g.select("chrom", "pos", "ref", "alts", last.alias("calls"))


def named_calls(merged: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JON-12: the calls of merged sites with their samples' names: chrom, pos, ref, alts, sample, gt."""
    each = merged.select("chrom", "pos", "ref", "alts", F.explode("calls").alias("c")).select("chrom", "pos", "ref", "alts", "c.sample_no", "c.gt")
    few = dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return each.join(F.broadcast(dictionary) if few else dictionary, "sample_no").select("chrom", "pos", "ref", "alts", "sample", "gt")


def matrix_rows(merged: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JON-12: chrom, pos, ref, alt and gts, the genotypes of all numbered samples in their order, './.' where a site has none.

    The gaps between neighbours of the sorted calls are filled, so a site costs one step a sample."""
    n = dictionary.agg(F.max("sample_no")).first()[0]
    n = 0 if n is None else n + 1
    none = lambda k: F.array_repeat(F.lit("./."), k)
    before = lambda i: F.coalesce(F.get("calls", i - 1)["sample_no"], F.lit(-1))
    filled = F.flatten(F.transform("calls", lambda x, i: F.concat(none((x["sample_no"] - before(i) - 1).cast("int")), F.array(x["gt"]))))
    rest = none((F.lit(n - 1) - F.coalesce(F.get("calls", F.size("calls") - 1)["sample_no"], F.lit(-1))).cast("int"))
    return merged.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), F.concat(filled, rest).alias("gts"))


PACKED = "tile int, block int, sites binary, samples binary, gts binary, dps binary"


def pairwise_discordance(genotypes: DataFrame) -> DataFrame:
    """JON-17: each pair of samples with shared sites: sites, discordant ones and the average least depth.

    A row a tile of sites and block of samples holds their calls; each two blocks of a tile meet as two rows, not as their
    sites' pairs of samples. Shared and equal calls are products of 0/1 matrices (samples by sites, one a genotype), and the sum of
    least depths is one product for each depth that occurs, weighted by its step. A null depth counts as none, a null genotype as neither equal nor different."""
    dictionary = sample_dictionary(genotypes)
    calls = stored(_numbered(genotypes, dictionary).filter("chrom is not null and pos is not null").select("sample_no", F.xxhash64("chrom", F.lit("site"), "pos").alias("site"), "chrom", "pos", "gt", F.col("dp").cast("double").alias("dp")), "calls")
    n = calls.count()
    tiles = max(1, n // TILE_CALLS)
    placed = calls.select(F.pmod("site", F.lit(tiles)).cast("int").alias("tile"), F.floor(F.col("sample_no") / BLOCK).cast("int").alias("block"), "chrom", "pos", "sample_no", "gt", "dp")

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        site = pc.binary_join_element_wise(group.column("chrom").cast(pa.string()), group.column("pos").cast(pa.string()), "\t").to_pylist()
        raw = [b"\n".join(x.encode() for x in site), group.column("sample_no").to_numpy().astype("<i4").tobytes(), "\n".join("" if x is None else "=" + x for x in group.column("gt").to_pylist()).encode(), group.column("dp").fill_null(np.nan).to_numpy().astype("<f8").tobytes()]
        return pa.table({"tile": group.column("tile")[:1], "block": group.column("block")[:1]} | {c: pa.array([x], pa.binary()) for c, x in zip(("sites", "samples", "gts", "dps"), raw, strict=True)})

    packed = stored(placed.groupBy("tile", "block").applyInArrow(pack, PACKED), "tiles")
    blocks = (dictionary.agg(F.max("sample_no")).first()[0] or 0) // BLOCK + 1
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    met = packed.select("*", other).select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sites", "samples", "gts", "dps")

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        rows = {r["block"]: r for r in group.to_pylist()}
        empty = pa.table({c: pa.array([], t) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("sites", pa.int64()), ("discordant", pa.int64()), ("depth", pa.float64()), ("n_depth", pa.int64()))})
        if i not in rows or j not in rows:
            return empty
        own = [(r["sites"].split(b"\n"), np.frombuffer(r["samples"], "<i4"), r["gts"].split(b"\n"), np.frombuffer(r["dps"], "<f8")) for r in (rows[i], rows[j])]
        _, site = np.unique(np.array(own[0][0] + own[1][0], object).astype(bytes), return_inverse=True)
        kinds, kind = np.unique(np.array(own[0][2] + own[1][2], object).astype(bytes), return_inverse=True)
        cut, width = len(own[0][0]), int(site.max()) + 1
        sides = [(s % BLOCK, site[x], kind[x], d) for (_, s, _, d), x in zip(own, (slice(0, cut), slice(cut, None)), strict=True)]

        def product(chosen) -> np.ndarray:
            total = np.zeros((BLOCK, BLOCK))
            for a in range(0, width, 4096):
                both = []
                for side in sides:
                    keep = chosen(side) & (side[1] >= a) & (side[1] < a + 4096)
                    m = np.zeros((BLOCK, min(4096, width - a)), np.float32)
                    np.add.at(m, (side[0][keep], side[1][keep] - a), 1)
                    both.append(m)
                total += both[0] @ both[1].T
            return total

        every = product(lambda s: np.ones(len(s[0]), bool))
        given = product(lambda s: kinds[s[2]] != b"") if b"" in kinds else every
        same = sum((product(lambda s, k=k: s[2] == k) for k in range(len(kinds)) if kinds[k] != b""), np.zeros_like(every))
        # least(x, y) is the sum of the steps of depth that both reach; a null reaches all, and two of them aren't counted
        depths = np.unique(np.r_[own[0][3], own[1][3]])
        depths = depths[~np.isnan(depths)]
        lowest = depths[0] if len(depths) else 0.0
        missing = product(lambda s: np.isnan(s[3])) if np.isnan(np.r_[own[0][3], own[1][3]]).any() else np.zeros_like(every)
        n_depth = every - missing
        depth = lowest * n_depth
        for low, high in zip(depths[:-1], depths[1:], strict=True):
            depth += (high - low) * (product(lambda s, high=high: np.isnan(s[3]) | (s[3] >= high)) - missing)
        x, y = np.nonzero(every)
        keep = (x < y) | (i != j)
        x, y = x[keep], y[keep]
        return pa.table({"a": pa.array((x + i * BLOCK).astype(np.int32)), "b": pa.array((y + j * BLOCK).astype(np.int32)), "sites": every[x, y].astype(np.int64), "discordant": (given - same)[x, y].astype(np.int64), "depth": depth[x, y], "n_depth": n_depth[x, y].astype(np.int64)})

    counted = met.groupBy("tile", "i", "j").applyInArrow(compare, "a int, b int, sites long, discordant long, depth double, n_depth long")
    sums = counted.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("sites", "discordant", "depth", "n_depth")))
    of = lambda c: dictionary.select(F.col("sample").alias(f"sample_{c}"), F.col("sample_no").alias(c))
    out = sums.join(of("a"), "a").join(of("b"), "b").withColumn("avg_min_depth", F.when(F.col("n_depth") > 0, F.col("depth") / F.col("n_depth")))
    return out.select("sample_a", "sample_b", "sites", "discordant", "avg_min_depth", F.when(F.col("sites") < 100, "fluidigm").otherwise("genotype").alias("type"))
