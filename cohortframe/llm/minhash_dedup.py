"""MinHash near-deduplication with bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles as 64-bit hashes; the k
smallest are its sketch. Documents with equal sets form a class, and classes
are compared. Retained values that few classes share have inverted lists; two
classes in a list are a candidate pair. The bottom k of the union of two
sketches estimates their Jaccard index, and pairs far below the threshold (by
six standard deviations) go. The full sets decide the rest. Linked classes
become components.

Common values: a value retained by more than `common` classes (a shared
passage, or a large group of near copies) enters no list of a class that keeps
enough rarer values, which are over two thirds of its sketch: at the threshold
a quarter of a text's values can be its own, so a class that links by common
values alone gets there with a chance of about 1e-17. All other classes enter
the common lists by their 16 smallest values. A common list is divided by size
of set: linked sets differ in size by a third at most, so a class enters the
part of its own size and the next, and two that can link meet in one. There,
for some rounds, each over a share of the values, one leader of a part is
compared with all its members, as long as the part reaches over more than one
component; what is then still open in any list is compared on full sets in
blocks of bounded size, of which only links that join components come back. So no list is expanded into all its pairs, and none
is cut short.

Cases: null text, empty text and text without words have the empty set and
link with nothing; with fewer than five words the whole sequence is the one
shingle; rows with null doc_id link with nothing and have null component_id;
rows with one doc_id are one document of each of their sets; an empty table
gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, free_name, released, slices, smaller_batches, stored, tidied
from .components import components

WORDS, KEEP, COMMON, RARE_LISTS, COMMON_LISTS = 5, 96, 32, 40, 16
#: Members and values of sets of a block, about, at most.
MEMBERS, VALUES, STRIP = 2048, 1 << 18, 512
#: Values whose occurrence in a block is compared at once.
COLUMNS = 256
#: Classes whose tables are one task's work.
ROWS_A_TASK = 20_000
#: Rows up to which a table of keys is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text, A-Z lower-cased, as signed 64-bit integers."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    wide = min(WORDS, len(own))
    n = len(own) - wide + 1
    h = np.full(n, wide, np.uint64)
    for j in range(wide):
        h = (h ^ own[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def _key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (128-bit hash of the whole set), n (its size) and sketch (its KEEP smallest values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(x) for x in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[:KEEP] for x in sets], pa.list_(pa.int64()))], ["doc_id", "key", "n", "sketch"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, key binary, n long, sketch array<long>")


def with_set_key(docs: DataFrame) -> DataFrame:
    """docs with two more columns, last: the key of each text's set (as in sketches) and the set's size."""
    names = free_name(docs, "set_key"), free_name(docs, "set_size")
    plain = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(x) for x in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], [*part.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(tidied(run), f"{schema}, `{names[0]}` binary, `{names[1]}` long")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]


def _with_common(classes: DataFrame, common: DataFrame) -> tuple[DataFrame, object]:
    """classes with the common values of their sketches: from a broadcast array if there are few, else by a join."""
    if common.count() <= BROADCAST_ROWS:
        values = np.sort(common.toArrow().column("value").to_numpy().astype(np.int64))
        return classes.withColumn("shared", F.lit(None).cast("array<long>")), classes.sparkSession.sparkContext.broadcast(values)
    shared = classes.select("key", F.explode("sketch").alias("value")).join(common, "value", "left_semi").groupBy("key").agg(F.collect_set("value").alias("shared"))
    return classes.join(shared, "key", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<long>"))), None


def list_entries(classes: DataFrame, sent: object, rare: bool) -> DataFrame:
    """The inverted lists' entries (value, key, n): of rare values, or of common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _lists(batch.column("sketch"))
            if sent is not None:
                all_common = np.isin(values, sent.value)
            out, of = [], []
            extra = batch.column("shared").to_pylist() if sent is None else None
            for i in range(batch.num_rows):
                own = values[ends[i] : ends[i + 1]]
                common = all_common[ends[i] : ends[i + 1]] if extra is None else np.isin(own, extra[i] or [])
                if rare:
                    chosen = own[~common][:RARE_LISTS]
                elif 3 * (~common).sum() <= 2 * len(own):
                    chosen = own[:COMMON_LISTS][common[:COMMON_LISTS]]
                else:
                    continue
                out.append(chosen)
                of.append(np.full(len(chosen), i))
            if not out:
                continue
            rows = pa.array(np.concatenate(of), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64()), batch.column("key").take(rows), batch.column("n").take(rows)], ["value", "key", "n"])

    return classes.select("key", "n", "sketch", "shared").mapInArrow(tidied(run), "value long, key binary, n long")


def _fits(n: str, m: str, percent: int) -> F.Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that the bottom k of their sketches' union doesn't rule out; exact says that the sketches are whole sets and link."""
    own = classes.select("key", "n", "sketch")
    both = pairs.select("a", "b").join(own.toDF("a", "n_a", "s_a"), "a").join(own.toDF("b", "n_b", "s_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, ea), (vb, eb) = _lists(batch.column("s_a")), _lists(batch.column("s_b"))
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep, exact = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = va[ea[i] : ea[i + 1]], vb[eb[i] : eb[i + 1]]
                merged = np.sort(np.r_[a, b], kind="stable")
                twice = merged[1:] == merged[:-1]
                if n_a[i] == len(a) and n_b[i] == len(b):
                    same = int(twice.sum())
                    keep[i] = exact[i] = 100 * same >= percent * (len(merged) - same)
                    continue
                distinct = np.r_[True, ~twice]
                last = np.searchsorted(np.cumsum(distinct), KEEP + 1) - 1  # the last place of the KEEP smallest
                k, same = int(distinct[: last + 1].sum()), int(twice[:last].sum())
                share = percent / 100
                keep[i] = same >= k * share - 6 * np.sqrt(k * share * (1 - share))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array(exact).filter(mask)], ["a", "b", "exact"])

    return both.mapInArrow(tidied(run), "a binary, b binary, exact boolean")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def full_sets(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """key and whole set of the given classes, made anew from one document of each."""
    asked = stored(keys.join(classes.select("key", "doc_id"), "key"), "asked")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(x) for x in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(_small(asked.select("doc_id").distinct()), "doc_id", "left_semi").select("text")
    sets = stored(texts.mapInArrow(tidied(make), "key binary, set array<long>"), "sets")
    return sets.groupBy("key").agg(F.any_value("set").alias("set")) if sets.count() != asked.count() else sets


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of pairs (a, b) whose full sets link."""
    both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, ea), (vb, eb) = _lists(batch.column("s_a")), _lists(batch.column("s_b"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                merged = np.sort(np.r_[va[ea[i] : ea[i + 1]], vb[eb[i] : eb[i + 1]]], kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(merged) - same)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["u", "v"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(tidied(compare), "u binary, v binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that the sketches don't rule out and whose full sets link."""
    left = stored(estimated(pairs, classes, percent), "estimated")
    sure = left.filter("exact").select(F.col("a").alias("u"), F.col("b").alias("v"))
    open_pairs = left.filter("not exact").select("a", "b")
    sets = full_sets(open_pairs.select(F.col("a").alias("key")).union(open_pairs.select("b")).distinct(), classes, docs)
    return stored(sure.unionByName(linked(open_pairs, sets, percent)), "verified")


def rare_pairs(classes: DataFrame, sent: object, percent: int) -> DataFrame:
    """Pairs of classes that share a list of a rare value; a list has at most COMMON members by its making."""
    members = F.sort_array(F.collect_list(F.struct("key", "n")))
    lists = list_entries(classes, sent, rare=True).groupBy("value").agg(members.alias("m")).filter(F.size("m") > 1)
    first = lists.select("m", F.posexplode("m").alias("i", "x"))
    fits = F.filter(F.slice("m", F.col("i") + 2, F.size("m")), lambda y: 100 * F.least(y["n"], F.col("x.n")) >= percent * F.greatest(y["n"], F.col("x.n")))
    return first.select(F.col("x.key").alias("a"), F.explode(fits).alias("y")).select("a", F.col("y.key").alias("b")).groupBy("a", "b").agg(F.count("*").alias("overlaps"))


def by_size(entries: DataFrame, percent: int) -> DataFrame:
    """entries, each in the part of its list for its own size of set (upper false) and in the next one (upper true), so that
    any two sizes of which the smaller is at least percent of the larger meet in a part."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    parts = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("upper")), F.struct((band + 1).alias("band"), F.lit(True).alias("upper"))))
    return entries.select("*", parts.alias("p")).select("value", "p.band", "p.upper", "key", "n")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (key, comp) of linked classes so far, after further links: only the components that these join are worked out anew."""
    of = labels.select("key", "comp")
    named = links.join(_small(of.toDF("u", "cu")), "u", "left").join(_small(of.toDF("v", "cv")), "v", "left")
    found = stored(components(named.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))), "joined").toDF("comp", "joined")
    known = of.unionByName(found.select(F.col("comp").alias("key"), "comp").join(of, "key", "left_anti"))
    return stored(known.join(_small(found), "comp", "left").select("key", F.coalesce("joined", "comp").alias("comp")), "labels")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """entries with comp, the component of their class so far."""
    return entries.join(_small(labels), "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def leader_pairs(entries: DataFrame, round_no: int, percent: int, tasks: int) -> DataFrame:
    """In each list that reaches over several components, one member and all others that are in another component."""
    order = F.xxhash64("key", F.lit(round_no))
    open_lists = entries.groupBy("value", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("key", "n", "comp"), order).alias("leader"), F.bool_and("upper").alias("above")).filter("lo <> hi and not above")
    met = entries.join(stored(open_lists.select("value", "band", "leader").coalesce(tasks), "open-lists"), ["value", "band"]).filter((F.col("comp") != F.col("leader.comp")) & _fits("n", "leader.n", percent))
    return met.select(F.least("key", "leader.key").alias("a"), F.greatest("key", "leader.key").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def block_links(entries: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links (u, v) between different components within lists that still reach over several, enough to join what is linked.

    A part of a list is dealt into blocks of bounded members and values, and each two
    blocks of it meet in a group of their own, where full sets are compared.
    Classes of one component only meet those of others, so where a component
    holds most of a part its blocks meet the rest of the part alone."""
    sizes = entries.groupBy("value", "band", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("v"), F.bool_and("upper").alias("above"))
    lists = sizes.groupBy("value", "band").agg(F.count("*").alias("comps"), F.sum("m").alias("m"), F.sum("v").alias("v"), F.bool_and("above").alias("above"), F.max(F.struct("m", "v", "comp")).alias("most")).filter("comps > 1 and not above")
    blocks = lambda m, v: F.greatest(F.ceil(m / MEMBERS), F.ceil(v / VALUES)).cast("int")
    rest = blocks(F.col("m") - F.col("most.m"), F.col("v") - F.col("most.v"))
    lists = stored(lists.select("value", "band", F.col("most.comp").alias("largest"), blocks(F.col("most.m"), F.col("most.v")).alias("in_largest"), rest.alias("in_rest")).coalesce(tasks), "open-lists")
    dealt = entries.join(lists, ["value", "band"])
    at = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    inside = F.col("comp") == F.col("largest")
    # blocks of the rest come first, those of the largest component after them
    dealt = dealt.withColumn("own", F.when(inside, F.col("in_rest") + at(F.col("in_largest"))).otherwise(at(F.col("in_rest"))))
    others = F.when(inside, F.sequence(F.lit(0), F.col("in_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("in_rest") + F.col("in_largest") - 1))
    met = dealt.withColumn("other", F.explode(others)).select("value", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "upper", "key", "n", "comp")
    met = met.join(sets, "key")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own, n = group.column("own").to_numpy(), group.column("n").to_numpy().astype(np.int64)
        column = group.column("set")
        values, ends = _lists(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        _, comp = np.unique(np.array(group.column("comp").to_pylist(), object), return_inverse=True)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        # numbers of the values that several members have; those of one member alone are in no intersection
        _, place, often = np.unique(values, return_inverse=True, return_counts=True)
        number = np.cumsum(often > 1) - 1
        kept = often[place] > 1
        # rows of one block first, those of the other behind them, so that either is a view of what is filled
        turn = np.zeros(len(n), np.int32)
        turn[left if i == j else np.r_[left, right]] = np.arange(len(n), dtype=np.int32)
        row, place = np.repeat(turn, np.diff(ends))[kept], number[place[kept]].astype(np.int32)
        by_place = np.argsort(place, kind="stable")
        row, place = row[by_place], place[by_place]
        total = int(place[-1]) + 1 if len(place) else 0
        shared = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, total, COLUMNS):
            x, y = np.searchsorted(place, (a, a + COLUMNS))
            seen = np.zeros((len(n), COLUMNS), np.float32)
            seen[row[x:y], place[x:y] - a] = 1
            shared += seen[: len(left)] @ (seen[len(left) :] if i != j else seen).T
        upper = group.column("upper").to_numpy(zero_copy_only=False)
        found = [np.zeros((2, 0), np.int64)]
        for a in range(0, len(left), STRIP):
            some = left[a : a + STRIP]
            fit = (comp[some][:, None] != comp[right][None, :]) & ~(upper[some][:, None] & upper[right][None, :])  # two of the size below meet in their own part
            x, y = np.nonzero(fit)
            same = shared[a + x, y]
            link = 100 * same >= percent * ((n[some[x]] + n[right[y]]) - same)
            found.append(np.stack([some[x[link]], right[y[link]]]))
        x, y = np.concatenate(found, axis=1)
        # one link for each two components that are linked here
        pairs = np.sort(np.stack([comp[x], comp[y]], axis=1), axis=1)
        _, some = np.unique(pairs, axis=0, return_index=True)
        keys = group.column("key").to_pylist()
        return pa.table({"u": pa.array([keys[x[k]] for k in some], pa.binary()), "v": pa.array([keys[y[k]] for k in some], pa.binary())})

    return met.groupBy("value", "band", "i", "j").applyInArrow(run, "u binary, v binary")


def linked_classes(classes: DataFrame, docs: DataFrame, percent: int, rounds: int = 3) -> DataFrame:
    """key and comp of every class that links with another: comp is the smallest key reachable by links."""
    tasks = max(6, classes.count() // ROWS_A_TASK)
    counts = classes.select(F.explode("sketch").alias("value")).groupBy("value").count().filter(F.col("count") > COMMON).select("value")
    marked, sent = _with_common(classes, stored(counts.coalesce(tasks), "common"))
    links = verified(stored(rare_pairs(marked, sent, percent).coalesce(tasks), "pairs"), classes, docs, percent)
    labels = stored(components(links), "labels").toDF("key", "comp")
    released(classes.sparkSession)  # broadcast keys as well as shuffles
    entries = stored(list_entries(marked, sent, rare=False).coalesce(tasks), "common-lists")
    if entries.isEmpty():
        return labels
    sets = full_sets(entries.select("key").distinct().coalesce(tasks), classes, docs)
    entries = stored(by_size(entries, percent).coalesce(tasks), "parts")
    for r in range(rounds):
        share = entries.filter(F.pmod(F.xxhash64("value"), F.lit(rounds)) == r)  # every list has its round
        labelled = stored(_labelled(share, labels).coalesce(tasks), "labelled")
        found = stored(linked(leader_pairs(labelled, r, percent, tasks), sets, percent).coalesce(tasks), "verified")
        if not found.isEmpty():
            labels = relabelled(labels, found)
        released(classes.sparkSession)
    labelled = stored(_labelled(entries, labels).coalesce(tasks), "labelled")
    found = stored(block_links(labelled, sets, percent, tasks), "verified")
    return labels if found.isEmpty() else relabelled(labels, found)


def near_duplicates(docs: DataFrame, percent: int = 75, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, and with `keyed` the keys of its set and of its component."""
    smaller_batches(docs.sparkSession)
    base = stored(sketches(docs), "sketches")
    full = base.filter("n > 0 and doc_id is not null")
    tasks = max(6, base.count() // ROWS_A_TASK)
    first = stored(full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).coalesce(tasks), "classes")
    # a class's sketch is read from its first document's row; a repeated row is the same again
    classes = full.select("key", "doc_id", "n", "sketch").join(first, ["key", "doc_id"])
    repeated = first.agg(F.count("*")).first()[0] != classes.count()
    classes = stored((classes.dropDuplicates(["key"]) if repeated else classes).coalesce(tasks), "class-sketches")
    found = linked_classes(classes, docs, percent).select("key", F.col("comp").alias("component"))
    met = stored(first.join(found, "key").coalesce(tasks), "linked")
    least = stored(met.groupBy("component").agg(F.min("doc_id").alias("component_id")).coalesce(tasks), "least")
    in_links = met.join(_small(least), "component")
    alone = first.filter("copies > 1").join(found, "key", "left_anti").select("key", F.col("doc_id").alias("component_id"), F.col("key").alias("component"))
    target = stored(in_links.select("key", "component_id", "component").unionByName(alone).coalesce(tasks), "component-ids")
    joined = base.select("doc_id", "n", "key").join(_small(target), "key", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "key", F.coalesce("component", "key").alias("component")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out if keyed else out.drop("key", "component")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
