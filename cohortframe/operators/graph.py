"""Bounded traversal of a property graph, pointer resolution, and graph and history upkeep (GRF, SET-9 to SET-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import stored


def related(
    edges: DataFrame, start: DataFrame, direction: str = "out", least: int = 1, most: int = 20, edge_type: str | None = None,
    nodes: DataFrame | None = None, label: str | None = None, props: dict[str, str] | None = None, ends: bool = False,
) -> DataFrame:
    """GRF-1: start, node and depth of every node reached from start (id) in least to most steps, at its nearest depth; the start is excluded.

    edge_type may name several types, 'a|b'. With a label, and props if wished,
    only such nodes (id, label, props map) are given; with a label, no type and
    most above 6, of each start only those at the nearest depth that has any;
    with ends, only those from which no further step leads to such a node.

    One round of joins for all starts together; each round's new nodes are
    written, so a round's plan doesn't hold the rounds before it, and the walk
    stops when nothing is new."""
    e = edges.filter(F.col("type").isin(edge_type.split("|"))) if edge_type else edges
    pairs = [e.select(F.col("src").alias("f"), F.col("dst").alias("t"))] if direction in ("out", "both") else []
    if direction in ("in", "both"):
        pairs.append(e.select(F.col("dst").alias("f"), F.col("src").alias("t")))
    steps = stored((pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])).distinct(), "steps")
    wanted = _of_spec(nodes, label, props) if label else None
    nearest = bool(label) and not edge_type and most > 6
    front = stored(start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "front")
    seen, given = front, []
    for depth in range(1, most + 1):
        new = front.join(steps, front["node"] == steps["f"]).select("start", F.col("t").alias("node")).distinct()
        front = stored(new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth >= max(1, least):
            found = front.join(wanted, front["node"] == wanted["id"], "left_semi") if label else front
            if nearest:
                found = stored(found, "found")
                front = front.join(found.select("start").distinct(), "start", "left_anti")  # these starts are done
            given.append(found)
    out = reduce(DataFrame.unionByName, given) if given else seen.limit(0)
    if ends:
        onward = steps.join(wanted, steps["t"] == wanted["id"], "left_semi") if label else steps
        out = out.join(onward.select(F.col("f").alias("node")).distinct(), "node", "left_anti").select("start", "node", "depth")
    return out


def nearest_labelled(edges: DataFrame, nodes: DataFrame, start: DataFrame, labels: list[str], most: int = 20) -> DataFrame:
    """GRF-1 with labels, for all starts (id) at once: start, label, nearest and depth of the nearest node of each label at most `most` steps up
    (against the edges), the smallest id of several.

    Labelled nodes send (depth, smallest id) down the edges; a node takes the first that comes, the least of its round, and sends that
    on, so the work is edges times rounds, whatever the number of starts. Starts that have the label themselves, whose own
    place may hide another's, are walked from one by one by `related`."""
    own = stored(nodes.filter(F.col("label").isin(labels)).select(F.col("id").alias("node"), "label").distinct(), "labelled")
    steps = stored(edges.select(F.col("src").alias("f"), F.col("dst").alias("node")).distinct(), "steps")
    front, given = own.withColumn("nearest", F.col("node")), []
    seen = own
    for depth in range(1, most + 1):
        sent = front.withColumnRenamed("node", "f").join(steps, "f").groupBy("node", "label").agg(F.min("nearest").alias("nearest"))
        front = stored(sent.join(seen, ["node", "label"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node", "label"))
        given.append(front.withColumn("depth", F.lit(depth)))
    asked = start.select(F.col("id").alias("start")).distinct()
    reached = reduce(DataFrame.unionByName, given) if given else own.withColumn("nearest", F.col("node")).withColumn("depth", F.lit(0)).limit(0)
    out = asked.join(reached, F.col("start") == F.col("node")).select("start", "label", "nearest", "depth")
    themselves = stored(asked.join(own, F.col("start") == F.col("node")).select("start", "label"), "themselves")
    for label in labels:
        few = themselves.filter(F.col("label") == label).select(F.col("start").alias("id"))
        if not few.isEmpty():
            walked = related(edges, few, "in", 1, most, nodes=nodes, label=label)
            first = walked.groupBy("start").agg(F.min(F.struct("depth", "node")).alias("m"))
            out = out.unionByName(first.select("start", F.lit(label).alias("label"), F.col("m.node").alias("nearest"), F.col("m.depth").alias("depth")))
    return out


def _of_spec(nodes: DataFrame, label: str, props: dict[str, str] | None) -> DataFrame:
    out = nodes.filter(F.col("label") == label)
    for k, v in (props or {}).items():
        out = out.filter(F.try_element_at("props", F.lit(k)) == v)
    return out.select("id").distinct()


def chain_ends(pointers: DataFrame) -> DataFrame:
    """id, end and steps for every row of pointers (id, next or null): the end of its chain and the pointers followed; both null where the chain is a cycle.

    Pointer doubling: each round doubles every pointer's reach, and is written.
    Rounds go on until none gets further, or until the reach is beyond the
    longest chain possible, when only chains into cycles still move. A pointer
    to an id that has no row ends there."""
    going = stored(pointers.filter("next is not null").select("id", F.col("next").alias("to"), F.lit(1).cast("long").alias("steps")), "pointers")
    reach, longest = 1, going.count()
    while True:
        ahead = going.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        joined = stored(going.join(ahead, "to", "left"), "pointers")
        if reach > longest or joined.filter("further is not null").isEmpty():
            break
        going = joined.select("id", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        reach *= 2
    ended = joined.filter("further is null").select("id", F.col("to").alias("end"), "steps")
    own = pointers.filter("next is null").select("id", F.col("id").alias("end"), F.lit(0).cast("long").alias("steps"))
    return pointers.select("id").join(ended.unionByName(own), "id", "left")


def resolve_files(files: DataFrame, not_symlinks: bool = False) -> DataFrame:
    """GRF-2: file_id and current: the file that the chain of parent (symlink) and moved_to pointers leads to; null in a cycle.

    A file with a parent goes on from there, unless symlinks aren't to be followed; else from where it was moved to."""
    after = F.col("moved_to")
    if not not_symlinks and "parent" in files.columns:
        after = F.coalesce("parent", "moved_to")
    return chain_ends(files.select(F.col("file_id").alias("id"), after.alias("next"))).select(F.col("id").alias("file_id"), F.col("end").alias("current"))


def original_files(files: DataFrame) -> DataFrame:
    """GRF-2 backwards: file_id, original and moves: where the file was before all its moves, and how many they were; a file that
    wasn't moved is its own; null in a cycle. Of several files moved to one place the smallest id counts."""
    before = files.filter("moved_to is not null").groupBy(F.col("moved_to").alias("id")).agg(F.min("file_id").alias("next"))
    ends = chain_ends(files.select(F.col("file_id").alias("id")).join(before, "id", "left"))
    return ends.select(F.col("id").alias("file_id"), F.col("end").alias("original"), F.col("steps").alias("moves"))


def upsert_nodes(nodes: DataFrame, new: DataFrame, unique: str, required: list[str]) -> DataFrame:
    """SET-9: nodes merged with new ones (unique key, props map); new values win; a missing required prop is an error."""
    checked = new
    for k in required:
        has = F.try_element_at("props", F.lit(k)).isNotNull()
        checked = checked.withColumn("props", F.when(has, F.col("props")).otherwise(F.raise_error(F.lit(f"missing {k}")).cast("map<string,string>")))
    n = checked.select(F.col(unique), F.col("props").alias("new_props"))
    joined = nodes.join(n, unique, "full_outer")
    kept = F.map_filter(F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.coalesce(F.array_contains(F.map_keys("new_props"), k), F.lit(False)))
    return joined.select(unique, F.when(F.col("new_props").isNull(), F.col("props")).otherwise(F.map_concat(kept, "new_props")).alias("props"))


def relate(edges: DataFrame, new: DataFrame, selfish: bool = False, replace: bool = False) -> DataFrame:
    """SET-10: edges with new ones; selfish: a target keeps only its new source, replace: a source only its new target, per type."""
    kept = edges
    if selfish:
        kept = kept.join(new.select("dst", "type").distinct(), ["dst", "type"], "left_anti")
    if replace:
        kept = kept.join(new.select("src", "type").distinct(), ["src", "type"], "left_anti")
    return kept.select("src", "dst", "type").unionByName(new.select("src", "dst", "type")).distinct()


def property_history(events: DataFrame) -> DataFrame:
    """SET-11: node, key, vals, valid_from and valid_to (null while current) of events (node, at, key, vals array, replace).

    All events of a node at one time are one change. A key's values are a set;
    where they stay the same no new version begins, and a key that a change
    doesn't mention is carried over, unless it replaces: then it ends there. The
    events of a key, and a node's replacing changes, are windows over that node."""
    rows = events.groupBy("node", "at", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vals")))).alias("vals"))
    dropping = events.filter("replace").select("node", "at").distinct()
    timeline = rows.select("node", "at", "key", "vals").unionByName(dropping.select("node", "at", F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("vals")))
    forward = Window.partitionBy("node").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upcoming = timeline.withColumn("_r", F.when(F.col("key").isNull(), F.col("at"))).groupBy("node", "at").agg(F.max("_r").alias("_r"))
    upcoming = upcoming.withColumn("_own_or_next", F.min("_r").over(forward))
    strictly = Window.partitionBy("node").orderBy("at")
    upcoming = upcoming.withColumn("next_replace", F.lead("_own_or_next").over(strictly)).select("node", "at", "next_replace")
    key = Window.partitionBy("node", "key").orderBy("at")
    spans = rows.join(upcoming, ["node", "at"]).withColumn("end", F.least(F.lead("at").over(key), F.col("next_replace")))
    fresh = ~(F.lag("vals").over(key).eqNullSafe(F.col("vals")) & F.lag("end").over(key).eqNullSafe(F.col("at")))
    spans = spans.withColumn("_new", fresh.cast("int")).withColumn("_island", F.sum("_new").over(key))
    return spans.groupBy("node", "key", "_island").agg(F.any_value("vals").alias("vals"), F.min("at").alias("valid_from"), F.max(F.struct("at", "end"))["end"].alias("valid_to")).drop("_island")


def property_versions(history: DataFrame) -> DataFrame:
    """SET-11: node and valid_from of each version of a node's properties: a time at which some key's values begin or end."""
    begins = history.select("node", "valid_from")
    return begins.unionByName(history.filter("valid_to is not null").select("node", F.col("valid_to").alias("valid_from"))).distinct()


def conform_hierarchy(lanes: DataFrame, desired: DataFrame, key: str, columns: list[str], enforce: bool) -> DataFrame:
    """SET-12: with enforce the desired values where given, else the present ones with the first column that differs."""
    want = desired.select(key, *(F.col(c).alias(f"want_{c}") for c in columns))
    joined = lanes.join(want, key, "left")
    if enforce:
        return joined.select(key, *(F.coalesce(f"want_{c}", c).alias(c) for c in columns))
    differs = F.coalesce(*(F.when(F.col(f"want_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"want_{c}")), F.lit(c)) for c in columns))
    return joined.select(key, *columns, differs.alias("first_difference"))
