"""Registered queries of set operations, graphs, history and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import sets as s
from ..sources.paths import new_dir
from ..streaming import jobs as t
from ..streaming.in_order import rocksdb_state
from .book import Book

QUERIES = Book()
add = QUERIES.add

add("SET-1_union_reads", lambda v: s.union_reads([v.reads.filter(f"row_no % 3 = {i}") for i in range(3)]).groupBy("rname").agg(F.count("*").alias("n"), F.sum("pos").alias("p")), "SELECT rname, count(*) AS n, CAST(sum(pos) AS BIGINT) AS p FROM reads GROUP BY rname")
add("SET-1_merge_batches", lambda v: s.merge_batches(v.files.select("library", "path"), ["library"], 20).groupBy("library", "batch").agg(F.count("*").alias("n"), F.min("path").alias("first")),
    """, b AS (SELECT library, path, (row_number() OVER (PARTITION BY library ORDER BY path) - 1) // 20 AS batch FROM files) SELECT library, batch, count(*) AS n, min(path) AS first FROM b GROUP BY 1, 2""")
for by_layout in (True, False):
    add(f"SET-1_merge_batches_{'by_layout' if by_layout else 'together'}", lambda v, by_layout=by_layout: s.merge_batches(v.files.select("library", "path", (F.col("file_id") % 3 == 0).alias("paired")), ["library"], 7, by_layout).groupBy("library", "layout", "batch").agg(F.count("*").alias("n"), F.min("path").alias("first")),
        f""", f AS (SELECT library, path, {"CASE WHEN file_id % 3 = 0 THEN 'pe' ELSE 'se' END" if by_layout else "CASE WHEN bool_or(file_id % 3 = 0) OVER (PARTITION BY library) THEN 'pe' ELSE 'se' END"} AS layout FROM files), b AS (SELECT *, (row_number() OVER (PARTITION BY library, layout ORDER BY path) - 1) // 7 AS batch FROM f)
            SELECT library, layout, batch, count(*) AS n, min(path) AS first FROM b GROUP BY 1, 2, 3""")
add("SET-2_concat_variants", lambda v: s.concat_variants([v.variants, v.variants.filter("pos % 2 = 0")], True, True), "SELECT chrom, pos, ref, alt FROM variants")
add("SET-3_union_sites", lambda v: s.union_sites([v.genotypes.filter(f"sample = 's{i}'") for i in range(12)]), "SELECT DISTINCT chrom, pos FROM genotypes")
add("SET-5_reconcile_elements", lambda v: s.reconcile_elements(v.files.filter("file_id % 17 <> 0").select(F.array("path", "lane").alias("paths"), "withdrawn"), v.files.filter("file_id % 5 <> 0").select(F.array("lane", "path").alias("paths"))).groupBy("what", "withdrawn").agg(F.count("*").alias("n")),
    """, x AS (SELECT CASE WHEN file_id % 17 = 0 THEN 'new' WHEN file_id % 5 = 0 AND withdrawn THEN 'still withdrawn' WHEN file_id % 5 = 0 THEN 'withdrawn' WHEN withdrawn THEN 'returned' ELSE 'kept' END AS what, file_id % 5 = 0 AS withdrawn FROM files WHERE NOT (file_id % 17 = 0 AND file_id % 5 = 0))
       SELECT what, withdrawn, count(*) AS n FROM x GROUP BY 1, 2""")
_changes = lambda v: s.metadata_changes(v.files, v.files.select("file_id", F.when(F.col("file_id") % 7 == 0, "sX").otherwise(F.col("sample")).alias("sample"), F.when(F.col("file_id") % 10 == 0, "lX").otherwise(F.col("library")).alias("library")), ["library", "sample"])
add("SET-6_metadata_changes", _changes, "SELECT file_id, CASE WHEN file_id % 10 = 0 THEN 'library' ELSE 'sample' END AS changed FROM files WHERE file_id % 10 = 0 OR file_id % 7 = 0")
add("SET-6_elements_to_reset", lambda v: s.elements_to_reset(_changes(v), v.files.groupBy(F.col("lane").alias("element")).agg(F.collect_list("file_id").alias("file_ids"))), "SELECT DISTINCT lane AS element FROM files WHERE file_id % 10 = 0 OR file_id % 7 = 0")
_meta = lambda v, *c: v.files.select("file_id", F.create_map(*c).alias("meta"))
for replace in (True, False):
    rows = """SELECT file_id, concat('a=', CASE WHEN {r} AND file_id % 3 <> 0 THEN lane ELSE sample END, ',b=', library) AS meta FROM files"""
    add(f"SET-7_apply_metadata{'_replace' * replace}", lambda v, replace=replace: s.apply_metadata(_meta(v, F.lit("a"), F.col("sample")), _meta(v, F.lit("a"), F.when(F.col("file_id") % 3 == 0, "").otherwise(F.col("lane")), F.lit("b"), F.col("library")), replace).select("file_id", F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("meta")), rows.format(r="true" if replace else "false"))
add("SET-7_apply_metadata_resolved", lambda v: s.apply_metadata(_meta(v, F.lit("a"), F.col("sample")), v.files.filter("file_id % 2 = 0").select("file_id", F.create_map(F.lit("a"), "lane", F.lit("b"), F.when(F.col("file_id") % 8 == 0, "").otherwise(F.col("library"))).alias("meta")), True, g.resolve_files(v.moves)).select("file_id", F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("meta")),
    """, n AS (SELECT file_id, least(file_id + 3 - file_id % 4, (SELECT count(*) FROM orders) - 1) AS now, lane, CASE WHEN file_id % 8 > 0 THEN library END AS b FROM files WHERE file_id % 2 = 0),
       p AS (SELECT file_id AS f, file_id AS src, lane, b FROM n UNION ALL SELECT now, file_id, lane, b FROM n WHERE now <> file_id), w AS (SELECT f, arg_max(lane, src) AS lane, arg_max(b, src) FILTER (b IS NOT NULL) AS b FROM p GROUP BY f)
       SELECT file_id, concat('a=', coalesce(w.lane, sample), CASE WHEN w.b IS NOT NULL THEN concat(',b=', w.b) ELSE '' END) AS meta FROM files LEFT JOIN w ON w.f = files.file_id""")
add("SET-8_merge_metadata", lambda v: s.merge_metadata(v.file_meta.select("file_id", "key", "val"), v.files.select("file_id", F.lit("sample").alias("key"), F.col("lane").alias("val"))).select("file_id", "key", F.array_join("vals", ",").alias("vals")),
    """, u AS (SELECT file_id, key, val FROM file_meta UNION ALL SELECT file_id, 'sample', lane FROM files) SELECT file_id, key, string_agg(DISTINCT val, ',' ORDER BY val) AS vals FROM u GROUP BY 1, 2""")
_props = lambda *c: F.create_map(*c)
add("SET-9_upsert_nodes", lambda v: g.upsert_nodes(v.nodes.filter("label = 'sample'").select("id", _props(F.lit("seg"), F.col("prop")).alias("props")), v.customer.filter("c_custkey % 2 = 0").select(F.concat(F.lit("c"), (F.col("c_custkey") + 500).cast("string")).alias("id"), _props(F.lit("seg"), F.lit("NEW"), F.lit("x"), F.lit("1")).alias("props")), "id", ["seg"]).select("id", F.col("props")["seg"].alias("seg"), F.try_element_at("props", F.lit("x")).alias("x")),
    """, n AS (SELECT concat('c', c_custkey + 500) AS id FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT concat('c', c_custkey) AS id, c_mktsegment AS seg FROM customer)
       SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'NEW' ELSE seg END AS seg, CASE WHEN n.id IS NOT NULL THEN '1' END AS x FROM o FULL JOIN n ON o.id = n.id""")
_new = lambda v: v.orders.filter("o_orderkey % 10 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), (F.col("o_orderkey") % 100).cast("string")).alias("dst"), F.lit("lane_of").alias("type"))
add("SET-10_relate_replace", lambda v: g.relate(v.edges, _new(v), replace=True).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets")),
    """, n AS (SELECT concat('o', o_orderkey) AS src, concat('c', o_orderkey % 100) AS dst, 'lane_of' AS type FROM orders WHERE o_orderkey % 10 = 0),
       r AS (SELECT * FROM edges WHERE (src, type) NOT IN (SELECT src, type FROM n) UNION SELECT * FROM n) SELECT type, count(*) AS n, count(DISTINCT dst) AS targets FROM r GROUP BY type""")
add("SET-10_relate_selfish", lambda v: g.relate(v.edges, _new(v), selfish=True).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources")),
    """, n AS (SELECT concat('o', o_orderkey) AS src, concat('c', o_orderkey % 100) AS dst, 'lane_of' AS type FROM orders WHERE o_orderkey % 10 = 0),
       r AS (SELECT * FROM edges WHERE (dst, type) NOT IN (SELECT dst, type FROM n) UNION SELECT * FROM n) SELECT type, count(*) AS n, count(DISTINCT src) AS sources FROM r GROUP BY type""")
_history = lambda v, replace: v.step_facts.select(F.col("setup").alias("node"), (F.floor(F.col("fact_id") / 50)).alias("at"), F.col("step").alias("key"), F.array((F.col("time_s") % 2).cast("string")).alias("vals"), F.lit(replace).alias("replace"))
HISTORY = """b AS (SELECT DISTINCT setup AS node, fact_id // 50 AS tm FROM step_facts), m AS (SELECT setup AS node, fact_id // 50 AS tm, step AS key, array_to_string(list_sort(list(DISTINCT CAST(time_s % 2 AS STRING))), '+') AS vals FROM step_facts GROUP BY 1, 2, 3), k AS (SELECT DISTINCT node, key FROM m),
    s AS (SELECT b.node, k.key, b.tm, {state} AS vals FROM b JOIN k ON k.node = b.node LEFT JOIN m ON m.node = b.node AND m.key = k.key AND m.tm = b.tm),
    c AS (SELECT *, lag(vals) OVER (PARTITION BY node, key ORDER BY tm) AS prev FROM s), d AS (SELECT *, lead(tm) OVER (PARTITION BY node, key ORDER BY tm) AS next FROM c WHERE vals IS DISTINCT FROM prev)"""
CARRIED, REPLACED = "last_value(m.vals IGNORE NULLS) OVER (PARTITION BY b.node, k.key ORDER BY b.tm)", "m.vals"
for replace, state in ((False, CARRIED), (True, REPLACED)):
    add(f"SET-11_property_history{'_replace' * replace}", lambda v, replace=replace: g.property_history(_history(v, replace)).withColumn("vals", F.array_join("vals", "+")), f", {HISTORY.format(state=state)} SELECT node, key, vals, tm AS valid_from, next AS valid_to FROM d WHERE vals IS NOT NULL")
add("SET-11_property_versions", lambda v: g.property_versions(g.property_history(_history(v, True))), f", {HISTORY.format(state=REPLACED)} SELECT DISTINCT node, tm AS valid_from FROM d")
for enforce, sql in ((True, "SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'sX' ELSE sample END AS sample, library FROM files"),
                     (False, "SELECT file_id, sample, library, CASE WHEN file_id % 4 = 0 THEN 'sample' END AS first_difference FROM files")):
    add(f"SET-12_conform_hierarchy{'_enforced' * enforce}", lambda v, enforce=enforce: g.conform_hierarchy(v.files.select("file_id", "sample", "library"), v.files.filter("file_id % 2 = 0").select("file_id", F.when(F.col("file_id") % 4 == 0, "sX").otherwise(F.col("sample")).alias("sample"), "library"), "file_id", ["sample", "library"], enforce), sql)
add("GRF-1_related", lambda v: g.related(v.edges, v.nodes.filter("label = 'lane'").select("id"), "out", 1, 3).groupBy("depth", "node").agg(F.count("*").alias("n")),
    """SELECT CAST(1 AS INT) AS depth, concat('c', o_custkey) AS node, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT CAST(2 AS INT) AS depth, concat('n', c_nationkey) AS node, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 2
       UNION ALL SELECT 3, concat('r', n_regionkey), count(*) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 2""")
# chains of 30 files, each made from the one before: every tenth link is of another kind
_chain = lambda v: v.files.filter("file_id % 30 > 0").select((F.col("file_id") - 1).cast("string").alias("src"), F.col("file_id").cast("string").alias("dst"), F.when(F.col("file_id") % 10 == 0, "copied").otherwise("made").alias("type"))
_chain_nodes = lambda v: v.files.select(F.col("file_id").cast("string").alias("id"), F.when(F.col("file_id") % 6 == 0, "Lane").otherwise("File").alias("label"), F.create_map(F.lit("status"), "status").alias("props"))
_thirtieth = lambda v, k: v.files.filter(f"file_id % 30 = {k}").select(F.col("file_id").cast("string").alias("id"))
add("GRF-1_related_twenty_deep", lambda v: g.related(_chain(v), _thirtieth(v, 25), "in", 1, 20).groupBy("depth").agg(F.count("*").alias("n")), "SELECT CAST(d AS INT) AS depth, count(*) AS n FROM files f JOIN (SELECT unnest(range(1, 21)) AS d) ON true JOIN files g ON g.file_id = f.file_id - d WHERE f.file_id % 30 = 25 AND (SELECT count(*) FROM files h WHERE h.file_id BETWEEN f.file_id - d AND f.file_id) = d + 1 GROUP BY 1")
add("GRF-1_related_with_label", lambda v: g.related(_chain(v), _thirtieth(v, 25), "in", 1, 20, nodes=_chain_nodes(v), label="Lane", props={"status": "O"}).select("start", "node", "depth"),
    """, s AS (SELECT f.file_id AS f, g.file_id AS n, f.file_id - g.file_id AS d, (SELECT count(*) FROM files h WHERE h.file_id BETWEEN g.file_id AND f.file_id) AS c FROM files f JOIN files g ON g.file_id < f.file_id AND g.file_id >= f.file_id - 20 WHERE f.file_id % 30 = 25 AND g.file_id % 6 = 0 AND g.status = 'O')
       SELECT CAST(f AS STRING) AS start, CAST(n AS STRING) AS node, CAST(d AS INT) AS depth FROM s WHERE c = d + 1 QUALIFY d = min(d) OVER (PARTITION BY f)""")
add("GRF-1_related_by_types_to_ends", lambda v: g.related(_chain(v), _thirtieth(v, 12), "out", 1, 20, edge_type="made|other", ends=True).select("start", "node"),
    """, s AS (SELECT f.file_id AS f, g.file_id AS n, (SELECT count(*) FROM files h WHERE h.file_id BETWEEN f.file_id AND g.file_id) AS c FROM files f JOIN files g ON g.file_id > f.file_id AND g.file_id <= f.file_id + 7 WHERE f.file_id % 30 = 12) SELECT CAST(f AS STRING) AS start, CAST(max(n) AS STRING) AS node FROM s WHERE c = n - f + 1 GROUP BY f""")
add("GRF-1_related_in", lambda v: g.related(v.edges, v.nodes.filter("label = 'study'").select("id"), "in", 1, 3, None).groupBy("start", "depth").agg(F.count("*").alias("n")),
    """SELECT concat('r', n_regionkey) AS start, 1 AS depth, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT concat('r', n_regionkey), 2, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
       UNION ALL SELECT concat('r', n_regionkey), 3, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
add("GRF-1_nearest_related", lambda v: g.related(v.edges, v.nodes.filter("label = 'sample'").select("id"), "out", 1, 20, nodes=v.nodes, label="study").groupBy("node").agg(F.count("*").alias("n")),
    "SELECT concat('r', n_regionkey) AS node, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
add("GRF-1_ends_only", lambda v: g.related(v.edges, v.nodes.filter("label = 'sample'").select("id"), "out", 1, 2, ends=True).groupBy("node").agg(F.count("*").alias("n")),
    "SELECT concat('r', n_regionkey) AS node, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
add("GRF-2_resolve_files", lambda v: g.resolve_files(v.moves), "SELECT file_id, least(file_id + 3 - file_id % 4, (SELECT count(*) FROM orders) - 1) AS current FROM moves")
# symlinks lead one file back, and then on by its moves; every hundredth file is in a cycle of two
_linked = lambda v: v.moves.select("file_id", "moved_to", F.when(F.col("file_id") % 100 == 50, F.col("file_id") - 1).when(F.col("file_id") % 100 == 49, F.col("file_id") + 1).when(F.col("file_id") % 10 == 7, F.col("file_id") - 1).alias("parent"))
add("GRF-2_resolve_symlinks", lambda v: g.resolve_files(_linked(v)),
    """, nx AS (SELECT file_id, CASE WHEN file_id % 100 = 50 THEN file_id - 1 WHEN file_id % 100 = 49 THEN file_id + 1 WHEN file_id % 10 = 7 THEN file_id - 1 ELSE moved_to END AS nx FROM moves),
       w AS (SELECT file_id, file_id AS at, 0 AS d FROM nx UNION ALL SELECT w.file_id, nx.nx, d + 1 FROM w JOIN nx ON nx.file_id = w.at WHERE nx.nx IS NOT NULL AND d < 20),
       e AS (SELECT w.file_id, max(w.at) FILTER (nx.nx IS NULL) AS current FROM w LEFT JOIN nx ON nx.file_id = w.at GROUP BY w.file_id) SELECT file_id, current FROM e""")
add("GRF-2_original_files", lambda v: g.original_files(v.moves),
    """SELECT file_id, file_id - CASE WHEN file_id % 4 = 0 THEN 0 ELSE d END AS original, CAST(CASE WHEN file_id % 4 = 0 THEN 0 ELSE d END AS BIGINT) AS moves FROM (SELECT m.file_id, m.file_id - coalesce(min(p.file_id), m.file_id) AS d FROM moves m LEFT JOIN moves p ON p.file_id < m.file_id AND p.file_id >= m.file_id - m.file_id % 4
         AND (SELECT count(*) FROM moves q WHERE q.file_id >= p.file_id AND q.file_id < m.file_id AND q.moved_to = q.file_id + 1) = m.file_id - p.file_id GROUP BY m.file_id)""")
add("SNK-3_check_row_counts", lambda v: s.check_row_counts(v.variants, v.variants.withColumn("filter", F.lit("PASS"))).select("chrom", "pos", "filter"), "SELECT chrom, pos, 'PASS' AS filter FROM variants")

add("STR-1_source_changed", lambda v: t.source_changed(v.files.filter("file_id % 11 <> 0").select(F.array("path").alias("paths"), "withdrawn"), v.files.filter("file_id % 13 <> 0").select(F.array("path").alias("paths"))).groupBy("what").agg(F.count("*").alias("n")),
    """, x AS (SELECT CASE WHEN file_id % 11 = 0 THEN 'new' WHEN file_id % 13 = 0 THEN CASE WHEN withdrawn THEN 'still' ELSE 'withdrawn' END WHEN withdrawn THEN 'returned' ELSE 'kept' END AS what FROM files WHERE NOT (file_id % 11 = 0 AND file_id % 13 = 0)) SELECT what, count(*) AS n FROM x WHERE what NOT IN ('still', 'kept') GROUP BY what""")


def _polled(v):
    """New lists in a folder, taken by a stream and reconciled with what is known of every eleventh file's absence."""
    folder, check, out = (new_dir(v.spark, f"poll-{x}") for x in ("in", "check", "out"))
    v.files.filter("file_id % 13 <> 0").select("path").write.text(folder)
    known = v.files.filter("file_id % 11 <> 0").select(F.lit("").alias("source"), "path", "withdrawn")
    t.poll_source(v.spark, folder, check, out, known, r"()[^/]*$")
    return t.polled_changes(v.spark, out).groupBy("what", "withdrawn").agg(F.count("*").alias("n"))


add("STR-1_poll_source", _polled,
    """, x AS (SELECT CASE WHEN file_id % 11 = 0 THEN 'new' WHEN file_id % 13 = 0 THEN CASE WHEN withdrawn THEN 'still withdrawn' ELSE 'withdrawn' END WHEN withdrawn THEN 'returned' ELSE 'kept' END AS what, file_id % 13 = 0 AS withdrawn FROM files WHERE NOT (file_id % 11 = 0 AND file_id % 13 = 0)) SELECT what, withdrawn, count(*) AS n FROM x GROUP BY 1, 2""")


def _polled_thrice(v):
    """Three arrivals of lists: four sources; three more; then a rewritten list, an unchanged one, and one of an earlier version. Each is taken a file a batch."""
    folder, check, out = (new_dir(v.spark, f"poll-{x}") for x in ("in", "check", "out"))
    of = v.files.select((F.col("file_id") % 7).alias("source"), "file_id", "path")
    arrivals = [
        [(of.filter("source < 4 and file_id % 11 <> 0"), 1)],
        [(of.filter("source >= 4"), 1)],
        [(of.filter("source = 0 and file_id % 13 <> 0"), 2), (of.filter("source = 4"), 2), (of.filter("source = 1 and file_id % 2 = 0"), 0)],
    ]
    for lists in arrivals:
        for rows, version in lists:
            rows.repartition(7, "source").withColumn("version", F.lit(version)).select("source", "version", "path").write.mode("append").partitionBy("source", "version").text(folder)
        t.poll_source(v.spark, folder, check, out, named=r"source=([^/]+)/version=(\d+)/[^/]+$", most_files=1)
    return t.polled_elements(v.spark, out).select(F.col("source").cast("long").alias("source"), "path", "withdrawn")


add("STR-1_poll_three_batches", _polled_thrice,
    "SELECT CAST(file_id % 7 AS BIGINT) AS source, path, file_id % 7 = 0 AND file_id % 13 = 0 AS withdrawn FROM files WHERE CASE WHEN file_id % 7 = 0 THEN file_id % 11 <> 0 OR file_id % 13 <> 0 WHEN file_id % 7 < 4 THEN file_id % 11 <> 0 ELSE true END")
REPEATS = ", l AS (SELECT event_id, subject, message, lag(message) OVER (PARTITION BY subject ORDER BY ts, event_id) AS p FROM messages) SELECT event_id, subject, message FROM l WHERE p IS NULL OR p <> message"
add("STR-2_suppress_repeats", lambda v: t.suppress_repeats(v.messages).select("event_id", "subject", "message"), REPEATS)


def _streamed(v, name: str, plan, schema_from) -> object:
    """Runs a streaming plan over a written copy of a view to its end, and reads what it wrote."""
    source, out, check = (new_dir(v.spark, f"{name}-{x}") for x in ("in", "out", "check"))
    schema_from.write.parquet(source)
    stream = plan(v.spark.readStream.schema(schema_from.schema).parquet(source))
    q = stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(out)


def _shuffled(v, name: str, plan, days: int = 6) -> object:
    """Runs a stream over the messages in files of some days each, every third of whose rows come a file later, and last
    an event of a subject of its own, long after all others, so that the watermark passes them."""
    source, out, check = (new_dir(v.spark, f"{name}-{x}") for x in ("in", "out", "check"))
    rows = v.messages.withColumn("ts", F.col("ts").cast("timestamp"))
    first, last, n = rows.agg(F.date_trunc("day", F.min("ts")), F.max("ts"), F.count("*")).first()
    span = F.floor((F.unix_seconds("ts") - F.lit(int(first.timestamp()))) / (days * 86400)).cast("int")
    files = (last - first).days // days + 2
    # a file is as many parts as tasks write it, and a batch takes as many
    parts = max(1, min(n // files // 50_000, int(v.spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("_file", F.greatest(F.lit(0), F.least(F.lit(files - 1), span + (F.col("event_id") % 3 == 0).cast("int"))))
    for i in range(files):
        one = dealt.filter(F.col("_file") == i).drop("_file")
        (one.repartition(parts) if parts > 1 else one.coalesce(1)).write.mode("append").parquet(source)
    rows.limit(0).unionByName(v.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).alias("subject").cast(rows.schema["subject"].dataType), F.lit("end").alias("message"), (F.lit(last) + F.expr(f"interval {4 * days} days")).alias("ts"))).coalesce(1).write.mode("append").parquet(source)
    stream = plan(v.spark.readStream.option("maxFilesPerTrigger", parts).schema(rows.schema).parquet(source))
    with rocksdb_state(v.spark):
        q = stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(out).filter("subject <> -1")


add("STR-2_suppress_repeats_stream", lambda v: _shuffled(v, "repeats", lambda df: t.suppress_repeats_stream(df, "14 days")), REPEATS)
IDLE = ", l AS (SELECT event_id, subject, message, ts, lag(message) OVER w AS p, lag(ts) OVER w AS p_ts FROM messages WINDOW w AS (PARTITION BY subject ORDER BY ts, event_id)) SELECT event_id, subject, message FROM l WHERE p IS NULL OR p <> message OR ts - p_ts >= INTERVAL 12 HOUR"
add("STR-2_suppress_repeats_idle", lambda v: t.suppress_repeats(v.messages, idle="12 hours").select("event_id", "subject", "message"), IDLE)
add("STR-2_suppress_repeats_idle_stream", lambda v: _shuffled(v, "idle", lambda df: t.suppress_repeats_stream(df, "14 days", "12 hours")), IDLE)
add("STR-3_log_search", lambda v: t.log_search(v.messages, ["c%", "%rr%"], list(range(50)), "2024-01-01 00:00:00", "2024-01-20 00:00:00").select("event_id"),
    "SELECT event_id FROM messages WHERE (message LIKE 'c%' OR message LIKE '%rr%') AND subject < 50 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20'")
_at = lambda df: df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
ROLLING = "count(*) AS n, round(avg(time_s), 0) AS mean, round(stddev_pop(time_s), 0) AS sd, max(time_s) AS most, CAST(sum(time_s) AS BIGINT) AS total"
add("STR-4_rolling_step_stats", lambda v: _at(t.rolling_step_stats(v.step_facts)), f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, step, {ROLLING} FROM step_facts GROUP BY 1, 2")
add("STR-4_rolling_setup_stats", lambda v: _at(t.rolling_step_stats(v.step_facts, by="setup")), f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, setup, {ROLLING} FROM step_facts GROUP BY 1, 2")
add("STR-4_sliding_overall_stats", lambda v: _at(t.rolling_step_stats(v.step_facts, window="2 hours", slide="1 hour", by="overall")), f", x AS (SELECT date_trunc('hour', ts) AS w, time_s FROM step_facts UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, time_s FROM step_facts) SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, {ROLLING} FROM x GROUP BY 1")
add("STR-4_rolling_step_stats_stream", lambda v: _streamed(v, "rolling", lambda df: t.rolling_step_stats(df, late="10 minutes"), v.step_facts).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).groupBy("step").agg(F.countDistinct("window_start").alias("windows")),
    ", h AS (SELECT step, date_trunc('hour', ts) AS w FROM step_facts WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM step_facts) - INTERVAL 10 MINUTE) SELECT step, count(DISTINCT w) AS windows FROM h GROUP BY step")
add("STR-5_throttled_refresh", lambda v: t.throttled_refresh(v.messages).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")),
    "SELECT subject, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, arg_min(event_id, (ts, event_id)) AS event_id FROM messages GROUP BY 1, 2")
REFRESHES = ", g AS (SELECT subject, min((ts, event_id)) AS e FROM messages GROUP BY subject UNION ALL SELECT g.subject, (SELECT min((m.ts, m.event_id)) FROM messages m WHERE m.subject = g.subject AND m.ts >= g.e[1] + INTERVAL 24 HOUR) FROM g WHERE g.e IS NOT NULL) SELECT m.event_id, m.subject, m.message FROM messages m JOIN g ON g.subject = m.subject AND g.e[2] = m.event_id"
add("STR-5_refreshes_since_last", lambda v: t.refreshes_since_last(v.messages), REFRESHES)
add("STR-5_refreshes_stream", lambda v: _shuffled(v, "refreshes", lambda df: t.refreshes_stream(df, late="14 days")), REFRESHES)
