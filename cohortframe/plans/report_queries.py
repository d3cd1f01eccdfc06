"""Registered queries of reports and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import projections as p
from ..operators import reports as r
from ..operators.graph import resolve_files
from ..sources import text as t
from ..sources.paths import new_dir
from .book import Book

QUERIES = Book()
add = QUERIES.add

_str = lambda c: F.col(c).cast("string")

add("JON-19_sequencing_hierarchy", lambda v: r.sequencing_hierarchy(v.lab_nodes, v.lab_edges, v.orders.select(F.concat(F.lit("Q"), _str("o_orderkey")).alias("id"))),
    """SELECT concat('Q', o_orderkey) AS start, CASE WHEN o_orderkey % 5 = 0 THEN 'section' ELSE 'lane' END AS kind, concat(CASE WHEN o_orderkey % 5 = 0 THEN 'S' ELSE 'L' END, o_orderkey) AS lane, concat(CASE WHEN o_orderkey % 5 = 0 THEN 'K' ELSE 'B' END, o_custkey) AS library,
       concat('C', o_custkey) AS sample, CASE o_custkey % 3 WHEN 0 THEN 'Gf' WHEN 1 THEN 'Gm' END AS gender, concat('T', c_nationkey) AS taxon, CASE WHEN o_custkey % 4 = 0 THEN concat('R9', o_custkey % 5) WHEN o_custkey % 7 <> 0 THEN concat('R', c_nationkey) END AS study, concat('D', o_custkey % 200) AS donor
       FROM orders JOIN customer ON c_custkey = o_custkey""")
add("JON-19_preferred_study", lambda v: r.sequencing_hierarchy(v.lab_nodes, v.lab_edges, v.orders.select(F.concat(F.lit("F"), _str("o_orderkey")).alias("id")), only_preferred=True).groupBy("kind", "study").agg(F.count("*").alias("n")),
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'section' ELSE 'lane' END AS kind, CASE WHEN o_custkey % 4 = 0 THEN concat('R9', o_custkey % 5) END AS study, count(*) AS n FROM orders GROUP BY 1, 2""")
add("JON-20_donor_gender_check", lambda v: r.donor_gender_check(v.samples, v.samples.select("sample", F.lit("expected").alias("source"), "gender").unionByName(v.samples.filter("sample_id % 2 = 0").select("sample", F.lit("measured").alias("source"), F.lit("male").alias("gender")))),
    "SELECT donor, sample, gender AS expected, CASE WHEN sample_id % 2 = 0 THEN 'male' END AS measured FROM samples WHERE NOT qc_failed")


def _results(v):
    """Of every sample an outdated and a later result of both types, with the samples 20 after and 20 before it."""
    other = lambda d, disc: F.create_map(F.concat(F.lit("k"), (F.col("sample_id") + min(d, 0)).cast("string")), F.array((F.col("sample_id") + min(d, 0)).cast("string") if disc is None else F.lit(disc), (F.col("sample_id") % 30 if d > 0 else (F.col("sample_id") - 20) % 30).cast("string"), F.lit("2.5"), F.concat(F.lit("s"), (F.col("sample_id") + d).cast("string"))))
    cns = lambda disc: F.to_json(F.map_concat(other(20, disc), other(-20, disc)))
    kinds = F.explode(F.array(F.lit("genotype"), F.lit("fluidigm"))).alias("type")
    return v.cohort.select("sample", kinds, F.lit(1).alias("date"), cns("999").alias("cns"), "sample_id").unionByName(v.cohort.select("sample", kinds, F.lit(2).alias("date"), cns(None).alias("cns"), "sample_id"))


_studies = lambda v: v.cohort.select("sample", "study_id").unionByName(v.cohort.filter("sample_id % 5 = 0").select("sample", F.lit(99).alias("study_id")))
DISCORDANCE = """m AS (SELECT *, CASE WHEN sample_id % 5 = 0 THEN concat(study_id, ',99') ELSE CAST(study_id AS STRING) END AS study FROM cohort), e AS (SELECT donor, study, count(*) AS c FROM m GROUP BY 1, 2), l AS (SELECT donor, arg_min(study, (-c, study)) AS largest, count(*) AS sets FROM e GROUP BY donor),
    q AS (SELECT x.donor, CAST(x.sample_id AS DOUBLE) AS discordance, CAST(x.sample_id % 30 AS BIGINT) AS sites, 2.5::DOUBLE AS avg_min_depth, (x.study, NOT x.control, x.public_name, x.sample) <= (y.study, NOT y.control, y.public_name, y.sample) AS xy, x.sample AS xs, x.public_name AS xp, x.control AS xc, x.study AS xt, y.sample AS ys, y.public_name AS yp, y.control AS yc, y.study AS yt, largest, sets
      FROM m x JOIN m y ON y.sample_id = x.sample_id + 20 JOIN l ON l.donor = x.donor WHERE NOT x.qc_failed AND NOT y.qc_failed)
    SELECT donor, discordance, sites, avg_min_depth, CASE WHEN xy THEN xs ELSE ys END AS sample1, CASE WHEN xy THEN xp ELSE yp END AS public_name1, CASE WHEN xy THEN xc ELSE yc END AS control1, CASE WHEN xy THEN xt ELSE yt END AS study1,
      CASE WHEN xy THEN ys ELSE xs END AS sample2, CASE WHEN xy THEN yp ELSE xp END AS public_name2, CASE WHEN xy THEN yc ELSE xc END AS control2, CASE WHEN xy THEN yt ELSE xt END AS study2 FROM q"""
add("JON-21_donor_discordance", lambda v: r.donor_discordance(_results(v), v.cohort, _studies(v)), f", {DISCORDANCE}")
add("JON-21_donor_discordance_fluidigm", lambda v: r.donor_discordance(_results(v), v.cohort, _studies(v), "fluidigm"), f", {DISCORDANCE} WHERE sets = 1 OR (xt = largest AND yt = largest) OR ((xt = largest OR yt = largest) AND xp = yp)")
_groups = lambda v: v.cohort.select(F.concat(F.lit("g"), (F.col("study_id") % 2).cast("string")).alias("name"), "study_id").distinct().unionByName(v.cohort.select(F.lit("all_studies").alias("name"), "study_id").distinct())
add("JON-21_sample_discordance", lambda v: r.sample_discordance(_results(v), v.cohort, _studies(v), _groups(v), v.cohort.select("sample")).drop("rank"),
    """, p AS (SELECT x.sample, y.sample AS other, CAST(least(x.sample_id, y.sample_id) AS DOUBLE) AS discordance, CAST(least(x.sample_id, y.sample_id) % 30 AS BIGINT) AS sites, 2.5::DOUBLE AS avg_min_depth, y.public_name, y.control, y.donor, x.study_id % 2 = y.study_id % 2 AS near FROM cohort x JOIN cohort y ON abs(x.sample_id - y.sample_id) = 20 WHERE NOT y.qc_failed)
       SELECT sample, other, discordance, sites, avg_min_depth, public_name, control, donor FROM p WHERE near""")
add("JON-21_sample_discordance_order", lambda v: r.sample_discordance(_results(v), v.cohort, _studies(v), _groups(v), v.cohort.select("sample")).groupBy("sample").agg(F.min_by("other", "rank").alias("first")),
    """, p AS (SELECT x.sample, y.sample AS other, least(x.sample_id, y.sample_id) AS d, least(x.sample_id, y.sample_id) % 30 AS s, y.public_name, y.control FROM cohort x JOIN cohort y ON abs(x.sample_id - y.sample_id) = 20 WHERE NOT y.qc_failed AND x.study_id % 2 = y.study_id % 2)
       SELECT sample, arg_min(other, (NOT (d < 3 AND s > 15), d - s, NOT control, public_name, other)) AS first FROM p GROUP BY sample""")

# copy numbers: every sample has an outdated result and one with a region where its number is even
_cnvs = lambda v: v.cohort.select("sample", F.lit(1).alias("date"), F.lit('{"ND":"99"}').alias("data")).unionByName(v.cohort.select("sample", F.lit(2).alias("date"), F.concat(F.lit('{"ND":"'), _str("sample_id"), F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit('","RG":[{"chr":"'), (F.col("sample_id") % 3).cast("string"), F.lit('","start":5,"end":'), (F.col("sample_id") + 10).cast("string"), F.lit(',"length":6,"quality":"8.5","cn":"3"}]}'))).otherwise(F.lit('"}'))).alias("data")))
_loh = lambda v: v.cohort.filter("sample_id % 3 = 0").select("sample", F.lit(1).alias("date"), F.concat(F.lit('[{"chr":"7","start":1,"end":'), _str("sample_id"), F.lit(',"count":"4","type":"SNPs"}]')).alias("data"))
_plots = lambda v: v.cohort.select("donor", F.concat(F.lit("/p/"), "sample").alias("path"), F.explode(F.array(F.lit("0"), F.lit("5"))).alias("chrom"), F.concat_ws("_", "public_name", "sample").alias("query_sample"), F.lit("ctl").alias("control_sample")).unionByName(v.cohort.select("donor", F.concat(F.lit("/all/"), "donor").alias("path"), *(F.lit(None).cast("string").alias(c) for c in ("chrom", "query_sample", "control_sample"))).distinct())
add("JON-22_donor_cnv_report", lambda v: r.donor_cnv_report(v.cohort, _cnvs(v), _loh(v), _plots(v)).select("type", "donor", "name", "key", "value", "chrom", F.col("start").alias("a"), F.col("end").alias("b"), "cn", "graph", "control_sample"),
    """, c AS (SELECT *, concat(public_name, '_', sample) AS name, concat('/p/', sample) AS g FROM cohort WHERE NOT qc_failed), done AS (SELECT DISTINCT donor, CAST(sample_id % 3 AS STRING) AS chrom FROM c WHERE sample_id % 2 = 0)
       SELECT 'copy_number_plot' AS type, donor, NULL AS name, NULL AS key, NULL AS value, NULL AS chrom, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL AS cn, concat('/all/', donor) AS graph, NULL AS control_sample FROM cohort GROUP BY donor
       UNION ALL SELECT 'copy_number_summary', donor, name, 'ND', CAST(sample_id AS STRING), NULL, NULL, NULL, NULL, NULL, NULL FROM c
       UNION ALL SELECT 'aberrant_regions', donor, name, NULL, NULL, CAST(sample_id % 3 AS STRING), 5, sample_id + 10, '3', CASE WHEN sample_id % 3 = 0 THEN g END, NULL FROM c WHERE sample_id % 2 = 0
       UNION ALL SELECT 'loh_calls', donor, name, NULL, '4', '7', 1, sample_id, NULL, NULL, 'ctl' FROM c WHERE sample_id % 3 = 0
       UNION ALL SELECT 'aberrant_polysomy', donor, name, NULL, NULL, '5', NULL, NULL, NULL, g, NULL FROM c UNION ALL SELECT 'aberrant_polysomy', donor, name, NULL, NULL, '0', NULL, NULL, NULL, g, NULL FROM c WHERE (donor, '0') NOT IN (SELECT donor, chrom FROM done)""")
add("JON-23_donor_pluritest_report", lambda v: r.donor_pluritest_report(v.cohort, v.cohort.select("sample", F.lit(1).alias("date"), F.lit('{"old":"1"}').alias("data")).unionByName(v.cohort.select("sample", F.lit(2).alias("date"), F.concat(F.lit('{"pluri - raw":"'), _str("sample_id"), F.lit('"}')).alias("data"))),
    v.cohort.filter("donor <> 'd3'").select("donor", F.concat(F.lit("/x/"), "sample").alias("path"), F.when(F.col("sample_id") % 2 == 0, "novelty").otherwise("clustering").alias("type"), (F.col("sample_id") % 4).alias("size"))).withColumn("control", F.when(F.col("control"), "yes").when(~F.col("control"), "no")),
    """SELECT 'pluritest_plot' AS type, donor, concat('/x/', sample) AS path, CASE WHEN sample_id % 2 = 0 THEN 2 ELSE 4 END AS "order", CASE WHEN sample_id % 2 = 0 THEN 'big' ELSE 'small' END AS display_size, NULL AS name, NULL AS control, NULL AS key, NULL AS value FROM cohort
         WHERE donor <> 'd3' AND sample_id % 4 > 0 AND donor IN (SELECT donor FROM cohort WHERE NOT qc_failed)
       UNION ALL SELECT 'pluritest_summary', donor, NULL, NULL, NULL, concat(public_name, '_', sample), CASE WHEN control THEN 'yes' ELSE 'no' END, 'pluri_raw', CAST(sample_id AS STRING) FROM cohort WHERE donor <> 'd3' AND NOT qc_failed""")
add("JON-24_sample_status", lambda v: r.sample_status(v.cohort, v.cohort.select("sample", F.lit("failed_by").alias("type"), F.concat(F.lit("u"), _str("study_id")).alias("username"), (F.col("sample_id") * 86400).alias("time"), F.lit("low").alias("reason"))
    .unionByName(v.cohort.select("sample", F.lit("failed_by").alias("type"), F.lit("old").alias("username"), F.lit(-1).cast("long").alias("time"), F.lit("none").alias("reason"))).unionByName(v.cohort.filter("sample_id % 8 = 0").select("sample", F.lit("selected_by").alias("type"), F.lit("me").alias("username"), F.lit(86400).cast("long").alias("time"), F.lit(None).cast("string").alias("reason")))),
    """SELECT sample, public_name, CASE WHEN qc_failed THEN 'failed' WHEN qc_selected THEN 'selected' ELSE 'pending' END AS status, CASE WHEN qc_failed THEN concat('u', study_id) WHEN sample_id % 8 = 0 THEN 'me' END AS qc_by,
       CASE WHEN qc_failed THEN strftime(make_timestamp(sample_id * 86400000000), '%Y-%m-%d') WHEN sample_id % 8 = 0 THEN '1970-01-02' END AS qc_day, 'low' AS reason FROM cohort""")

_index = lambda v: v.index_rows.withColumns({"center_name": F.lit("sc"), "study_id": F.concat(F.lit("st"), (F.col("row_no") % 1500 % 4).cast("string")), "population": F.lit("GBR")})
_release = lambda v: _index(v).filter("withdrawn = 0").select(F.col("sample_name").alias("sample"), F.col("instrument_platform").alias("platform"), "analysis_group").distinct().select(F.concat_ws("/", "sample", "platform", "analysis_group").alias("file_id"), "sample", "platform", "analysis_group", F.when(F.col("sample").endswith("7"), "X").otherwise("GBR").alias("population"), F.lit(5).alias("reads"), F.when(F.col("sample").endswith("3"), 4).otherwise(5).alias("records"))
_rgs = lambda v: _index(v).filter("withdrawn = 0").select(F.concat_ws("/", "sample_name", "instrument_platform", "analysis_group").alias("file_id"), F.col("run_id").alias("id"), F.col("sample_name").alias("sm"), F.col("instrument_platform").alias("pl"), "study_id").distinct().filter("not id like '%9'").select(
    "file_id", "id", F.col("sm").alias("SM"), F.when(F.col("sm").endswith("2"), "xx").otherwise("SC").alias("CN"), F.col("pl").alias("PL"), F.lit("none").alias("LB"), F.when(F.col("sm").endswith("4"), "other").otherwise(F.col("study_id")).alias("DS"))
add("JON-26_check_release_metadata", lambda v: r.check_release_metadata(_release(v), _rgs(v), _index(v)).select("file_id", F.array_join("failed", ",").alias("failed")),
    """, i AS (SELECT *, concat_ws('/', sample_name, instrument_platform, analysis_group) AS f FROM index_rows), rel AS (SELECT DISTINCT f AS file_id, sample_name AS sample, instrument_platform AS platform FROM i WHERE withdrawn = 0),
       x AS (SELECT f AS file_id, count(DISTINCT run_id) AS n, count(DISTINCT CASE WHEN run_id NOT LIKE '%9' THEN run_id END) AS h FROM i WHERE withdrawn = 0 GROUP BY f),
       md AS (SELECT run_id, instrument_platform AS ip FROM (SELECT run_id, instrument_platform, count(*) AS c FROM index_rows GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY c DESC, instrument_platform) = 1),
       pl AS (SELECT DISTINCT f AS file_id FROM i JOIN md ON md.run_id = i.run_id WHERE withdrawn = 0 AND i.run_id NOT LIKE '%9' AND ip <> instrument_platform)
       SELECT rel.file_id, concat_ws(',', CASE WHEN h > 0 AND sample LIKE '%2' THEN 'center_name' END, CASE WHEN n <> h THEN 'lane_count' END, CASE WHEN h > 0 THEN 'library' END, CASE WHEN pl.file_id IS NOT NULL THEN 'platform' END, CASE WHEN h > 0 AND sample LIKE '%7' THEN 'population' END,
         CASE WHEN sample LIKE '%3' THEN 'reads' END, CASE WHEN h > 0 AND sample LIKE '%4' THEN 'study' END) AS failed FROM rel JOIN x ON x.file_id = rel.file_id LEFT JOIN pl ON pl.file_id = rel.file_id""")
add("JON-28_header_mistakes", lambda v: r.header_mistakes(v.files.select("file_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("line_no"), F.when(F.col("file_id") % 3 == 0, F.col("library")).when(F.col("file_id") % 3 == 1, "id").otherwise("bad").alias("LB"), F.when(F.col("file_id") % 5 > 0, F.col("sample")).otherwise("sX").alias("SM"), F.concat(F.lit("Study "), F.when(F.col("file_id") % 7 == 0, "other").otherwise("st"), F.lit(": long")).alias("DS"))
    .withColumn("SM", F.when((F.col("line_no") == 1) & (F.col("file_id") % 2 == 0), "wrong").otherwise(F.col("SM"))), v.files.select("file_id", F.lit("id").alias("library_id"), F.col("library").alias("library_name"), "sample", F.when(F.col("file_id") % 11 > 0, "st").alias("study"))).select("file_id", "mistakes", F.array_join("lb", "|").alias("lb"), F.array_join("sm", "|").alias("sm"), F.array_join("ds", "|").alias("ds")),
    """SELECT file_id, CASE WHEN file_id % 3 = 2 THEN 1 ELSE 0 END + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN file_id % 7 = 0 AND file_id % 11 > 0 THEN 1 ELSE 0 END AS mistakes, CASE WHEN file_id % 3 = 2 THEN 'bad|id' END AS lb,
       CASE WHEN file_id % 5 = 0 THEN concat(CASE WHEN file_id % 2 = 0 THEN 'wrong' ELSE 'sX' END, '|', sample) END AS sm, CASE WHEN file_id % 7 = 0 AND file_id % 11 > 0 THEN 'other|st' END AS ds FROM files""")


def _file_report(v):
    files = v.files.select("file_id", "path", F.when(F.col("file_id") % 10 == 9, F.col("file_id") - 9).alias("parent"), "size", F.when(F.col("file_id") % 2 == 0, F.col("file_id") * 3).alias("lines"), F.when(F.col("file_id") % 3 == 0, F.md5("path")).alias("md5"), F.when(F.col("file_id") % 10 == 8, F.col("file_id") - 5).alias("moved_to"))
    made = v.files.filter("file_id % 10 in (0, 3)").select("file_id", (F.col("file_id") % 7).alias("setup"), (F.col("file_id") % 4).alias("step"), F.when(F.col("file_id") % 20 == 0, "bam").alias("output_key"), (F.col("file_id") % 40).alias("element"))
    fed = v.files.filter("file_id % 10 = 4").select("file_id", (F.col("file_id") % 40).alias("element"))
    elements = v.files.select((F.col("file_id") % 30).alias("element"), F.concat(F.lit("in"), (F.col("file_id") % 30 * 2).cast("string")).alias("path")).distinct()
    return r.file_report(files.drop("moved_to"), made, fed, elements, resolve_files(files), v.file_meta, ["sample", "library"])


add("JON-37_file_report", _file_report,
    """, f AS (SELECT *, CASE file_id % 10 WHEN 9 THEN file_id - 9 WHEN 8 THEN file_id - 5 WHEN 0 THEN file_id WHEN 3 THEN file_id END AS m, CASE WHEN file_id % 10 IN (4) THEN file_id END AS i FROM files),
       g AS (SELECT f.*, EXISTS (SELECT 1 FROM files x WHERE x.file_id = m) AS made, coalesce(CASE WHEN EXISTS (SELECT 1 FROM files x WHERE x.file_id = m) THEN m % 40 END, i % 40) AS el FROM f)
       SELECT g.file_id, g.path, CASE WHEN made THEN concat(m % 7, '[', m % 4, CASE WHEN m % 20 = 0 THEN ':bam' ELSE '' END, ']') ELSE 'unknown' END AS maker, coalesce(CAST(el AS STRING), 'unknown') AS element,
         CASE WHEN el IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM files y WHERE y.file_id % 30 = el) THEN concat('in', el * 2) ELSE 'n/a' END AS inputs, CAST(size AS STRING) AS size, CASE WHEN g.file_id % 2 = 0 THEN CAST(g.file_id * 3 AS STRING) ELSE 'unknown' END AS lines,
         CASE WHEN g.file_id % 3 = 0 THEN md5(g.path) ELSE 'unknown' END AS md5, coalesce(s.val, 'unknown') AS sample, coalesce(l.val, 'unknown') AS library FROM g LEFT JOIN file_meta s ON s.file_id = g.file_id AND s.key = 'sample' LEFT JOIN file_meta l ON l.file_id = g.file_id AND l.key = 'library'""")

_elements = lambda v: v.states.groupBy("setup", "element").agg((F.sum("done") % 6).cast("int").alias("completed"))
_subs = lambda v: v.states.select("setup", "element", "step", "failed", "done", "retries", (F.col("element") % 2 == 0).alias("alive"), (F.col("element") % 3 == 0).alias("ended"))
_five = lambda v: v.states.select("setup").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("name", F.concat(F.lit("step"), _str("step")))
ELEMENTS = "el AS (SELECT setup, element, CAST(sum(done) % 6 AS INT) AS completed FROM states GROUP BY 1, 2)"
add("JON-38_element_report", lambda v: r.element_report(_elements(v), _subs(v), _five(v)),
    f""", {ELEMENTS}, s AS (SELECT e.setup, e.element, count(*) FILTER (failed = 1 AND retries >= 3) AS permanent, count(*) FILTER (failed = 1 AND retries < 3) AS temporary, count(*) FILTER (failed = 0 AND done = 1) AS done, count(*) FILTER (failed = 0 AND done = 0 AND e.element % 2 = 0) AS running,
         count(*) FILTER (failed = 0 AND done = 0 AND e.element % 2 = 1) AS scheduled FROM el e JOIN states x ON x.setup = e.setup AND x.element = e.element AND x.step = e.completed + 1 GROUP BY 1, 2)
       SELECT e.setup, e.element, CASE WHEN completed = 0 THEN 'no_steps_complete' ELSE concat('step', completed) END AS last_step, CASE WHEN completed < 5 THEN concat('step', completed + 1) END AS current_step, coalesce(permanent, 0) AS permanent, coalesce(temporary, 0) AS temporary, coalesce(done, 0) AS done,
         coalesce(running, 0) AS running, coalesce(scheduled, 0) AS scheduled, CASE WHEN completed >= 5 THEN 'complete' WHEN permanent > 0 THEN 'STALLED' ELSE 'working' END AS status FROM el e LEFT JOIN s ON s.setup = e.setup AND s.element = e.element""")
_steps = lambda v: v.states.select("setup").distinct().withColumn("steps", F.lit(5))
PERCENT = "CASE WHEN {n} = {d} THEN 100.0 WHEN {n} = 0 THEN 0.0 ELSE least(greatest(round(100 * {n} / {d}, 2), 0.01), 99.99) END"
add("AGG-27_progress_by_step", lambda v: a.progress_by_step(_elements(v), _subs(v), _steps(v)),
    f""", {ELEMENTS}, tot AS (SELECT setup, count(*) AS d FROM el GROUP BY setup), o AS (SELECT setup, element, completed + 1 AS step FROM el WHERE completed < 5),
       b AS (SELECT DISTINCT o.setup, o.step, o.element, CASE WHEN failed = 1 THEN 'failed' WHEN o.element % 3 = 0 THEN 'processing' WHEN o.element % 2 = 0 THEN 'running' ELSE 'pending' END AS status FROM o JOIN states s ON s.setup = o.setup AND s.element = o.element AND s.step = o.step WHERE done = 0),
       r AS (SELECT setup, completed AS step, 'complete' AS status, count(*) AS n FROM el WHERE completed >= 5 GROUP BY 1, 2 UNION ALL SELECT setup, step, status, count(*) FROM b GROUP BY 1, 2, 3
         UNION ALL SELECT setup, step - 1, 'unknown', count(*) FROM o WHERE (setup, element) NOT IN (SELECT setup, element FROM b) GROUP BY 1, 2)
       SELECT r.setup, step, status, n AS elements, {PERCENT.format(n="n", d="d")} AS percent FROM r JOIN tot ON tot.setup = r.setup""")
add("AGG-27_setup_percent", lambda v: a.setup_percent(_elements(v), _steps(v)), f", {ELEMENTS}, t AS (SELECT setup, sum(completed) AS n, count(*) * 5 AS d FROM el GROUP BY setup) SELECT setup, {PERCENT.format(n='n', d='d')} AS percent FROM t")

_file_stats = lambda v: v.lane_stats.select("lane", "lane_no", F.col("total_reads").alias("reads"), F.col("total_length").alias("bases"), "reads_mapped", "reads_paired", F.col("bases_mapped_cigar").alias("bases_mapped_c"), (F.col("error_permille") / 1000).alias("error_rate"), (F.col("reads_mapped") - F.col("reads_duplicated")).alias("rmdup_reads_mapped"),
    (F.col("bases_mapped_cigar") - F.col("bases_duplicated")).alias("rmdup_bases_mapped"), "bases_trimmed", F.lit(286.5).alias("mean_insert_size"), F.lit(74.1).alias("sd_insert_size"), *(F.when(F.col("lane_no") % 6 > 0, F.floor(F.col("bases_mapped_cigar") / d)).otherwise(0).alias(f"targeted_bases_of_{d}X_coverage") for d in p.DEPTHS),
    (F.col("lane_no") % 4).cast("double").alias("targeted_mean_coverage"), (F.col("bases_mapped_cigar") - 7).alias("targeted_bases_mapped_c"), F.when(F.col("lane_no") % 3 == 0, "no_qc").otherwise("passed").alias("qc_status"), F.when(F.col("lane_no") % 5 < 2, F.col("lane_no") % 5).alias("npg_qc_status"), (F.col("lane_no") % 2).alias("paired"), F.lit(99.7).alias("avg_read_length"))
add("PRJ-1_lane_stats_to_mapstats", lambda v: p.lane_stats_to_mapstats(_file_stats(v), True),
    """SELECT lane, total_reads AS raw_reads, total_length AS raw_bases, reads_mapped, reads_paired, bases_mapped_cigar AS bases_mapped, error_permille / 1000 AS error_rate, reads_mapped - reads_duplicated AS rmdup_reads_mapped, bases_mapped_cigar - bases_duplicated AS rmdup_bases_mapped, total_length - bases_trimmed AS clip_bases,
       286.5 AS mean_insert, 74.1 AS sd_insert, """ + ", ".join(f"CASE WHEN lane_no % 6 > 0 AND bases_mapped_cigar // {d} > 0 THEN CAST(round(CAST(bases_mapped_cigar // {d} / total_length AS DECIMAL(24, 9)), 2) AS DOUBLE) END AS target_bases_{d}x" for d in p.DEPTHS) + ", CAST(nullif(lane_no % 4, 0) AS DOUBLE) AS mean_target_coverage, bases_mapped_cigar - 7 AS target_bases_mapped FROM lane_stats")
add("PRJ-1_lane_updates", lambda v: p.lane_updates(_file_stats(v)),
    """SELECT lane, total_reads AS raw_reads, total_length AS raw_bases, lane_no % 2 = 1 AS is_paired, CAST(99 AS BIGINT) AS read_len, CASE WHEN lane_no % 3 = 0 THEN 'pending' ELSE 'passed' END AS qc_status, CASE lane_no % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' END AS npg_status FROM lane_stats""")
_full_index = lambda v: v.index_rows.withColumns({"md5": F.when(F.col("row_no") % 2 == 0, F.md5("fastq_file")).otherwise(""), "study_id": F.lit("st"), "study_name": F.lit("name"), "center_name": F.lit("sc"), "sample_id": F.concat(F.lit("ERS"), "sample_name"), "population": F.lit("GBR"), "insert_size": F.col("row_no") % 500})
add("PRJ-2_index_to_file_metadata", lambda v: p.index_to_file_metadata(_full_index(v), j.pair_mates(v.index_rows), "/remote"),
    """SELECT a.fastq_file, CASE WHEN a.row_no % 2 = 0 THEN md5(a.fastq_file) END AS expected_md5, 'SC' AS center_name, a.run_id AS lane, 'st' AS study, 'name' AS study_name, concat('ERS', a.sample_name) AS sample_id, a.sample_name AS sample, 'GBR' AS population, a.instrument_platform AS platform, a.library_name AS library,
       a.row_no % 500 AS insert_size, a.withdrawn, a.read_count AS reads, a.base_count AS bases, a.analysis_group, CASE WHEN a.paired_fastq = '' THEN 0 WHEN b.row_no IS NULL OR a.row_no < b.row_no THEN 1 ELSE 2 END AS paired, nullif(a.paired_fastq, '') AS mate, concat('/remote/', a.fastq_file) AS remote_path
       FROM index_rows a LEFT JOIN index_rows b ON a.paired_fastq = b.fastq_file""")
_tracked = lambda v: v.lane_stats.select("lane", F.lit("SC").alias("centre"), F.lit("proj").alias("project"), F.lit("st").alias("study"), F.when(F.col("lane_no") % 2 == 0, "human").otherwise("").alias("species"), F.lit("GBR").alias("population"), F.concat(F.lit("ind"), _str("lane_no")).alias("individual"), F.when(F.col("lane_no") % 3 == 0, "change_me").when(F.col("lane_no") % 3 == 1, "alias").alias("individual_alias"),
    F.lit("sm").alias("sample"), F.lit("SLX").alias("seq_tech"), "library", F.when(F.col("lane_no") % 4 == 0, 1).alias("withdrawn"), F.lit(None).cast("int").alias("insert_size"), (F.col("lane_no") % 2).alias("is_paired"), (F.col("lane_no") % 4).alias("note_id"), F.lit("acc").alias("acc"), F.lit("/store").alias("storage_path"), F.lit("").alias("library_tag_sequence"))
_lane_files = lambda v: v.files.select("lane", F.col("path").alias("name"), F.md5("path").alias("md5"), F.when(F.col("file_id") % 2 == 0, F.col("size")).alias("raw_reads"), F.lit(None).cast("long").alias("raw_bases"), F.col("file_id").alias("lane_id"))
for array_data in (False, True):
    add(f"PRJ-3_tracking_to_file_metadata{'_array' * array_data}", lambda v, array_data=array_data: p.tracking_to_file_metadata(_tracked(v), _lane_files(v), array_data),
        """SELECT f.path, md5(f.path) AS expected_md5, 'SC' AS center_name, 'proj' AS project, 'st' AS study, CASE WHEN lane_no % 2 = 0 THEN 'human' END AS species, 'GBR' AS population, CASE WHEN lane_no % 3 = 1 THEN 'alias' ELSE concat('ind', lane_no) END AS individual, 'sm' AS sample, 'SLX' AS platform, l.library, f.lane,
           CASE WHEN lane_no % 4 = 0 THEN 1 ELSE 0 END AS withdrawn, 0 AS insert_size, CASE WHEN file_id % 2 = 0 THEN size ELSE 0 END AS reads, CAST(0 AS BIGINT) AS bases, lane_no % 2 AS paired, file_id AS lane_id""" + (", 'acc' AS analysis_uuid, CASE lane_no % 4 WHEN 1 THEN 'Control' WHEN 2 THEN 'Stem cell' END AS control, '/store' AS storage_path, NULL AS library_tag" if array_data else "") + " FROM files f JOIN lane_stats l ON l.lane = f.lane")
add("PRJ-4_assign_read_group", lambda v: p.assign_read_group(v.reads.select("qname", "row_no", "rg", (F.col("row_no") % 50).alias("file_id")), v.files).groupBy("rg").agg(F.count("*").alias("n")),
    "SELECT lane AS rg, count(*) AS n FROM reads JOIN files ON file_id = row_no % 50 GROUP BY lane")
add("PRJ-4_read_group_rows", lambda v: p.read_group_rows(v.files.withColumns({"platform": F.when(F.col("file_id") % 2 == 0, "slx"), "library": F.when(F.col("file_id") % 3 == 0, F.col("library")), "platform_unit": F.when(F.col("file_id") % 5 == 0, "unit").otherwise(""), "public_name": F.when(F.col("file_id") % 7 == 0, "pub"), "center_name": F.when(F.col("file_id") % 4 == 0, "sc"), "study": F.lit(None).cast("string")}), "public_name"),
    """SELECT file_id, lane AS id, CASE WHEN file_id % 3 = 0 THEN library ELSE 'unknown_library' END AS lb, CASE WHEN file_id % 2 = 0 THEN 'ILLUMINA' ELSE 'unknown_platform' END AS pl, CASE WHEN file_id % 5 = 0 THEN 'unit' ELSE lane END AS pu, CASE WHEN file_id % 7 = 0 THEN 'pub' ELSE sample END AS sm,
       CASE WHEN file_id % 4 = 0 THEN 'sc' ELSE 'unknown_centre' END AS cn, 'unknown_study' AS ds FROM files""")


def _vcf_files(v):
    """A call set a study, with its samples as columns, in a file of its own."""
    folder = new_dir(v.spark, "vcf")
    lines = v.cohort.groupBy("study_id").agg(F.concat(F.lit("##fileformat=VCFv4.0\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.array_join(F.array_sort(F.collect_list("sample")), "\t"), F.lit("\n1\t5\t.\tA\tC\t9\tPASS\t.\tGT")).alias("value"))
    lines.repartition("study_id").write.partitionBy("study_id").text(folder)
    return folder


def _file_metadata(v):
    folder = _vcf_files(v)
    out = j.vcf_file_metadata(t.vcf_samples(v.spark, folder), t.file_checksums(v.spark, folder))
    return out.select(F.regexp_extract("file", r"study_id=(\d+)", 1).cast("int").alias("study_id"), "samples", "md5")


add("PRJ-5_vcf_file_metadata", _file_metadata,
    """, s AS (SELECT study_id, string_agg(sample, '#' ORDER BY sample) AS samples FROM cohort GROUP BY study_id)
       SELECT CAST(study_id AS INT) AS study_id, samples, md5(concat('##fileformat=VCFv4.0', chr(10), concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', replace(samples, '#', chr(9))), chr(10), concat_ws(chr(9), '1', '5', '.', 'A', 'C', '9', 'PASS', '.', 'GT'), chr(10))) AS md5 FROM s""")
add("SRC-15_vcf_samples", lambda v: t.vcf_samples(v.spark, _vcf_files(v)).select(F.regexp_extract("file", r"study_id=(\d+)", 1).cast("int").alias("study_id"), "column_no", "sample"),
    "SELECT CAST(study_id AS INT) AS study_id, CAST(row_number() OVER (PARTITION BY study_id ORDER BY sample) - 1 AS INT) AS column_no, sample FROM cohort")
_meta_files = lambda v: v.files.select("file_id", F.when(F.col("file_id") % 3 == 0, "gtc").when(F.col("file_id") % 3 == 1, "idat").otherwise("bam").alias("type"), "lane", F.when(F.col("file_id") % 13 == 0, 5).otherwise(F.col("size")).alias("reads"), "library", F.lit("L1").alias("library_id"), F.concat(F.lit("inf"), "sample").alias("infinium_sample"), "sample", F.concat(F.lit("id"), "sample").alias("sample_id"),
    F.lpad((F.col("file_id") % 50).cast("string"), 10, "7").alias("beadchip"), F.lit("R1").alias("beadchip_section"), F.concat(F.lit("st"), F.substring("status", 1, 1)).alias("study_id"), F.lit("A – title é").alias("study_title"), F.lit(None).cast("string").alias("study_accession_number"), (F.col("file_id") % 2 + 9606).alias("taxon_id"), F.lit("human").alias("sample_common_name"),
    F.when(F.col("file_id") % 4 == 0, "sup").alias("sample_supplier_name"), F.concat(F.lit("co"), "library").alias("sample_cohort"), F.when(F.col("file_id") % 5 > 0, F.concat(F.lit("acc"), F.col("file_id").cast("string"))).alias("sample_accession_number"), F.concat(F.lit("pub"), F.col("file_id").cast("string")).alias("public_name"), (F.col("file_id") % 6 == 5).alias("sample_control"))
TRACKED = """k AS (SELECT *, CASE WHEN file_id % 3 = 0 THEN concat('inf', sample) WHEN file_id % 3 = 1 THEN concat(sample, '.', lpad(CAST(file_id % 50 AS STRING), 10, '7'), '.R1') ELSE library END AS lib, lpad(CAST(file_id % 50 AS STRING), 10, '7') AS chip FROM files WHERE NOT (file_id % 3 = 2 AND (file_id % 13 = 0 OR size < 1000)))"""
TRACKING = {
    "lane": "SELECT lane, arg_max(lib, file_id) AS library, arg_max(sample, file_id) AS sample FROM k GROUP BY lane",
    "library": "SELECT lib AS library, arg_max(CASE WHEN file_id % 3 < 2 THEN concat(right(chip, 4), right(concat('id', sample), 3)) ELSE 'L1' END, file_id) AS ssid, CASE WHEN arg_max(file_id % 3, file_id) < 2 THEN concat(arg_max(chip, file_id), '_R1') END AS tag, arg_max(sample, file_id) AS sample FROM k GROUP BY lib",
    "study": "SELECT DISTINCT concat('st', substr(status, 1, 1)) AS study_id, 'A - title -' AS name, concat('st', substr(status, 1, 1)) AS acc FROM k",
    "sample": "SELECT sample, CASE WHEN max(file_id) % 4 = 0 THEN 'sup' ELSE sample END AS hierarchy_name, concat('id', sample) AS ssid, CASE WHEN max(file_id) % 6 = 5 THEN 1 ELSE 2 END AS note_id, concat('co', arg_max(library, file_id)) AS individual, concat('st', substr(arg_max(status, file_id), 1, 1)) AS study_id FROM k GROUP BY sample",
    "species": "SELECT DISTINCT file_id % 2 + 9606 AS taxon_id, 'human' AS name FROM k",
    "individual": "SELECT concat('co', library) AS individual, concat('acc', min(file_id) FILTER (file_id % 5 > 0)) AS acc, concat('pub', coalesce(min(file_id) FILTER (file_id % 6 = 5), min(file_id))) AS alias, max(file_id) % 2 + 9606 AS taxon_id FROM k GROUP BY library",
}
for table, sql in TRACKING.items():
    add(f"PRJ-6_metadata_to_tracking{'' if table == 'lane' else '_' + table}", lambda v, table=table: p.metadata_to_tracking(_meta_files(v))[table], f", {TRACKED} {sql}")
