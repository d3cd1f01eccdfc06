"""Rehearsal views: the driver's tables seen as cohort tables, in SQL that Spark and other engines read alike.

Each view uses integer expressions of the base tables only, so that a query
over it can be held against an independent SQL text over the same view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "reads": """SELECT concat('q', CAST(l_orderkey AS STRING)) AS qname, l_orderkey * 8 + l_linenumber AS row_no,
        CAST(CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE 1 END + CASE WHEN l_orderkey % 10 <> 0 AND (l_orderkey + l_linenumber) % 3 <> 0 THEN 2 ELSE 0 END
          + CASE WHEN l_partkey % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN l_orderkey % 13 = 0 THEN 8 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 16 ELSE 0 END
          + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_partkey % 17 = 0 THEN 256 ELSE 0 END + CASE WHEN l_suppkey % 19 = 0 THEN 512 ELSE 0 END
          + CASE WHEN l_orderkey % 23 = 0 THEN 1024 ELSE 0 END AS INT) AS flag,
        concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS rname, l_partkey * 37 + l_linenumber AS pos, CAST(l_quantity AS INT) AS mapq,
        concat('chr', CAST(l_partkey % 5 + 1 AS STRING)) AS mrnm, l_suppkey * 37 AS mpos, CAST(floor(l_extendedprice) AS BIGINT) % 700 - 200 AS isize,
        concat('rg', CAST(l_suppkey % 7 AS STRING)) AS rg, l_returnflag AS lib, CAST(round(l_tax * 100) AS INT) AS nm, 100 AS len,
        CAST(l_quantity AS INT) * 60 AS sum_qual, 100 AS n_qual, concat(CAST(l_linenumber AS STRING), 'S', CAST(90 - l_linenumber AS STRING), 'M2I8M') AS cigar
        FROM {lineitem}""",
    "regions": """SELECT concat('r', CAST(p_partkey AS STRING)) AS region, concat('chr', CAST(p_size % 5 + 1 AS STRING)) AS chrom, p_partkey * 40 AS "start",
        p_partkey * 40 + p_size * 20 AS "end" FROM {part}""",
    "cnvs": """SELECT concat('s', CAST(p_partkey % 11 AS STRING)) AS donor, p_partkey % 4 = 0 AS is_control, p_partkey AS cnv_id, concat('chr', CAST(p_size % 5 + 1 AS STRING)) AS chrom,
        (p_partkey % 97) * 100 AS "start", (p_partkey % 97) * 100 + p_size * 10 + 5 AS "end", p_size AS num_snps, CAST(floor(p_retailprice) AS BIGINT) AS confidence,
        concat('state', CAST(p_size % 6 AS STRING)) AS state FROM {part}""",
    "genotypes": """SELECT concat('s', CAST(l_suppkey % 12 AS STRING)) AS sample, concat('chr', CAST(l_partkey % 5 + 1 AS STRING)) AS chrom, l_partkey AS pos,
        MIN(CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN '0/0' WHEN (l_orderkey + l_linenumber) % 3 = 1 THEN '0/1' ELSE '1/1' END) AS gt,
        MIN(CAST(l_quantity AS INT)) AS dp FROM {lineitem} GROUP BY l_suppkey % 12, l_partkey""",
    "variants": """SELECT concat('chr', CAST(p_size % 5 + 1 AS STRING)) AS chrom, p_partkey * 13 AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN 'C' ELSE 'G' END AS ref,
        CASE WHEN p_partkey % 4 = 0 THEN 'G' WHEN p_partkey % 4 = 1 THEN 'T' WHEN p_partkey % 4 = 2 THEN 'TA' ELSE 'C' END AS alt, p_size AS qual, p_partkey % 40 AS dp,
        p_partkey % 25 - 5 AS vqslod, CASE WHEN p_partkey % 4 = 2 THEN 'indel' ELSE 'snp' END AS kind FROM {part}""",
    "file_meta": """SELECT o_orderkey AS file_id, concat('/d', CAST(o_custkey % 3 AS STRING), '/x/f', CAST(o_orderkey AS STRING), '.bam') AS path, k.key AS key, k.val AS val FROM (
        SELECT o_orderkey, o_custkey, 'sample' AS key, concat('s', CAST(o_custkey % 300 AS STRING)) AS val FROM {orders} WHERE o_orderkey % 7 <> 0
        UNION ALL SELECT o_orderkey, o_custkey, 'platform', o_orderpriority FROM {orders}
        UNION ALL SELECT o_orderkey, o_custkey, 'library', concat('lib', CAST(o_custkey % 50 AS STRING)) FROM {orders} WHERE o_orderkey % 5 <> 0
        UNION ALL SELECT o_orderkey, o_custkey, 'status', o_orderstatus FROM {orders}) k""",
    "files": """SELECT o_orderkey AS file_id, concat('/d', CAST(o_custkey % 3 AS STRING), '/x/f', CAST(o_orderkey AS STRING), '.bam') AS path, CAST(floor(o_totalprice) AS BIGINT) AS size,
        concat('s', CAST(o_custkey % 300 AS STRING)) AS sample, concat('lib', CAST(o_custkey % 50 AS STRING)) AS library, o_orderpriority AS platform, o_orderstatus AS status,
        concat('lane', CAST(o_orderkey % 900 AS STRING)) AS lane, o_orderkey % 41 = 0 AS withdrawn FROM {orders}""",
    "index_rows": """SELECT o_orderkey AS row_no, concat('f', CAST(o_orderkey AS STRING), '.fastq') AS fastq_file, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN concat('f', CAST(o_orderkey + 1 AS STRING), '.fastq')
          WHEN (o_orderkey - 1) % 3 = 0 AND (o_orderkey - 1) % 2 = 0 THEN concat('f', CAST(o_orderkey - 1 AS STRING), '.fastq') ELSE '' END AS paired_fastq,
        concat('run', CAST(o_orderkey % 1500 AS STRING)) AS run_id, concat('s', CAST(o_orderkey % 1500 % 300 AS STRING)) AS sample_name, o_orderpriority AS instrument_platform, concat('lib', CAST(o_custkey % 50 AS STRING)) AS library_name,
        CASE WHEN o_orderkey % 1500 % 3 = 0 THEN 'low coverage' ELSE 'exome' END AS analysis_group, CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS withdrawn,
        CAST(floor(o_totalprice) AS BIGINT) AS read_count, CAST(floor(o_totalprice) AS BIGINT) * 100 AS base_count FROM {orders}""",
    "lane_hist": """SELECT concat('rg', CAST(l_suppkey % 7 AS STRING)) AS lane, CAST(l_quantity AS INT) AS value, COUNT(*) AS n FROM {lineitem} GROUP BY l_suppkey % 7, CAST(l_quantity AS INT)""",
    "insert_hist": """SELECT concat('rg', CAST(l_suppkey % 7 AS STRING)) AS lane, CAST(floor(l_extendedprice) AS BIGINT) % 60 AS value, COUNT(*) AS n FROM {lineitem} GROUP BY l_suppkey % 7, CAST(floor(l_extendedprice) AS BIGINT) % 60""",
    "lane_stats": """SELECT o_orderkey AS lane_no, concat('lane', CAST(o_orderkey AS STRING)) AS lane, concat('lib', CAST(o_custkey % 50 AS STRING)) AS library, CAST(floor(o_totalprice) AS BIGINT) + 1000 AS total_reads,
        CAST(floor(o_totalprice * 0.9) AS BIGINT) AS reads_mapped, CAST(floor(o_totalprice * 0.8) AS BIGINT) AS reads_paired, CAST(floor(o_totalprice * 0.05) AS BIGINT) AS reads_duplicated,
        (CAST(floor(o_totalprice) AS BIGINT) + 1000) * 100 AS total_length, CAST(floor(o_totalprice * 0.9) AS BIGINT) * 98 AS bases_mapped_cigar, CAST(floor(o_totalprice * 0.05) AS BIGINT) * 97 AS bases_duplicated,
        CAST(floor(o_totalprice * 90) AS BIGINT) AS bases_trimmed, o_custkey % 50 AS error_permille, o_orderkey % 7 AS n_ins, o_orderkey % 5 AS n_del,
        CASE WHEN o_orderkey % 6 = 0 THEN 'wrong' WHEN o_orderkey % 6 = 1 THEN 'unconfirmed' ELSE 'confirmed' END AS gt_status FROM {orders}""",
    "step_facts": """SELECT event_id AS fact_id, event_type AS step, CAST(user_id % 10 AS INT) AS setup, CAST(floor(value) AS BIGINT) AS time_s, CAST(floor(value * 3) AS BIGINT) AS memory, ts FROM {events}""",
    "messages": """SELECT event_id, user_id AS subject, event_type AS message, ts FROM {events}""",
    "moves": """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey + 1 < (SELECT COUNT(*) FROM {orders}) THEN o_orderkey + 1 END AS moved_to, CAST(floor(o_totalprice) AS BIGINT) AS size FROM {orders}""",
    "edges": """SELECT concat('o', CAST(o_orderkey AS STRING)) AS src, concat('c', CAST(o_custkey AS STRING)) AS dst, 'lane_of' AS type FROM {orders}
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 'sample_of' FROM {customer}
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), 'study_of' FROM {nation}""",
    "nodes": """SELECT concat('o', CAST(o_orderkey AS STRING)) AS id, 'lane' AS label, o_orderstatus AS prop FROM {orders}
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 'sample', c_mktsegment FROM {customer}
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), 'donor', n_name FROM {nation} UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 'study', r_name FROM {region}""",
    "samples": """SELECT c_custkey AS sample_id, concat('s', CAST(c_custkey AS STRING)) AS sample, concat('d', CAST(c_custkey % 200 AS STRING)) AS donor, c_nationkey AS study_id,
        CASE WHEN c_custkey % 3 = 0 THEN 'Female' WHEN c_custkey % 3 = 1 THEN 'male' ELSE NULL END AS gender, c_custkey % 9 = 0 AS control, c_custkey % 13 = 0 AS qc_failed, c_custkey % 4 = 0 AS selected,
        CAST(floor(c_acctbal) AS BIGINT) AS created FROM {customer}""",
    "states": """SELECT l_orderkey % 400 AS element, CAST(l_suppkey % 6 AS INT) AS setup, CAST(l_linenumber AS INT) AS step, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS failed, MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS done,
        MAX(CAST(l_quantity AS INT) % 5) AS retries FROM {lineitem} GROUP BY l_orderkey % 400, l_suppkey % 6, l_linenumber""",
    "scores": """SELECT concat('lane', CAST(l_orderkey % 800 AS STRING)) AS lane, concat('s', CAST(l_suppkey % 20 AS STRING)) AS sample, MAX(CAST(l_quantity AS BIGINT) * 20) AS score, MAX(CAST(floor(l_extendedprice) AS BIGINT) % 300) AS sites
        FROM {lineitem} GROUP BY l_orderkey % 800, l_suppkey % 20""",
    "sequences": """SELECT concat('chr', CAST(n_nationkey + 1 AS STRING)) AS sn, n_nationkey + 1 AS idx, (n_nationkey + 3) * 7001 AS ln, concat('m', CAST(n_nationkey AS STRING)) AS m5 FROM {nation}""",
    "qc_lanes": """SELECT concat('lane', CAST(o_orderkey AS STRING)) AS lane, concat('lib', CAST(o_custkey % 50 AS STRING)) AS library, o_orderkey % 3 <> 0 AS is_paired, CASE WHEN o_orderkey % 29 = 0 THEN 'fail' WHEN o_orderkey % 29 = 1 THEN 'pass' END AS npg_status,
        CASE WHEN o_orderkey % 6 = 0 THEN 'status=wrong expected=a found=b ratio=1.2' WHEN o_orderkey % 6 = 1 THEN 'status=confirmed expected=a found=a concordance=0.9' WHEN o_orderkey % 6 = 2 THEN 'odd text' END AS gtype_analysis,
        CASE WHEN o_orderkey % 4 = 0 THEN concat('s', CAST(o_custkey % 300 AS STRING)) WHEN o_orderkey % 4 = 1 THEN 'x' END AS genotype_found, 'e' AS genotype_expected, concat('s', CAST(o_custkey % 300 AS STRING)) AS sample, 'i' AS individual, 'acc' AS individual_acc,
        CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) + 1000 END AS sequences, CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE (CAST(floor(o_totalprice) AS BIGINT) + 1000) * 100 END AS total_length,
        CAST(floor(o_totalprice) AS BIGINT) * 95 + 1 AS clip_bases, CAST(floor(o_totalprice) AS BIGINT) * (80 + o_orderkey % 20) AS bases_mapped, CAST(floor(o_totalprice) AS BIGINT) + 500 AS reads_mapped,
        CAST(floor(o_totalprice) AS BIGINT) + 500 - CAST(floor((CAST(floor(o_totalprice) AS BIGINT) + 500) * (o_orderkey % 25) / 100) AS BIGINT) AS rmdup_reads_mapped,
        CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS reads_paired, CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE 250 END AS mean_insert, CAST(o_custkey % 50 AS DOUBLE) / 1000 AS error_rate FROM {orders}""",
    "qc_indels": """SELECT concat('lane', CAST(l_orderkey AS STRING)) AS lane, l_linenumber AS length, l_partkey % 5 AS n_ins, l_suppkey % 6 AS n_del FROM {lineitem}""",
    "qc_inserts": """SELECT concat('lane', CAST(l_orderkey AS STRING)) AS lane, CAST(l_linenumber * 40 + (l_suppkey % 3) * 7 AS BIGINT) AS value, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM {lineitem}
        WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey, l_linenumber * 40 + (l_suppkey % 3) * 7""",
    "qc_lengths": """SELECT DISTINCT concat('lane', CAST(l_orderkey AS STRING)) AS lane, CASE WHEN l_orderkey % 9 = 0 THEN 90 + l_linenumber ELSE 100 END AS length FROM {lineitem}""",
    "qc_cycles": """SELECT concat('lane', CAST(l_orderkey AS STRING)) AS lane, concat('s', CAST(l_linenumber % 2 AS STRING)) AS series, CAST(l_quantity AS INT) AS n FROM {lineitem} WHERE l_orderkey % 7 <> 0""",
    "lab_nodes": """SELECT concat('F', CAST(o_orderkey AS STRING)) AS id, 'File' AS label FROM {orders} UNION ALL SELECT concat('Q', CAST(o_orderkey AS STRING)), 'File' FROM {orders}
        UNION ALL SELECT concat('L', CAST(o_orderkey AS STRING)), 'Lane' FROM {orders} WHERE o_orderkey % 5 <> 0 UNION ALL SELECT concat('S', CAST(o_orderkey AS STRING)), 'Section' FROM {orders} WHERE o_orderkey % 5 = 0
        UNION ALL SELECT concat('B', CAST(c_custkey AS STRING)), 'Library' FROM {customer} UNION ALL SELECT concat('K', CAST(c_custkey AS STRING)), 'Beadchip' FROM {customer} UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), 'Sample' FROM {customer}
        UNION ALL SELECT concat('T', CAST(n_nationkey AS STRING)), 'Taxon' FROM {nation} UNION ALL SELECT concat('R', CAST(n_nationkey AS STRING)), 'Study' FROM {nation} UNION ALL SELECT concat('R9', CAST(r_regionkey AS STRING)), 'Study' FROM {region}""",
    "lab_edges": """SELECT concat(CASE WHEN o_orderkey % 5 = 0 THEN 'S' ELSE 'L' END, CAST(o_orderkey AS STRING)) AS src, concat('F', CAST(o_orderkey AS STRING)) AS dst, 'aligned' AS type, 0 AS preferred FROM {orders}
        UNION ALL SELECT concat('F', CAST(o_orderkey AS STRING)), concat('Q', CAST(o_orderkey AS STRING)), 'qc_file', 0 FROM {orders}
        UNION ALL SELECT concat('B', CAST(o_custkey AS STRING)), concat('L', CAST(o_orderkey AS STRING)), 'sequenced', 0 FROM {orders} WHERE o_orderkey % 5 <> 0
        UNION ALL SELECT concat('K', CAST(o_custkey AS STRING)), concat('S', CAST(o_orderkey AS STRING)), 'section', 0 FROM {orders} WHERE o_orderkey % 5 = 0
        UNION ALL SELECT concat('C', CAST(o_custkey AS STRING)), concat('S', CAST(o_orderkey AS STRING)), 'placed', 0 FROM {orders} WHERE o_orderkey % 5 = 0
        UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), concat('B', CAST(c_custkey AS STRING)), 'prepared', 0 FROM {customer}
        UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 3 = 0 THEN 'Gf' ELSE 'Gm' END, 'gender', 0 FROM {customer} WHERE c_custkey % 3 <> 2
        UNION ALL SELECT concat('D', CAST(c_custkey % 200 AS STRING)), concat('C', CAST(c_custkey AS STRING)), 'sample', 0 FROM {customer}
        UNION ALL SELECT concat('T', CAST(c_nationkey AS STRING)), concat('C', CAST(c_custkey AS STRING)), 'member', 0 FROM {customer}
        UNION ALL SELECT concat('R', CAST(c_nationkey AS STRING)), concat('C', CAST(c_custkey AS STRING)), 'member', 0 FROM {customer} WHERE c_custkey % 7 <> 0
        UNION ALL SELECT concat('R9', CAST(c_custkey % 5 AS STRING)), concat('C', CAST(c_custkey AS STRING)), 'member', 1 FROM {customer} WHERE c_custkey % 4 = 0""",
    "cohort": """SELECT c_custkey AS sample_id, concat('s', CAST(c_custkey AS STRING)) AS sample, concat('d', CAST(c_custkey % 20 AS STRING)) AS donor, concat('p', CAST(c_custkey % 40 AS STRING)) AS public_name, c_custkey % 9 = 0 AS control, c_custkey % 13 = 0 AS qc_failed,
        c_custkey % 4 = 0 AS qc_selected, c_nationkey % 3 AS study_id FROM {customer}""",
}


class Views:
    """The views of one folder of tables, as DataFrames: Views(spark, sf_dir).reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name].replace('"', "`")
            return self.spark.sql(text, **{t: self.table(t) for t in set(re.findall(r"\{(\w+)\}", text))})
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def with_views(body: str) -> str:
    """SQL for another engine: the views that body names, as common table expressions, and body.

    Body is a SELECT, or begins with a comma and further expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    parts = [f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used]
    body = body.strip()
    if body.startswith(","):
        return "WITH RECURSIVE " + (", ".join(parts) + body if parts else body[1:])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
