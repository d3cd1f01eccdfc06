"""Exact rules on tiny tables."""

import random

import pytest
from pyspark.sql import functions as F

from cohortframe.functions import scalars as s
from cohortframe.operators import aggregates as a
from cohortframe.operators import filters as f
from cohortframe.operators import graph as g
from cohortframe.operators import intervals as i
from cohortframe.operators import joins as j
from cohortframe.operators import cohorts, ordering, qc, sets
from cohortframe.operators import windows as w
from cohortframe.sources import text as t


def test_malformed_filter_is_an_error():
    for bad in ("", "a", "a#b#c", "#x"):
        with pytest.raises(ValueError):
            f.parse_spec(bad)


def test_ancestor_value_zero(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    reached = spark.createDataFrame([("a", "sample", "0"), ("a", "sample", None), ("b", "sample", "0"), ("b", "sample", "1"), ("c", "lane", "0")], "start string, label string, prop string")
    assert [r.id for r in f.filter_by_ancestor(files, reached, "sample", "0").collect()] == ["a"]


def test_histogram_median_rounds_half_to_even(spark):
    bins = spark.createDataFrame([("x", 1, 2), ("x", 5, 3), ("y", 1, 3), ("y", 2, 4)], "lane string, value int, n int")
    assert {r.lane: r["median"] for r in a.histogram_median(bins, "lane").collect()} == {"x": 1, "y": 2}


def test_read_group_rules(spark):
    rows = [("q1", 1 + 2 + 64, 60, 286, "a", 2, 100, 2000, 100), ("q1", 1 + 2 + 128, 60, -286, "a", 0, 100, 2200, 100), ("q2", 4, 0, 0, "a", 9, 100, 100, 100), ("q3", 1024, 10, 0, "a", 1, 50, 500, 50)]
    reads = spark.createDataFrame(rows, "qname string, flag int, mapq int, isize int, rg string, nm int, len int, sum_qual int, n_qual int")
    r = a.read_group_stats(reads).first()
    assert (r.total_reads, r.mapped_reads, r.proper_pairs, r.duplicate_bases) == (4, 3, 2, 50)
    assert (r.pct_mismatch, r.avg_qual, r.mean_insert, r.insert_sd, r.median_insert, r.insert_mad) == (1.2, 18.8, 286.0, 0.0, 286, 0)


def test_region_ends_are_included_and_half_open_overlap_is_not(spark):
    reads = spark.createDataFrame([("q", 0, 0, "1", 100, "1", 5), ("q", 1, 0, "1", 201, "1", 5)], "qname string, row_no long, flag int, rname string, pos long, mrnm string, mpos long")
    regions = spark.createDataFrame([("r", "1", 100, 200), ("s", "1", 200, 201)], "region string, chrom string, start long, end long")
    assert sorted((x.row_no, x.region) for x in i.reads_to_regions(reads, regions).collect()) == [(0, "r"), (1, "s")]
    c = spark.createDataFrame([(1, "d", "1", 0, 10), (2, "d", "1", 10, 20)], "cnv_id int, donor string, chrom string, start long, end long")
    o = spark.createDataFrame([("d", "1", 5, 10)], "donor string, chrom string, start long, end long")
    assert [r.cnv_id for r in i.reciprocal_overlap(c, o, 0.5, "semi").collect()] == [1]
    assert [r.cnv_id for r in i.reciprocal_overlap(c, o, 0.5, "anti").collect()] == [2]


def test_genome_chunks_cover_and_drop_a_tail_of_one_base(spark):
    seqs = spark.createDataFrame([("chr1", 1, 1001), ("chr2", 2, 1500)], "sn string, idx int, ln long")
    assert [(r.chrom, r["from"], r["to"]) for r in i.chunk_genome(seqs, 500).orderBy("seq_no").collect()] == [("chr1", 1, 500), ("chr1", 501, 1000), ("chr2", 1, 500), ("chr2", 501, 1000), ("chr2", 1001, 1500)]
    assert i.chunk_genome(seqs, 0, chroms=["1"]).count() == 1


def test_ploidy_definitions(spark, tmp_path):
    put = lambda text: (tmp_path / "p.json").write_text(text) and str(tmp_path / "p.json")
    assert t.read_ploidy(spark, put('{"X": [{"from": 1, "to": 60000, "M": 1}, {"from": 70001, "to": 80000, "M": 1}], "Y": [{"from": 1, "to": 9, "M": 1, "F": 0}]}')) == ([("X", 1, 60000, 1, 2), ("X", 70001, 80000, 1, 2), ("Y", 1, 9, 1, 0)], (2, 2))
    assert t.read_ploidy(spark, put('{"default": 4}')) == ([], (4, 4))
    for bad in ('{"X": [{"from": 9, "to": 1}]}', '{default => 2}'):
        with pytest.raises(ValueError):
            t.read_ploidy(spark, put(bad))


def test_cycles_stop(spark):
    files = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "file_id long, moved_to long")
    assert {r.file_id: r.current for r in g.resolve_files(files).collect()} == {1: 3, 2: 3, 3: 3, 4: None, 5: None}


def test_repeats_are_not_a_set(spark):
    from cohortframe.streaming.jobs import suppress_repeats

    ev = spark.createDataFrame([(i, 1, m, i) for i, m in enumerate("AABAA")], "event_id long, subject long, message string, ts long")
    assert [r.event_id for r in suppress_repeats(ev).orderBy("event_id").collect()] == [0, 2, 3]


def test_scalars(spark):
    one = spark.range(1)
    r = one.select(s.seq_length(F.lit("5S10M2I3D4H")).alias("a"), s.mapped_length(F.lit("5S10M2I3D4H")).alias("b"), F.to_json(s.qual_to_ints(F.lit("!~"))).alias("c"), s.strand_complement(F.lit("ACgt")).alias("d"), s.duration_text(F.lit(90061)).alias("e")).first()
    assert tuple(r) == (21, 10, "[0,93]", "TGca", "1 days, 1 hrs, 1 mins, 1 secs")


def test_fastq_with_at_signs_and_bad_records(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\n+\n@@@@\n@r2\nAC\n+r2\n!!\n")
    assert [tuple(r) for r in t.read_fastq(spark, f"{tmp_path}/a.fastq").select("id", "seq", "qual").orderBy("row_no").collect()] == [("r1", "ACGT", "@@@@"), ("r2", "AC", "!!")]
    (tmp_path / "b.fastq").write_text("r1\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="not a fastq record"):
        t.read_fastq(spark, f"{tmp_path}/b.fastq").collect()


def test_count_check(spark):
    with pytest.raises(ValueError):
        sets.check_row_counts(spark.range(3), spark.range(2))


def test_duplicates_keep_the_best_pair(spark):
    rows = [("a", "L", "1", 10, 64, 50, 10, "10M"), ("b", "L", "1", 10, 64, 70, 10, "10M"), ("c", "L", "1", 11, 64, 70, 10, "10M")]
    reads = spark.createDataFrame(rows, "qname string, lib string, rname string, pos long, flag int, sum_qual int, len int, cigar string")
    assert {r.qname: r.flag & 1024 for r in w.mark_duplicates(reads).collect()} == {"a": 1024, "b": 0, "c": 0}


def test_long_chains_resolve_and_cycles_do_not(spark):
    chain = [(i, i + 1) for i in range(5000)] + [(5000, None), (6000, 6001), (6001, 6002), (6002, 6001), (7000, 7777)]
    files = spark.createDataFrame(chain, "file_id long, moved_to long")
    got = {r.file_id: r.current for r in g.resolve_files(files).collect()}
    assert all(got[i] == 5000 for i in range(5001)) and got[6000] is got[6001] is got[6002] is None and got[7000] == 7777
    back = {r.file_id: (r.original, r.moves) for r in g.original_files(files).collect()}
    assert back[5000] == (0, 5000) and back[17] == (0, 17)


def test_traversal_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), "made") for i in range(40)], "src string, dst string, type string")
    got = g.related(edges, spark.createDataFrame([("5",)], "id string"), "out", 1, 20).collect()
    assert sorted(r.depth for r in got) == list(range(1, 21)) and {r.node for r in got} == {str(i) for i in range(6, 26)}
    loop = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x")], "src string, dst string, type string")
    assert [(r.node, r.depth) for r in g.related(loop, spark.createDataFrame([("a",)], "id string"), "out").collect()] == [("b", 1)]


def test_numbers_over_split_files(spark, tmp_path):
    lines = [f"line {i}" + "x" * (i % 90) for i in range(20_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\r\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = t.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in sorted((r for r in got if r.file.endswith("a.txt")), key=lambda r: r.line_no)] == lines
    assert [(r.line_no, r.line) for r in sorted((r for r in got if r.file.endswith("b.txt")), key=lambda r: r.line_no)] == [(1, "one"), (2, "two")]


def test_insert_peak_widens_by_rows(spark):
    hist = spark.createDataFrame([("a", 0, 999), ("a", 100, 10), ("a", 150, 40), ("a", 200, 40), ("a", 400, 10)], "lane string, value long, n long")
    r = qc.insert_peak(hist, 25, 80).first()
    assert (r.peak, r.pct_in_window, r.rows_each_side, round(r.range_pct, 3)) == (150, 40.0, 1, 33.333)


def test_orders_do_not_gather_a_group(spark):
    rows = spark.range(0, 5000).selectExpr("'one' as g", "id", "case when id % 7 = 0 then id end as v")
    numbered = ordering.number_within(rows, "g", "id").collect()
    assert all(r.rn == r.id + 1 for r in numbered) and len(numbered) == 5000
    assert all(r.v == r.id - r.id % 7 for r in ordering.last_known(rows, "v", "g", "id").collect())
    assert all(r.total == r.id * (r.id + 1) // 2 for r in ordering.running_total(rows.withColumn("n", F.col("id")), "n", "id").collect())


def test_alternative_alleles_are_joined_and_renumbered(spark):
    calls = spark.createDataFrame([("1", 5, "A", "C", "x", "0/1"), ("1", 5, "A", "G,C", "y", "1|2"), ("1", 5, "AT", "A", "z", "1/1"), ("1", 5, "A", "T", "w", "./.")], "chrom string, pos long, ref string, alt string, sample string, gt string")
    samples = cohorts.sample_dictionary(calls)
    got = {(r.ref, r.alt): list(r.gts) for r in cohorts.matrix_rows(cohorts.merge_samples(calls, samples), samples).collect()}
    assert got == {("A", "C,G,T"): ["./.", "0/1", "2|1", "./."], ("AT", "A"): ["./.", "./.", "./.", "1/1"]}


def test_history_carries_over_and_replaces(spark):
    events = [("n", 1, "a", ["1"], False), ("n", 1, "b", ["x", "y"], False), ("n", 2, "a", ["1"], False), ("n", 3, "a", ["2"], False), ("n", 4, "a", ["2"], True), ("n", 5, "b", ["y", "x"], False)]
    h = g.property_history(spark.createDataFrame(events, "node string, at long, key string, vals array<string>, replace boolean"))
    got = sorted((r.key, tuple(r.vals), r.valid_from, r.valid_to) for r in h.collect())
    assert got == [("a", ("1",), 1, 3), ("a", ("2",), 3, None), ("b", ("x", "y"), 1, 4), ("b", ("x", "y"), 5, None)]
    assert sorted(r.valid_from for r in g.property_versions(h).collect()) == [1, 3, 4, 5]


def test_files_of_other_forms_are_errors(spark, tmp_path):
    (tmp_path / "few.stats").write_text("SN\treads mapped:\t5\n")
    with pytest.raises(Exception, match="scalars"):
        t.read_lane_stats(spark, f"{tmp_path}/few.stats").collect()
    header = "\t".join(["#SEQ_ID", "RG", *(f"C{i}" for i in range(17))])
    (tmp_path / "two.selfSM").write_text("\n".join([header, "\t".join(["s"] * 19), "\t".join(["t"] * 19)]) + "\n")
    with pytest.raises(Exception, match="one data row"):
        t.read_contamination(spark, f"{tmp_path}/two.selfSM").collect()
    (tmp_path / "odd.tsv").write_text("head\n" + "\t".join(["A", "rs1", "", "", "", "AG", "1"]) + "\n")
    with pytest.raises(Exception, match="pair"):
        t.read_plex_csv(spark, f"{tmp_path}/odd.tsv").collect()


def test_reads_with_clips_are_duplicates_by_their_unclipped_ends(spark):
    rows = [("a", "L", "1", 110, 64, 50, 100, "10S90M"), ("b", "L", "1", 100, 64, 70, 100, "100M"), ("c", "L", "1", 100, 64 + 16, 70, 100, "90M10S"), ("d", "L", "1", 110, 64 + 16, 60, 90, "90M")]
    reads = spark.createDataFrame(rows, "qname string, lib string, rname string, pos long, flag int, sum_qual int, len int, cigar string")
    assert {r.qname: r.flag & 1024 for r in w.mark_duplicates(reads).collect()} == {"a": 1024, "b": 0, "c": 0, "d": 1024}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from cohortframe.sources.paths import new_dir

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        new_dir(away, "x")


def test_greedy_chunks_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(f, n, rng.choice((0, 0, 3, 40, 250, 1200))) for f, m in (("a", 400), ("b", 1), ("c", 37)) for n in range(m)]
    want = {}
    for name in "abc":
        chunk, held = 1, 0
        for _, _, n in (r for r in rows if r[0] == name):
            if held and held + n > 1000:
                chunk, held = chunk + 1, 0
            held += n
            k = want.setdefault((name, chunk), [0, 0])
            k[0], k[1] = k[0] + 1, k[1] + n
    rng.shuffle(rows)
    got = {(r.file, r.chunk): [r.reads, r.bases] for r in w.split_by_bases(spark.createDataFrame(rows, "file string, row_no long, bases long"), 1000).collect()}
    assert got == want
