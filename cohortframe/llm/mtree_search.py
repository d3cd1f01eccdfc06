"""Exact top-k search by inner product with M-trees.

Vectors are given one more component, sqrt(M² - |x|²) with M the largest norm
of all, and queries a zero: then squared Euclidean distance is |q|² + M² - 2 q·x,
and the nearest are those of highest inner product, so a metric tree applies.
Rows are dealt to trees by nearest pivot, of which there are more where there
are more rows, and, where a pivot has many, by their number in the written
table, so copies in any number spread. A tree is a table of pages: an inner page has
routing vectors with covering radii and distances to the page's own routing
vector, a leaf has vectors with their distances. A query goes best first, by
the least distance that a page can hold, and skips an entry without computing
its distance where |d(query, parent) - d(entry, parent)| - radius already
exceeds the k-th best. First each query searches the trees of its nearest
pivot; with the k-th score found there it goes only to trees whose ball can
still reach it. Bounds have a slack for rounding; scores are exact integers.

Queries meet trees in blocks of at most QUERIES with the same nearest pivot; a
tree's pages are sent once to each block that asks for it, and to no other.

Cases: vectors that are null, empty or hold null or non-finite components take
no part; of rows with one vec_id all are candidates, and none is one for a
query with that vec_id, asked once, by its first vector in array order; null
vec_id takes no part; shorter vectors count as filled up with zeros; ties go to
smaller vec_id; fewer candidates than k give fewer rows; an empty table gives
none; sums beyond 2^53 are computed in Python's integers; other columns are ignored."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS, MOST_PIVOTS, TREE, LEAF, FAN, QUERIES = 64, 4096, 8192, 128, 16, 2048


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)))


def build_pages(x: np.ndarray, ids: np.ndarray) -> list[dict]:
    """Pages of the M-tree over the rows of x: page 0 is the root; a child entry names its page."""
    pages: list[dict] = []

    def page(rows: np.ndarray, centre: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        to_centre = _distances(x[rows], centre[None, :])[:, 0]
        if len(rows) <= LEAF:
            pages[number] = {"leaf": True, "rows": x[rows], "ids": ids[rows], "parent": to_centre, "centre": centre}
            return number
        # routing vectors: one after another the farthest from those chosen
        chosen, nearest = [int(to_centre.argmax())], None
        for _ in range(FAN - 1):
            d = _distances(x[rows], x[rows[chosen[-1]]][None, :])[:, 0]
            nearest = d if nearest is None else np.minimum(nearest, d)
            if nearest.max() <= 0:
                break
            chosen.append(int(nearest.argmax()))
        d = _distances(x[rows], x[rows[chosen]])
        own = d.argmin(axis=1)
        if len(chosen) == 1 or np.bincount(own).max() == len(rows):
            own = np.arange(len(rows)) * FAN // len(rows)  # all alike: any division does
            chosen = [int(np.flatnonzero(own == k)[0]) for k in range(FAN)]
            d = _distances(x[rows], x[rows[chosen]])
        entries = [(k, np.flatnonzero(own == k)) for k in range(len(chosen)) if (own == k).any()]
        made = {"leaf": False, "rows": x[rows[[chosen[k] for k, _ in entries]]], "radius": np.array([d[at, k].max() for k, at in entries]), "parent": to_centre[[chosen[k] for k, _ in entries]], "centre": centre}
        pages[number] = made
        made["child"] = np.array([page(rows[at], x[rows[chosen[k]]]) for k, at in entries])
        return number

    page(np.arange(len(x)), x.mean(axis=0))
    return pages


def search(pages: dict[int, dict], query: np.ndarray, own_id: int, k: int, at_least: float, sum_of_squares: float, exact) -> list[tuple[int, int]]:
    """The k best (score, vec_id) with score >= at_least, best first. sum_of_squares: |q|² + M²."""
    slack = 1e-6 * (1 + np.sqrt(sum_of_squares))
    best: list[tuple[float, int]] = []  # heap of (score, -vec_id), worst on top

    def reach() -> float:
        score = max(at_least, best[0][0] if len(best) == k else -np.inf)
        return np.inf if score == -np.inf else np.sqrt(max(0.0, sum_of_squares - 2 * score)) + slack

    root = pages[0]
    todo = [(0.0, 0, float(np.sqrt(((query - root["centre"]) ** 2).sum())))]
    while todo:
        low, number, to_centre = heapq.heappop(todo)
        far = reach()
        if low > far:
            break
        p = pages[number]
        bound = np.abs(to_centre - p["parent"]) - (0 if p["leaf"] else p["radius"])
        at = np.flatnonzero(bound <= far + slack)
        if not len(at):
            continue
        if p["leaf"]:
            ids = p["ids"][at]
            at, ids = at[ids != own_id], ids[ids != own_id]
            for score, vec_id in zip(exact(p["rows"][at, :-1], query[:-1]), ids.tolist(), strict=True):
                if score >= at_least:
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec_id))
                    elif (score, -vec_id) > best[0]:
                        heapq.heapreplace(best, (score, -vec_id))
        else:
            d = _distances(p["rows"][at], query[None, :])[:, 0]
            for child, dist, radius in zip(p["child"][at].tolist(), d.tolist(), p["radius"][at].tolist(), strict=True):
                low = max(0.0, dist - radius)
                if low <= far:
                    heapq.heappush(todo, (low, child, dist))
    return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def exact_products(largest_square: float):
    """Inner products of integer rows with an integer vector: in doubles where no sum can pass 2^53."""
    if largest_square < 2**53:
        return lambda rows, q: (rows @ q).tolist()
    return lambda rows, q: [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows]


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(lengths.sum()) - starts[rows]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _raised(x: np.ndarray, largest_square: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, largest_square - (x * x).sum(axis=1)))[:, None]])


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: for each query row (vec_id, v array<long>) its k highest inner products."""
    base = stored(rows.select("vec_id", "v", is_query.alias("is_query")), "search-rows")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sums = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("m2"), F.sum(F.col("is_query").cast("long")).alias("nq")).first()
    schema = "query_id long, score long, vec_id long"
    if not sums["n"] or not sums["nq"]:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, m2, exact = sums["dim"], sums["m2"], exact_products(sums["m2"])
    wanted = min(MOST_PIVOTS, max(PIVOTS, sums["n"] // TREE))
    sample = base.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id", "v").limit(wanted).select("v").distinct().toArrow()
    pivots = _raised(_dense(sample.column("v"), dim), m2)

    def to_pivot(batches):
        for batch in batches:
            x = _dense(batch.column("v"), dim)
            d = _distances(_raised(x, m2), pivots)
            own = d.argmin(axis=1)
            home, at = own.copy(), np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False))
            if len(at):
                home[at] = _distances(np.hstack([x[at], np.zeros((len(at), 1))]), pivots).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own]), pa.array(home.astype(np.int32))], [*batch.schema.names, "pivot", "far", "home"])

    placed = base.mapInArrow(to_pivot, "vec_id long, v array<long>, is_query boolean, pivot int, far double, home int")
    placed = stored(placed.withColumn("number", F.monotonically_increasing_id()), "placed")
    about = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row a pivot
    trees = {r["pivot"]: -(-r["n"] // TREE) for r in about}
    radius = np.array([next((r["radius"] for r in about if r["pivot"] == p), -np.inf) for p in range(len(pivots))])
    n_trees = F.element_at(F.create_map(*(F.lit(x) for p, n in trees.items() for x in (p, n))), F.col("pivot"))

    def build(group: pa.Table) -> pa.Table:
        found = build_pages(_raised(_dense(group.column("v"), dim), m2), group.column("vec_id").to_numpy())
        return pa.table({"pivot": pa.array([group.column("pivot")[0].as_py()] * len(found), pa.int32()), "tree": pa.array([group.column("tree")[0].as_py()] * len(found), pa.int32()), "page": pa.array(range(len(found)), pa.int32()), "data": pa.array([pickle.dumps(p) for p in found], pa.binary())})

    dealt = placed.select("vec_id", "v", "pivot", F.pmod(F.xxhash64("number"), n_trees).cast("int").alias("tree"))
    pages = stored(dealt.groupBy("pivot", "tree").applyInArrow(build, "pivot int, tree int, page int, data binary"), "pages")
    asked = placed.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("v", "home")).alias("q")).select("vec_id", "q.v", "q.home")
    asked = stored(asked, "queries")
    blocks = {r["home"]: -(-r["count"] // QUERIES) for r in asked.groupBy("home").count().collect()}  # a row a pivot
    n_blocks = F.element_at(F.create_map(*(F.lit(x) for p, n in blocks.items() for x in (p, n))), F.col("home"))
    asked = asked.withColumn("block", F.concat_ws("/", "home", F.pmod(F.xxhash64("vec_id", F.lit("block")), n_blocks)))

    def routed(queries: DataFrame, home: bool) -> DataFrame:
        """queries with each pivot to search: the nearest, or all others whose ball can hold a score of at_least."""

        def route(batches):
            for batch in batches:
                x = _dense(batch.column("v"), dim)
                q = np.hstack([x, np.zeros((len(x), 1))])
                d = _distances(q, pivots)
                d[:, np.isinf(radius)] = np.inf
                own = d.argmin(axis=1)
                total = (x * x).sum(axis=1) + m2
                reach = np.sqrt(np.maximum(0, total - 2 * batch.column("at_least").to_numpy(zero_copy_only=False))) + 1e-6 * (1 + np.sqrt(total))
                go = np.zeros(d.shape, bool)
                if home:
                    go[np.arange(len(own)), own] = True
                else:
                    go = d - radius[None, :] <= reach[:, None]
                    go[np.arange(len(own)), own] = False
                at, to = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(to.astype(np.int32))], [*batch.schema.names, "pivot"])

        found = queries.mapInArrow(route, "vec_id long, v array<long>, block string, at_least double, pivot int")
        return found.withColumn("tree", F.explode(F.sequence(F.lit(0), n_trees - 1)))

    def answer(queries: pa.Table, own: pa.Table) -> pa.Table:
        held = {p: pickle.loads(d) for p, d in zip(own.column("page").to_pylist(), own.column("data").to_pylist(), strict=True)} if queries.num_rows else {}
        out: list[tuple[int, int, int]] = []
        if held:
            x = _dense(queries.column("v"), dim)
            q = np.hstack([x, np.zeros((len(x), 1))])
            for i, (own_id, least) in enumerate(zip(queries.column("vec_id").to_pylist(), queries.column("at_least").to_pylist(), strict=True)):
                out += [(own_id, s, v) for s, v in search(held, q[i], own_id, k, least, float((x[i] * x[i]).sum()) + m2, exact)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "score", "vec_id"])

    keys = ["pivot", "tree", "block"]

    def searched(queries: DataFrame, home: bool) -> DataFrame:
        going = stored(routed(queries.select("vec_id", "v", "block", "at_least"), home), "routed")
        sent = pages.join(going.select(*keys).distinct().toDF(*keys), ["pivot", "tree"])
        return going.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(answer, schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    at_home = searched(asked.withColumn("at_least", F.lit(float("-inf"))), True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    at_home = stored(at_home.drop("rank"), "at-home")
    kth = at_home.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    at_least = F.when(F.col("n") >= k, F.col("worst").cast("double")).otherwise(F.lit(float("-inf")))
    further = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "block", F.coalesce(at_least, F.lit(float("-inf"))).alias("at_least"))
    found = at_home.unionByName(searched(further, False)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id and v: floor(256 x) of every component; rows that take no part are gone."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select("vec_id", F.transform(v, lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, F.col("vec_id") % 50 == 0, k=5)
