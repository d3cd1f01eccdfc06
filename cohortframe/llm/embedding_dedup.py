"""Embedding near-deduplication by PCA-ordered tiled comparison.

Equal vectors of a label become one with a count. Unit vectors are rotated
onto principal axes. Vectors linked at cosine t are at most sqrt(2 - 2t)
apart, so a grid of that width over the two leading axes leaves only adjacent
cells to compare; cells are dealt into blocks of bounded size and each two
blocks meet in a task group of their own, a tile. In a tile the leading
dimensions are multiplied first; the rest of a product is at most the product
of the suffix norms, and a pair leaves as soon as even that cannot reach t.
Survivors are confirmed by cosine on the vectors as given. A tile returns, for
each of its vectors, how many it links with and the smallest one that it
reaches there, never its pairs.

The rotation of a vector length is fitted on a bounded sample (SAMPLE vectors
chosen by hash), for the AXES commonest lengths; vectors of other lengths keep
their own axes. Being a rotation, it changes speed, not results.

Cases: vectors that are null, zero, or hold null or non-finite components, and
rows with null label or null vec_id, link with nothing and are kept;
vectors of different length never link, and there may be any number of
lengths; rows with one vec_id are separate vectors, each with its own links and
component, of which the smallest vec_id is the name; an empty table gives no
rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .components import components

SAMPLE, AXES, BLOCK, STAGES, CHUNK, STRIP = 4096, 16, 4096, (8, 16, 32), 50_000, 256
#: Rows up to which a table of ids is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
CELL = ["label", "dim", "c0", "c1"]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable() -> F.Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For the AXES commonest vector lengths, principal axes of a bounded sample of unit vectors, longest first."""
    found = {}
    lengths = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(AXES).collect()]
    for dim in lengths:
        rows = vectors.filter(F.col("dim") == dim).select("key", "embedding").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
        x = _matrix(rows.column("embedding"))
        x = _unit(x)
        _, axes = np.linalg.eigh(x.T @ x)
        found[dim] = axes[:, ::-1]
    return found


def _rotated(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return _unit(x) if axes is None else _unit(x) @ axes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_in_tile(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of x and y, or i < j of x with itself, with cosine of at least `least`; STRIP rows of x at a time."""
    ry = _rotated(y, axes)
    parts = [_linked(x[a : a + STRIP], y, _rotated(x[a : a + STRIP], axes), ry, least, a if same else None) for a in range(0, len(x), STRIP)]
    return (np.concatenate([i + a * STRIP for a, (i, _) in enumerate(parts)]), np.concatenate([j for _, j in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _linked(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, least: float, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    cuts = [c for c in STAGES if c < rx.shape[1]] + [rx.shape[1]]
    rest = [(np.sqrt(np.maximum(0, (rx[:, c:] ** 2).sum(axis=1))), np.sqrt(np.maximum(0, (ry[:, c:] ** 2).sum(axis=1)))) for c in cuts]
    slack = 1e-9
    near = rx[:, : cuts[0]] @ ry[:, : cuts[0]].T
    alive = near + np.outer(*rest[0]) >= least - slack
    if first is not None:
        alive &= first + np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
    i_all, j_all = np.nonzero(alive)
    out_i, out_j = [], []
    for a in range(0, len(i_all), CHUNK):
        i, j = i_all[a : a + CHUNK], j_all[a : a + CHUNK]
        product = near[i, j]
        for before, after, (sx, sy) in zip(cuts[:-1], cuts[1:], rest[1:], strict=True):
            product = product + np.einsum("ij,ij->i", rx[i, before:after], ry[j, before:after])
            keep = product + sx[i] * sy[j] >= least - slack
            i, j, product = i[keep], j[keep], product[keep]
        sure = np.einsum("ij,ij->i", x[i], y[j]) / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(y[j], axis=1)) >= least if len(i) else np.zeros(0, bool)
        out_i.append(i[sure])
        out_j.append(j[sure])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that it reaches by the given links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tiles(vectors: DataFrame, least: float) -> DataFrame:
    """vectors, each repeated for every tile that it is part of."""
    cells = stored(vectors.groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cells")
    steps = F.array(*(F.struct(F.lit(a).alias("d0"), F.lit(b).alias("d1")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    beside = cells.select(*CELL, F.col("blocks").alias("own_blocks"), F.explode(steps).alias("d")).select(*CELL, "own_blocks", (F.col("c0") + F.col("d.d0")).alias("o0"), (F.col("c1") + F.col("d.d1")).alias("o1"))
    beside = beside.join(cells.toDF("label", "dim", "o0", "o1", "blocks"), ["label", "dim", "o0", "o1"])
    beside = stored(beside, "beside")
    placed = vectors.join(F.broadcast(beside) if beside.count() <= BROADCAST_ROWS else beside, CELL)
    own = F.struct(F.col("c0"), F.col("c1"), F.pmod(F.xxhash64("key"), F.col("own_blocks")).cast("int").alias("block"))
    met = placed.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("other", F.struct(F.col("o0").alias("c0"), F.col("o1").alias("c1"), F.col("to").alias("block")))
    return met.select("label", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("is_low"), "key", "copies", "embedding")


def near_vectors(rows: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (vec_id, embedding, label)."""
    own_key = F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>"))))
    base = rows.select("vec_id", "embedding", "label").withColumn("usable", _usable())
    base = base.withColumn("key", F.when(F.col("usable"), own_key))
    vectors = base.filter("usable").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    vectors = stored(vectors.withColumn("dim", F.size("embedding")), "vectors")
    axes = rotations(vectors)
    width = float(np.sqrt(2 - 2 * least) + 1e-9)

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            c = np.zeros((2, batch.num_rows), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                lead = _rotated(_matrix(batch.column("embedding").take(pa.array(at))), axes.get(int(dim)))[:, :2]
                for k in range(lead.shape[1]):
                    c[k, at] = np.floor(lead[:, k] / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c[0]), pa.array(c[1])], [*batch.schema.names, "c0", "c1"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = stored(vectors.mapInArrow(place, f"{schema}, c0 int, c1 int"), "placed")

    def compare(tile: pa.Table) -> pa.Table:
        low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
        same, of_low = low == high, tile.column("is_low").to_numpy()
        x_at = np.flatnonzero(of_low)
        y_at = x_at if same else np.flatnonzero(~of_low)
        data = _matrix(tile.column("embedding"))
        i, j = linked_in_tile(data[x_at], data[y_at], axes.get(tile.column("dim")[0].as_py()), least, same)
        i, j = x_at[i], y_at[j]
        copies, n = tile.column("copies").to_numpy(), tile.num_rows
        reached = smallest_reached(n, i, j)
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        found = np.flatnonzero(links > 0)
        keys = tile.column("key").combine_chunks() if isinstance(tile.column("key"), pa.ChunkedArray) else tile.column("key")
        return pa.table({"key": keys.take(pa.array(found)), "links": pa.array(links[found].astype(np.int64)), "reached": keys.take(pa.array(reached[found]))})

    met = stored(tiles(placed, least).groupBy("label", "dim", "low", "high").applyInArrow(compare, "key binary, links long, reached binary"), "met")
    found = stored(components(met.select(F.col("key").alias("u"), F.col("reached").alias("v")).filter("u <> v")), "components").select(F.col("node").alias("key"), "component")
    # tables of one row a vector, joined by it; then to the rows, whose copies may be very many
    linked = stored(vectors.select("key", "rep").join(found, "key"), "linked")
    named = linked.join(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("key", "component_id")
    about = vectors.select("key", "rep", "copies").join(met.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(named, "key", "left")
    about = stored(about.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "about")
    joined = base.select("vec_id", "key").join(F.broadcast(about) if about.count() <= BROADCAST_ROWS else about, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
