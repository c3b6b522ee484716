"""V13 beyond PCA: a nearest-neighbour graph by random-projection trees and a
layout that keeps neighbours together, by attraction along the graph and
repulsion from sampled points.

A tree halves its nodes level by level at the median of a random projection; the
medians are one aggregation per level, and a tiny hash of the key breaks ties, so
that equal vectors, however many, are halved too.  Points of a leaf are compared
with each other, and a point's best neighbours over all trees are kept: a task
holds one leaf.  The layout is a table of positions; a round joins it to the
edges and to the sampled points and adds up one step per point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.operators.teacher import running_total
from labelforge.session import scratch_path

TREES, LEAF = 24, 192


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _points(df: DataFrame, key: str, vec: str) -> DataFrame:
    # floats stay floats on their way: the tasks compute with doubles
    narrow = df.select(vec).schema[0].dataType == T.ArrayType(T.FloatType(), df.select(vec).schema[0].dataType.containsNull)
    v = F.col(vec) if narrow else F.transform(vec, lambda x: x.cast("double"))
    return df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("key"), v.alias("v"))


def tree_leaves(points: DataFrame, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> DataFrame:
    """``key, tree, node``: the leaf of every point in every tree, of about ``leaf`` points at most."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees * max(depth, 1)))
                along = (x @ planes).reshape(len(x) * trees, -1)
                flat = pa.array(along.reshape(-1))
                offsets = pa.array(np.arange(len(along) + 1, dtype=np.int32) * along.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("key").to_numpy(), trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(x))),
                                                  pa.ListArray.from_arrays(offsets, flat)], names=["key", "tree", "along"])

    now = points.mapInArrow(project, "key bigint, tree int, along array<double>").withColumn("node", F.lit(0).cast("bigint"))
    for level in range(depth):
        now = _kept(spark, now, "tree-level")
        # ties: a shift far below the spread of the projections
        place = F.col("along")[0] + F.xxhash64("key", F.lit(level)) / F.lit(2.0**63) * F.lit(1e-9)
        middle = now.groupBy("tree", "node").agg(F.percentile_approx(place, 0.5, 2000).alias("middle"))
        # a level's projection is used up with it
        now = now.join(middle, ["tree", "node"]).select("key", "tree", F.expr("slice(along, 2, size(along))").alias("along"), (F.col("node") * 2 + (place > F.col("middle")).cast("int")).alias("node"))
    return now.select("key", "tree", "node")


def nearest_neighbours(df: DataFrame, key: str, vec: str, k: int = 15, trees: int = TREES, leaf: int = LEAF, seed: int = 0,
                       refine: int = 1) -> DataFrame:
    """``key, neighbour, distance, place``: about the ``k`` nearest other points of
    each point by Euclidean distance (place 1 is the nearest; ties by key).

    Approximate: two near points are found if they share a leaf in some tree, or if
    one is a neighbour's neighbour of the other (``refine`` rounds, each comparing
    a point with at most ``k * k`` more).  Rows without key or vector are left out;
    keys are unique integers."""
    spark = df.sparkSession
    points = _kept(spark, _points(df, key, vec), "points")
    leaves = tree_leaves(points, trees, leaf, seed).join(points, "key")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        x, keys = _matrix(t.column("v")), t.column("key").to_numpy()
        out = []
        square = (x * x).sum(axis=1)
        for start in range(0, len(x), 512):
            rows = np.arange(start, min(start + 512, len(x)))
            d = np.maximum(square[rows, None] + square[None, :] - 2 * (x[rows] @ x.T), 0.0)
            d[np.arange(len(rows)), rows] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
            for i, js in zip(rows, best, strict=True):
                # from the difference: the expanded form loses digits where points are close
                out.append((np.full(len(js), keys[i]), keys[js], np.sqrt(((x[js] - x[i]) ** 2).sum(axis=1))))
        one, two, far = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"key": pa.array(one, pa.int64()), "neighbour": pa.array(two, pa.int64()), "distance": pa.array(far, pa.float64())})

    found = leaves.groupBy("tree", "node").applyInArrow(compare, "key bigint, neighbour bigint, distance double")
    nearest = _kept(spark, _best(found, k), "neighbours")
    for _ in range(refine):
        mine = nearest.select("key", "neighbour")
        # both ends of a pair meet at the neighbour between them: a vector travels once for
        # each edge, not once for each pair
        to = mine.join(points, "key").select("key", F.col("neighbour").alias("over"), "v")
        on = mine.select(F.col("key").alias("over"), F.col("neighbour").alias("other")).join(
            points.select(F.col("key").alias("other"), F.col("v").alias("w")), "other").select("other", "over", "w")
        both = to.groupBy("over").cogroup(on.groupBy("over")).applyInArrow(_pairs, "key bigint, neighbour bigint, distance double")
        nearest = _kept(spark, _best(both.unionByName(nearest.select("key", "neighbour", "distance")), k), "neighbours")
    return nearest


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each point's ``k`` nearest of the found pairs (dealt by point once, for both steps)."""
    once = found.repartition("key").groupBy("key", "neighbour").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("key").orderBy("distance", "neighbour")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _pairs(to: pa.Table, on: pa.Table) -> pa.Table:
    """Distances from the points that have a neighbour to that one's neighbours."""
    if not (to.num_rows and on.num_rows):  # a point without neighbours, or one that is nobody's
        return pa.table({"key": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    x, y, far = _matrix(to.column("v")), _matrix(on.column("w")), on.column("other").to_numpy()
    found = []
    for i, key in enumerate(to.column("key").to_pylist()):
        other = far != key
        found.append((np.full(int(other.sum()), key), far[other], np.sqrt(((x[i] - y[other]) ** 2).sum(axis=1))))
    one, two, d = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"key": pa.array(one, pa.int64()), "neighbour": pa.array(two, pa.int64()), "distance": pa.array(d, pa.float64())})


def neighbour_layout(df: DataFrame, key: str, vec: str, dimensions: int = 2, k: int = 15, rounds: int = 30, negatives: int = 5,
                     rate: float = 1.0, seed: int = 0, neighbours: DataFrame | None = None) -> DataFrame:
    """``key, position``: a layout in which neighbours lie together.

    Points start along random projections of their vectors, of unit spread.  In
    a round each point moves along the summed gradient of
    ``log(1 + d²)`` over its graph edges (both directions) and of
    ``-log(d² / (1 + d²))`` over ``negatives`` sampled points, each coordinate of
    a gradient cut at 4; the rate falls linearly to zero.  The sample of a round
    is a hash of point, round and number, so a layout is the same at every run."""
    spark = df.sparkSession
    points = _points(df, key, vec)
    edges = neighbours if neighbours is not None else nearest_neighbours(df, key, vec, k, seed=seed)
    pairs = edges.select("key", F.col("neighbour").alias("other")).unionByName(edges.select(F.col("neighbour").alias("key"), F.col("key").alias("other"))).distinct()
    pairs = _kept(spark, pairs, "graph")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                y = x @ np.random.default_rng(seed + 1).normal(size=(x.shape[1], dimensions))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(list(y), pa.list_(pa.float64()))], names=["key", "y"])

    first = points.mapInArrow(start, "key bigint, y array<double>")
    slotted = running_total(first, ["key"], F.lit(1), out="slot").select("key", (F.col("slot") - 1).alias("slot"), "y")
    now = _kept(spark, slotted, "positions")
    spread = [F.stddev_pop(F.col("y")[i]).alias(f"s{i}") for i in range(dimensions)]
    stats = now.agg(F.count("*").alias("n"), *spread).first()
    n = stats.n
    if n < 2:
        return now.select("key", F.col("y").alias("position"))
    now = now.withColumn("y", F.array(*[F.col("y")[i] / (stats[f"s{i}"] or 1.0) for i in range(dimensions)]))
    zero = F.array(*[F.lit(0.0)] * dimensions)

    for r in range(rounds):
        step = rate * (1 - r / rounds)
        there = now.select(F.col("key").alias("other"), F.col("slot").alias("at"), F.col("y").alias("z"))
        apart = [F.col("y")[i] - F.col("z")[i] for i in range(dimensions)]
        d2 = sum((a * a for a in apart[1:]), apart[0] * apart[0])
        cut = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
        pull = now.join(pairs, "key").join(there.drop("at"), "other").withColumn("d2", d2).select(
            "key", *[cut(-2 * a / (1 + F.col("d2"))).alias(f"g{i}") for i, a in enumerate(apart)])
        drawn = F.array(*[F.pmod(F.xxhash64("key", F.lit(r), F.lit(s), F.lit(seed)), F.lit(n)) for s in range(negatives)])
        push = (now.withColumn("at", F.explode(drawn)).where("at <> slot").join(there.drop("other"), "at").withColumn("d2", d2).select(
            "key", *[cut(2 * a / ((0.001 + F.col("d2")) * (1 + F.col("d2")))).alias(f"g{i}") for i, a in enumerate(apart)]))
        moves = pull.unionByName(push).groupBy("key").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(dimensions)])
        moved = now.join(moves, "key", "left").select("key", "slot", F.when(F.col("g0").isNull(), F.zip_with("y", zero, lambda a, b: a + b)).otherwise(
            F.array(*[F.col("y")[i] + F.lit(step / (2 * k)) * F.col(f"g{i}") for i in range(dimensions)])).alias("y"))
        now = _kept(spark, moved, "positions")
    return now.select("key", F.col("y").alias("position"))
