"""Neighbour graph and layout against brute force."""

import numpy as np
from pyspark.sql import functions as F

from conftest import MEDIUM
from labelforge.operators import neighbours as N
from labelforge.session import table


def exact(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sqrt(np.sort(d, axis=1)[:, :k])


def recall(got, want):
    return np.mean([len(set(got.get(i, ())) & set(w)) / len(w) for i, w in enumerate(want)])


def test_recall_on_the_embeddings(spark):
    rows = table(spark, MEDIUM, "embeddings").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    got = {}
    for r in N.nearest_neighbours(table(spark, MEDIUM, "embeddings"), "vec_id", "embedding", 10).collect():
        got.setdefault(r.key, {})[r.place] = (r.neighbour, r.distance)
    want, far = exact(x, 10)
    assert recall({i: [n for n, _ in g.values()] for i, g in got.items()}, want) >= 0.9
    assert all(sorted(g) == list(range(1, 11)) for g in got.values())
    assert all(abs(np.linalg.norm(x[i] - x[n]) - d) < 1e-9 for i, g in got.items() for n, d in g.values())
    assert np.mean([abs(got[i][1][1] - far[i][0]) < 1e-9 for i in range(len(x))]) >= 0.9


def test_equal_vectors_are_halved(spark):
    """A third of all points has one vector: no leaf is larger for it."""
    rng = np.random.default_rng(2)
    x = [[1.0, 2.0, 3.0]] * 300 + rng.normal(size=(600, 3)).tolist()
    points = N._points(spark.createDataFrame(list(enumerate(x)), "id int, v array<double>"), "id", "v")
    leaves = N.tree_leaves(points, 3, 50).groupBy("tree", "node").count().collect()
    assert max(r["count"] for r in leaves) <= 75 and sum(r["count"] for r in leaves) == 2700
    got = N.nearest_neighbours(spark.createDataFrame(list(enumerate(x)), "id int, v array<double>"), "id", "v", 3, 3, 50)
    assert got.where("key < 300 AND distance > 1e-12").count() == 0


def test_layout_keeps_neighbours(spark):
    rng = np.random.default_rng(3)
    group = np.repeat(np.arange(6), 25)
    x = rng.normal(size=(6, 20))[group] * 1.5 + rng.normal(size=(150, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").withColumn("key", F.lit(0)).withColumn("y", F.lit(0))
    near = N.nearest_neighbours(df, "id", "v", 8)
    got = {r.key: r.position for r in N.neighbour_layout(df, "id", "v", 2, 8, rounds=12, neighbours=near).collect()}
    y = np.array([got[i] for i in range(150)])
    flat = x @ np.random.default_rng(1).normal(size=(20, 2))
    kept = lambda z: np.mean(group[exact(z, 8)[0]] == group[:, None])
    assert y.shape == (150, 2) and np.isfinite(y).all()
    assert kept(y) >= 0.9 > kept(flat)


def test_small_and_empty_tables(spark):
    schema = "id long, v array<double>"
    for rows, n in (([], 0), ([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, None)], 0), ([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], 6)):
        df = spark.createDataFrame(rows, schema)
        assert N.nearest_neighbours(df, "id", "v", 5).count() == n
    assert N.neighbour_layout(spark.createDataFrame([], schema), "id", "v").collect() == []
    assert len(N.neighbour_layout(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], schema), "id", "v", rounds=2).collect()) == 2
