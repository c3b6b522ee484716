"""Mini-batch training against numpy, and gradients against finite differences."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelforge.operators import metrics as M
from labelforge.operators import train as TR
from labelforge.operators import vectors as V


def rows(n=90, d=6, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(n, d)) + 2 * np.eye(classes, d)[y], y


def frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, v array<double>, y int").repartition(4)


def numpy_run(x, y, classes, size, epochs, optimizer, seed):
    w, log, step = np.zeros((x.shape[1] + 1, classes)), [], 0
    xb = np.hstack([x, np.ones((len(x), 1))])
    for epoch in range(1, epochs + 1):
        order = sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{seed + epoch}{i}".encode()).hexdigest(), i))
        for k in range(0, len(x), size):
            b = order[k:k + size]
            z = xb[b] @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            loss = -np.log(p[np.arange(len(b)), y[b]]).mean()
            g = xb[b].T @ (p - np.eye(classes)[y[b]]) / len(b)
            step += 1
            log.append((epoch, step, len(b), loss, np.sqrt((g * g).sum())))
            w = optimizer.update(w, g)
    return w, log


@pytest.mark.parametrize("make", [lambda: TR.Sgd(0.3), lambda: TR.AdamW(0.05)])
def test_training_equals_numpy(spark, make):
    x, y = rows()
    df = frame(spark, x, y).unionByName(spark.createDataFrame([(900, None, 1), (901, [0.0] * 6, None)], "id long, v array<double>, y int"))
    weights, log = TR.train_softmax(df, "v", "y", ["id"], 3, 25, 3, make(), seed=5)
    want, steps = numpy_run(x, y, 3, 25, 3, make(), 5)
    assert np.allclose(weights, want, atol=1e-10)
    got = [(r.epoch, r.step, r.rows, r.loss, r.grad_norm) for r in log.orderBy("step").collect()]
    assert np.allclose(got, steps, atol=1e-10) and [r[2] for r in got[:4]] == [25, 25, 25, 15]
    epochs = {r.epoch: r for r in M.epoch_rollup(log).collect()}
    assert abs(epochs[2].train_loss - np.mean([s[3] for s in steps if s[0] == 2])) < 1e-10 and epochs[3].steps == 4
    assert epochs[3].train_loss < epochs[1].train_loss
    found = {r.id: r.prediction for r in TR.predict_softmax(frame(spark, x, y), "v", weights, ["id"]).collect()}
    assert [found[i] for i in range(len(x))] == (np.hstack([x, np.ones((len(x), 1))]) @ want).argmax(1).tolist()


def test_empty_training(spark):
    empty = frame(spark, *rows()).limit(0)
    weights, log = TR.train_softmax(empty, "v", "y", ["id"], 2, 8, 1, TR.Sgd(0.1))
    assert weights.size == 0 and log.count() == 0
    weights, log = TR.train_projection(empty.withColumn("b", F.lit(0)), "b", "v", "y", 2, 1, TR.Sgd(0.1))
    assert weights.size == 0 and log.count() == 0


@pytest.mark.parametrize("block", [3, 512])
@pytest.mark.parametrize("loss", ["supcon", "ntxent"])
def test_gradients_by_finite_differences(monkeypatch, loss, block):
    monkeypatch.setattr(V, "_blocks", lambda n: [np.arange(k, min(k + block, n)) for k in range(0, n, block)])
    rng = np.random.default_rng(4)
    z, labels = rng.normal(size=(11, 4)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 0, 4, 5])
    forward = {"supcon": lambda a: V.supcon_batch(a, labels, None, 0.2, 0.1, np.ones(11, bool)).mean(),
               "ntxent": lambda a: V.ntxent_batch(a, labels, 0.1, 0.2)}[loss]
    value, got = {"supcon": lambda: V.supcon_gradient(z, labels, 0.2, 0.1), "ntxent": lambda: V.ntxent_gradient(z, labels, 0.2)}[loss]()
    assert abs(value - forward(z)) < 1e-9
    want = np.zeros_like(z)
    for i in np.ndindex(z.shape):
        step = np.zeros_like(z)
        step[i] = 1e-6
        want[i] = (forward(z + step) - forward(z - step)) / 2e-6
    assert np.allclose(got, want, atol=1e-6)


def test_gradient_without_positives():
    z = np.random.default_rng(0).normal(size=(3, 2))
    for gradient in (V.supcon_gradient, V.ntxent_gradient):
        value, dz = gradient(z, np.array([0, 1, 2]))
        assert value == 0 and not dz.any()


@pytest.mark.parametrize("loss", ["supcon", "ntxent"])
def test_projection_training_lowers_the_loss(spark, loss):
    x, y = rows(96, 8, 4)
    df = frame(spark, x, y).withColumn("b", (F.col("id") / 16).cast("long"))
    weights, log = TR.train_projection(df, "b", "v", "y", 3, 8, TR.AdamW(0.05, decay=0.0), together=4, loss=loss, temperature=0.5)
    per = {r.epoch: r.train_loss for r in M.epoch_rollup(log).collect()}
    assert weights.shape == (8, 3) and per[8] < 0.9 * per[1]
    assert [r.rows for r in log.orderBy("step").limit(2).collect()] == [4, 2]  # mini-batches of a step
    # the first step is the mean of its batches' losses and gradients
    start = np.random.default_rng(0).normal(size=(8, 3)) / np.sqrt(8)
    one = {"supcon": V.supcon_gradient, "ntxent": V.ntxent_gradient}[loss]
    parts = [one(x[k:k + 16] @ start, y[k:k + 16], temperature=0.5) for k in range(0, 64, 16)]
    first = log.where("step = 1").first()
    assert abs(first.loss - np.mean([v for v, _ in parts])) < 1e-9
    assert abs(first.grad_norm - np.linalg.norm(np.mean([x[k:k + 16].T @ d for k, (_, d) in zip(range(0, 64, 16), parts)], axis=0))) < 1e-9


def test_gradients_of_all_batches(spark):
    x, y = rows(40, 5)
    df = frame(spark, x, y).withColumn("b", F.col("id") % 3)
    got = {r.id: r for r in V.supcon_gradients(df, "b", "id", "v", "y").collect()}
    for b in range(3):
        mine = pd.Index(range(b, 40, 3))
        order = sorted(mine, key=lambda i: i)
        loss, dz = V.supcon_gradient(x[order], y[order])
        for i, d in zip(order, dz):
            assert np.allclose(got[i].gradient, d, atol=1e-9) and abs(got[i].loss - loss) < 1e-9
