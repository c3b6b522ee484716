"""Pooling, normalisation and contrastive losses against direct numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.operators import vectors as V


def ref_supcon(z, labels, temperature=0.07, base=0.07):
    """Matrix form of the supervised contrastive loss (one view per sample)."""
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    logits = z @ z.T / temperature
    logits = logits - logits.max(axis=1, keepdims=True)
    n = len(z)
    mask = (labels[:, None] == labels[None, :]).astype(float)
    lmask = 1 - np.eye(n)
    mask = mask * lmask
    exp = np.exp(logits) * lmask
    log_prob = logits - np.log(exp.sum(1, keepdims=True) + 1e-12)
    mlpp = (mask * log_prob).sum(1) / np.maximum(mask.sum(1), 1e-12)
    return float((-(temperature / base) * mlpp).mean())


def test_supcon_matches_matrix_form(spark):
    rng = np.random.default_rng(0)
    rows = []
    for b in range(4):
        z = rng.normal(size=(12, 8))
        labels = rng.integers(0, 4, size=12)
        labels[0] = 99  # an anchor without positives
        rows += [(b, i + 100 * b, int(labels[i]), z[i].tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "batch_id long, vec_id long, label int, embedding array<double>")
    got = {r.batch_id: r.loss for r in V.supcon_loss(df, "batch_id", "embedding").collect()}
    for b in range(4):
        sub = [r for r in rows if r[0] == b]
        z = np.array([r[3] for r in sub])
        labels = np.array([r[2] for r in sub])
        assert got[b] == pytest.approx(ref_supcon(z, labels), abs=1e-12)


def test_supcon_rotation_invariant(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(10, 6))
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    labels = rng.integers(0, 3, size=10)
    mk = lambda m: spark.createDataFrame([(0, i, int(labels[i]), m[i].tolist()) for i in range(10)],
                                         "batch_id long, vec_id long, label int, embedding array<double>")
    a = V.supcon_loss(mk(z), "batch_id", "embedding").first().loss
    b = V.supcon_loss(mk(z @ q), "batch_id", "embedding").first().loss
    assert a == pytest.approx(b, abs=1e-9)


def test_supcon_argument_checks(spark):
    df = spark.createDataFrame([(0, [1.0])], "batch_id long, embedding array<double>")
    with pytest.raises(ValueError):
        V.supcon_loss(df, "batch_id", "embedding", label=None, sample=None)
    with pytest.raises(ValueError):
        V.supcon_loss(df, "batch_id", "embedding", mode="bad")


def test_pooling(spark):
    rows = [(0, 0, 1, [1.0, 2.0]), (0, 1, 1, [3.0, 4.0]), (0, 2, 0, [100.0, 100.0]),
            (1, 0, 0, [5.0, 5.0]), (1, 1, 0, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "seq long, pos int, mask int, vec array<double>")
    mean = {r.seq: r.pooled for r in V.mean_pool(df, "seq", "vec", 2).collect()}
    masked = {r.seq: r.pooled for r in V.masked_mean_pool(df, "seq", "vec", "mask", 2).collect()}
    first = {r.seq: r.pooled for r in V.first_token(df, "seq", "vec", "pos").collect()}
    assert mean[0] == pytest.approx([104 / 3, 106 / 3]) and mean[1] == [6.0, 6.0]
    assert masked[0] == [2.0, 3.0] and masked[1] == [0.0, 0.0]  # fully masked: sum / max(0, 1)
    assert first == {0: [1.0, 2.0], 1: [5.0, 5.0]}


def test_l2_normalize_zero_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [r[0] for r in df.select(V.l2_normalize("v")).collect()]
    assert out == [[0.6, 0.8], [0.0, 0.0]]


def test_batches_exact_sizes(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    for mode in ("ordered", "shuffled"):
        sizes = [r[1] for r in V.assign_batches(df, 10, ["k"], mode).groupBy("batch_id").count().collect()]
        assert sorted(sizes) == [3] + [10] * 10
    hashed = V.assign_batches(df, 10, ["k"], "hashed")
    assert hashed.select("batch_id").distinct().count() <= 11


def test_ntxent_no_positive_pairs(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 2)], "batch_id long, embedding array<double>, label int")
    r = V.ntxent_loss(df, "batch_id", "embedding", "label").first()
    assert r.loss is None and r.pairs == 0


def test_gram_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [1.0, 1.0])], "batch_id long, vec_id long, embedding array<double>")
    got = {r.vec_id: (r.partners, r.sims) for r in V.gram_rows(df, "batch_id", "vec_id", "embedding").collect()}
    assert got == {1: ([1, 2], [1.0, 1.0]), 2: ([1, 2], [1.0, 2.0])}


def test_user_mask_equals_label_mask(spark):
    # a mask built from "same label" gives the label loss
    rng = np.random.default_rng(5)
    rows = [(0, i, int(rng.integers(0, 3)), rng.normal(size=6).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "batch_id long, vec_id long, label int, embedding array<double>")
    pairs = spark.createDataFrame([(0, a[1], b[1]) for a in rows for b in rows if a[2] == b[2]],
                                  "batch_id long, anchor long, positive long")
    masked = V.supcon_loss_masked(df, pairs, "batch_id", "vec_id", "embedding").first().loss
    labelled = V.supcon_loss(df, "batch_id", "embedding").first().loss
    assert masked == pytest.approx(labelled, abs=1e-12)
    with pytest.raises(ValueError):
        V.supcon_loss_masked(df, pairs.withColumn("label", pairs.anchor), "batch_id", "vec_id", "embedding")


def test_unbounded_batch_is_refused(spark):
    df = spark.createDataFrame([(0, i, 1, [1.0, float(i)]) for i in range(20)],
                               "batch_id long, vec_id long, label int, embedding array<double>")
    assert V.supcon_loss(df, "batch_id", "embedding").first().anchors == 20


def test_losses_of_a_batch_larger_than_a_block():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(10_000, 16))
    labels = rng.integers(0, 50, len(z))
    loss = V.supcon_batch(z, labels, None, 0.07, 0.07, np.ones(len(z), dtype=bool))
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    for a in (0, 511, 512, 9_999):  # brute force for some anchors
        s = u[a] @ u.T / 0.07
        others = np.arange(len(z)) != a
        pos = others & (labels == labels[a])
        want = -(s[pos].mean() - np.log(np.exp(s[others] - s.max()).sum()) - s.max())
        assert loss[a] == pytest.approx(want, rel=1e-9)
    n = 600  # two blocks; the feature matrix as the definition has it
    u, lab = u[:n], labels[:n]
    r = u @ u.T / 0.1
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    e = np.exp(r @ r.T / 0.07)
    same = lab[:, None] == lab[None, :]
    neg = (e * ~same).sum(axis=1)
    a, p = np.nonzero(same & ~np.eye(n, dtype=bool))
    assert V.ntxent_batch(z[:n], lab) == pytest.approx(-np.log(e[a, p] / (e[a, p] + neg[a])).mean(), rel=1e-9)


def test_masked_loss_over_blocks_equals_the_label_loss(spark):
    rng = np.random.default_rng(6)
    rows = [(0, i, int(rng.integers(0, 300)), [float(x) for x in rng.normal(size=4)]) for i in range(1300)]
    df = spark.createDataFrame(rows, "batch_id long, vec_id long, label int, embedding array<double>")
    a, b = df.select("batch_id", F.col("vec_id").alias("anchor"), "label"), df.select(F.col("vec_id").alias("positive"), "label")
    pairs = a.join(b, "label").drop("label")
    masked = V.supcon_loss_masked(df, pairs, "batch_id", "vec_id", "embedding").first()
    plain = V.supcon_loss(df, "batch_id", "embedding").first()
    assert masked.anchors == 1300 and masked.loss == pytest.approx(plain.loss, rel=1e-9)


def test_pooling_of_wide_vectors_is_one_aggregate(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(6, 768))
    rows = [(i // 3, i % 3, 0 if i < 3 else i % 2, [float(x) for x in v[i]]) for i in range(6)] + [(2, 0, 1, None)]
    df = spark.createDataFrame(rows, "seq long, pos int, mask int, vec array<double>")
    mean = V.mean_pool(df, "seq", "vec", 768)
    got = {r.seq: r.pooled for r in mean.collect()}
    assert got[0] == pytest.approx(v[:3].mean(axis=0).tolist()) and got[2] is None
    masked = {r.seq: r.pooled for r in V.masked_mean_pool(df, "seq", "vec", "mask", 768).collect()}
    assert masked[0] == [0.0] * 768  # all masked
    assert masked[1] == pytest.approx(v[[3, 5]].mean(axis=0).tolist())
    assert len(mean._jdf.queryExecution().executedPlan().toString()) < 20_000
