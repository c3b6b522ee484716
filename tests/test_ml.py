"""ML operators against brute force on small fixtures (no SQL oracle exists
for model fitting)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from labelforge.operators import ml as ML
from labelforge.operators import metrics as M
from labelforge.session import table


def test_pca_matches_numpy_svd(spark):
    e = table(spark, SMALL, "embeddings")
    got = {r.vec_id: np.array([r.x, r.y, r.z]) for r in ML.project_embeddings(e, "embedding", 3, ["vec_id"]).collect()}
    rows = sorted((r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in e.collect())
    X = np.vstack([v for _, v in rows])
    Xc = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    ref = X @ vt[:3].T  # Spark's PCA projects the uncentred vectors on the components
    mine = np.vstack([got[k] for k, _ in rows])
    for j in range(3):  # components are defined up to sign
        sign = np.sign(np.dot(mine[:, j], ref[:, j]))
        assert np.allclose(mine[:, j], sign * ref[:, j], atol=1e-6)


def test_linear_head_learns_separable_classes(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(3, 8)) * 5
    rows = [(i, int(i % 3), (centers[i % 3] + rng.normal(size=8) * 0.1).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, label int, v array<double>")
    model = ML.train_linear_head(df, "v", "label", max_iter=50)
    preds = ML.score_model(model, ML.with_features(df, "v"), ["k"], label="label")
    acc = preds.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc == 1.0
    # logits keep one score per class and the prediction is their argmax
    r = preds.select(M.argmax(F.col("logits")).alias("am"), "prediction").collect()
    assert all(x.am == x.prediction for x in r)


def test_text_classifier_metrics_are_consistent(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", F.col("text").alias("Context"))
    lab = table(spark, SMALL, "labels").select("doc_id", F.col("quality").alias("Result"))
    data = docs.join(lab, "doc_id")
    model = ML.train_text_classifier(data, "Context", "Result", num_features=1 << 12, max_iter=10)
    preds = ML.score_model(model, data, ["doc_id"], label="Result")
    m = M.binary_metrics(M.confusion(preds, "label", "prediction")).first()
    assert m.tn + m.fp + m.fn + m.tp == data.count()
    for v in (m.accuracy, m.precision, m.recall, m.f1):
        assert 0.0 <= v <= 1.0
    # the persisted-features fit gives the same model as a plain Pipeline.fit
    plain = ML.text_classifier("Context", "Result", num_features=1 << 12, max_iter=10).fit(
        data.withColumn("Result", F.col("Result").cast("double")))
    a = np.array(model.stages[-1].coefficients.toArray())
    b = np.array(plain.stages[-1].coefficients.toArray())
    assert np.allclose(a, b, atol=1e-8)


def test_token_budget(spark):
    df = spark.createDataFrame([("a  b\\nc",), ("",), (None,), (" ".join(["w"] * 130),)], "t string")
    out = df.select(ML.token_budget("t", 4).alias("b")).collect()
    assert out[0].b.tokens == ["a", "b\\nc", "[PAD]", "[PAD]"]
    assert [r.b.n_tokens for r in out] == [2, 0, 0, 130]
    assert [r.b.truncated for r in out] == [False, False, False, True]
    assert out[3].b.mask == [1, 1, 1, 1] and out[1].b.mask == [0, 0, 0, 0]


@pytest.mark.parametrize("k", [2, 3])
def test_pca_k(spark, k):
    e = table(spark, SMALL, "embeddings")
    assert len(ML.project_embeddings(e, "embedding", k).columns) == k
