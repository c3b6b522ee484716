"""Evaluation against the reference's golden numbers and edge cases."""

import pytest

from labelforge.operators import metrics as M


def counts(spark, rows):
    return spark.createDataFrame(rows, "split string, tn long, fp long, fn long, tp long")


def test_golden_radbert_run(spark):
    # published train/test counts of the one-epoch RadBERT run (all predicted positive)
    m = {r.split: r for r in M.binary_metrics(counts(spark, [("train", 0, 5641, 0, 13330),
                                                             ("test", 0, 1323, 0, 3149)])).collect()}
    assert round(m["train"].accuracy, 5) == 0.70265 and round(m["train"].f1, 5) == 0.82536
    assert round(m["test"].accuracy, 5) == 0.70416 and round(m["test"].f1, 5) == 0.82640
    assert m["test"].precision == m["test"].accuracy and m["test"].recall == 1.0
    assert m["train"].tn + m["train"].fp + m["train"].fn + m["train"].tp == 18971
    assert m["test"].tn + m["test"].fp + m["test"].fn + m["test"].tp == 4472


def test_zero_division(spark):
    r = M.specificity_sensitivity(M.binary_metrics(counts(spark, [("x", 0, 0, 0, 0)]))).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0, 0.0)
    assert r.specificity is None  # 0/0: NULL (the reference's pandas gives NaN)


def test_confusion_single_class_and_total(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "label int, prediction int")
    r = M.confusion(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 1, 0, 2)


def test_argmax_first_maximum(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 2.0],), ([3.0, 1.0, 3.0],)], "l array<double>")
    assert [r[0] for r in df.select(M.argmax(F.col("l"))).collect()] == [0, 1, 0]


def test_summary_and_delta_from_published(spark):
    # rebuild the published summary rows from metrics-shaped inputs, then the deltas
    pub = [("emilyalsentzer/Bio_ClinicalBERT", "Baseline", 0.9562, 0.8934, 0.9825, 0.9693),
           ("emilyalsentzer/Bio_ClinicalBERT", "Contrastive_Last_Layer", 0.9557, 0.9297, 0.9667, 0.9685),
           ("zzxslp/RadBERT-RoBERTa-4m", "Baseline", 0.9638, 0.9395, 0.9740, 0.9743),
           ("zzxslp/RadBERT-RoBERTa-4m", "Contrastive_Last_Layer", 0.9629, 0.9350, 0.9746, 0.9737)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pub, "model_name string, method string, accuracy double, spec double, recall double, "
                                    "f1 double")
    # express specificity through tn/fp so the summary recomputes it
    df = df.withColumn("tn", (F.col("spec") * 10000).cast("long")).withColumn("fp", 10000 - F.col("tn"))
    s = M.summary_table(df)
    rows = {(r.Model, r.Loss): r for r in s.collect()}
    assert rows[("Bio_ClinicalBERT-document", "baseline loss")].accuracy == pytest.approx(95.62)
    assert rows[("RadBERT-4m-document", "contrastive loss")].specificity == pytest.approx(93.50)
    d = {r.Model: r for r in M.method_delta(s).collect()}
    assert d["Bio_ClinicalBERT-document"].specificity_delta == pytest.approx(3.63)
    assert d["Bio_ClinicalBERT-document"].accuracy_best == "baseline"
    assert d["RadBERT-4m-document"].sensitivity_delta == pytest.approx(0.06)
    assert d["RadBERT-4m-document"].sensitivity_best == "contrastive"


def test_prediction_report_joins_by_key(spark):
    preds = spark.createDataFrame([(2, 1, 0), (1, 0, 0)], "k long, prediction int, label int")
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "k long, Context string")
    got = {r.k: (r.text, r.status) for r in M.prediction_report(preds, texts, ["k"]).collect()}
    assert got == {1: ("one", "TN"), 2: ("two", "FP")}


def test_pluggable_token_counter_matches_builtin(spark):
    from labelforge.operators import cost as K

    df = spark.createDataFrame([("a b  c",), ("",), (None,), ("one\\ntwo",)], "t string")
    count = K.batch_counter(lambda: (lambda s: len(s.split())))
    got = [tuple(r) for r in df.select(count("t"), K.word_tokens("t")).collect()]
    assert all(a == b for a, b in got)


def test_published_deltas_all_cells(spark):
    # fixed values: the published summary (percent) and its deltas, contrastive minus baseline
    published = [
        ("Bio_ClinicalBERT", "baseline loss", 95.62, 89.34, 98.25, 96.93),
        ("Bio_ClinicalBERT", "contrastive loss", 95.57, 92.97, 96.67, 96.85),
        ("DeBERTa-v3-base", "baseline loss", 96.15, 93.88, 97.11, 97.26),
        ("DeBERTa-v3-base", "contrastive loss", 96.11, 92.59, 97.59, 97.25),
        ("RadBERT-4m", "baseline loss", 96.38, 93.95, 97.40, 97.43),
        ("RadBERT-4m", "contrastive loss", 96.29, 93.50, 97.46, 97.37),
    ]
    deltas = {"Bio_ClinicalBERT": (-0.05, 3.63, -1.58, -0.08),
              "DeBERTa-v3-base": (-0.04, -1.29, 0.48, -0.01),
              "RadBERT-4m": (-0.09, -0.45, 0.06, -0.06)}
    df = spark.createDataFrame(published, "Model string, Loss string, accuracy double, specificity double, "
                                          "sensitivity double, f1 double")
    got = {r.Model: r for r in M.method_delta(df).collect()}
    for model, (da, ds, dn, df1) in deltas.items():
        r = got[model]
        assert (r.accuracy_delta, r.specificity_delta, r.sensitivity_delta, r.f1_delta) == \
            pytest.approx((da, ds, dn, df1), abs=1e-9)
        for metric, d in zip(("accuracy", "specificity", "sensitivity", "f1"), (da, ds, dn, df1)):
            assert r[f"{metric}_best"] == ("contrastive" if d > 0 else "baseline")
