"""Evaluation and reporting.

Metrics are aggregates: one pass of ``count_if``/``avg`` per group with
partial aggregation, so a billion predictions cost one narrow shuffle of a
handful of rows per group.  Ratios use ``try_divide`` (ANSI-safe) and the
reference's zero-division convention where it has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.encode import (classification_status, encode_label, method_label,
                                         short_model_name, utc_run_time)
from labelforge.functions.text import context_space

COUNTS = ["tn", "fp", "fn", "tp"]
METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1"]


def training_pairs(consensus: DataFrame, keys: list[str] = ["subject_id", "study_id"]) -> DataFrame:
    """P7 + P4 + P8: consensus rows → ``(keys, Context, Result)`` for training.

    Both sections NOT NULL and label Normal/Abnormal (pushed to the scan when
    the input is a table), then a non-empty Context."""
    f = consensus.where(F.col("findings").isNotNull() & F.col("impression").isNotNull()
                        & F.col("label").isin("Normal", "Abnormal"))
    out = f.select(*keys, context_space("findings", "impression").alias("Context"),
                   encode_label("label").alias("Result"))
    return out.where(F.length("Context") > 0)


def argmax(logits: Column) -> Column:
    """V8: 0-based index of the first maximum of an array of logits."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def label_distribution(df: DataFrame, *cols: str) -> DataFrame:
    """A3: value counts of one or more columns."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              group_by: list[str] | None = None) -> DataFrame:
    """A4: ``tn, fp, fn, tp`` (positive class 1), also when a class is absent."""
    t, p = F.col(label), F.col(pred)
    aggs = [F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp")]
    return df.groupBy(*(group_by or [])).agg(*aggs)


def _ratio0(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def binary_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from the counts; zero division → 0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return conf.select(
        "*",
        _ratio0(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio0(tp, tp + fp).alias("precision"),
        _ratio0(tp, tp + fn).alias("recall"),
        _ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def specificity_sensitivity(metrics: DataFrame) -> DataFrame:
    """specificity = TN/(TN+FP) (NULL on 0/0, the reference gives NaN),
    sensitivity = recall."""
    return metrics.withColumn("specificity", F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))) \
                  .withColumn("sensitivity", F.col("recall"))


def logit_stats(df: DataFrame, group_by: list[str], logit0: str = "logit0", logit1: str = "logit1",
                pred: str = "prediction") -> DataFrame:
    """Mean and population std of each class logit, mean margin, predicted counts."""
    l0, l1 = F.col(logit0), F.col(logit1)
    return df.groupBy(*group_by).agg(
        F.avg(l0).alias("logit_class0_mean"), F.stddev_pop(l0).alias("logit_class0_std"),
        F.avg(l1).alias("logit_class1_mean"), F.stddev_pop(l1).alias("logit_class1_std"),
        F.avg(l1 - l0).alias("logit_diff_mean"),
        F.count_if(F.col(pred) == 0).alias("pred_class0"), F.count_if(F.col(pred) == 1).alias("pred_class1"),
    )


def epoch_rollup(steps: DataFrame, group_by: list[str] = ["model_name", "epoch"]) -> DataFrame:
    """Mean batch loss and mean gradient norm per epoch."""
    aggs = [F.avg("loss").alias("train_loss"), F.count(F.lit(1)).alias("steps")]
    if "grad_norm" in steps.columns:
        aggs.append(F.avg("grad_norm").alias("grad_norm_mean"))
    return steps.groupBy(*group_by).agg(*aggs)


def prediction_report(preds: DataFrame, texts: DataFrame, key: list[str], text: str = "Context",
                      label: str = "label", pred: str = "prediction", keep: tuple[str, ...] = ()) -> DataFrame:
    """E4 + J7: predictions joined to their texts by key (never by position),
    with the TP/FP/FN/TN status; ``keep`` columns of the predictions (the method
    of several) come along."""
    j = texts.select(*key, text).join(preds, key, "inner")
    return j.select(*key, *keep, F.col(text).alias("text"), F.col(pred).alias("prediction"),
                    F.col(label).alias("true_label"), classification_status(label, pred).alias("status"))


def split_metrics(preds: DataFrame, group_by: list[str], label: str = "label",
                  pred: str = "prediction") -> DataFrame:
    """E5: the same metrics for every (model, method, split[, epoch]) group."""
    return binary_metrics(confusion(preds, label, pred, group_by))


def skip_missing_models(expected: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected (model, method) with its metrics, or ``missing``."""
    j = expected.join(available, keys, "left")
    return j.withColumn("status", F.when(F.col("tp").isNull(), "missing").otherwise("evaluated"))


def run_metadata(metrics: DataFrame, model_name: str, num_epochs: int, learning_rate: float) -> DataFrame:
    """Tag a metrics table with the UTC run time and the run settings."""
    return metrics.select(utc_run_time().alias("run_timestamp_utc"), F.lit(model_name).alias("model_name"),
                          "*", F.lit(num_epochs).alias("num_epochs"),
                          F.lit(learning_rate).alias("learning_rate"))


def summary_table(metrics: DataFrame) -> DataFrame:
    """Model, Loss and four metrics in percent, half-even to 2 decimals."""
    m = specificity_sensitivity(metrics)
    pct = lambda c: F.bround(F.col(c) * 100, 2).alias(c)
    return m.select(short_model_name("model_name").alias("Model"), method_label("method").alias("Loss"),
                    pct("accuracy"), pct("specificity"), pct("sensitivity"), pct("f1"))


def method_delta(summary: DataFrame, metrics: list[str] = ["accuracy", "specificity", "sensitivity", "f1"],
                 base: str = "baseline loss", other: str = "contrastive loss") -> DataFrame:
    """R2: contrastive minus baseline per model, and which method is best per metric."""
    aggs = []
    for m in metrics:
        aggs += [F.max(F.when(F.col("Loss") == base, F.col(m))).alias(f"{m}_base"),
                 F.max(F.when(F.col("Loss") == other, F.col(m))).alias(f"{m}_other")]
    g = summary.groupBy("Model").agg(*aggs)
    out = [F.col("Model")]
    for m in metrics:
        b, o = F.col(f"{m}_base"), F.col(f"{m}_other")
        out += [F.bround(o - b, 2).alias(f"{m}_delta"),
                F.when(o > b, "contrastive").when(o < b, "baseline").when(o == b, "tie").alias(f"{m}_best")]
    return g.select(*out)


def results_table(*runs: DataFrame) -> DataFrame:
    """Metrics rows of several runs, stacked by name."""
    from functools import reduce

    cols = ["model_name", "method", "accuracy", "precision", "recall", "f1", *COUNTS]
    return reduce(lambda a, b: a.unionByName(b), [r.select(*cols) for r in runs])
