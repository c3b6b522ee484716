"""Evaluation family: A3, A4, A6, A7, E1–E6, R1–R3, V8, J7."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions.encode import classification_status
from labelforge.operators import metrics as M
from labelforge.plans.q_text import _MODEL_NAMES_SQL, model_name_col
from labelforge.plans.registry import register
from labelforge.plans.sqltext import oracle
from labelforge.sources.fixtures import view
from labelforge.session import table


def scored(spark, sf_dir):
    """predictions view + V8 argmax (first maximum wins) + a model name per row."""
    p = view(spark, sf_dir, "predictions")
    return p.select("*", M.argmax(F.array("logit0", "logit1")).alias("prediction"),
                    model_name_col().alias("model_name"))


# DuckDB side of the same scoring
_SCORED = f"""
sc AS (SELECT *, CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS prediction, {_MODEL_NAMES_SQL} AS model_name
       FROM predictions)"""

_CONF = _SCORED + """,
cf AS (SELECT model_name, method, split,
              count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
       FROM sc GROUP BY model_name, method, split),
mt AS (SELECT *, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy,
              coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
              coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
              coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
       FROM cf)"""

_SUMMARY = _CONF + """,
sm AS (SELECT CASE WHEN contains(model_name, 'Bio_ClinicalBERT') THEN 'Bio_ClinicalBERT-document'
                   WHEN contains(model_name, 'deberta-v3-base') THEN 'DeBERTa-v3-base-document'
                   WHEN contains(model_name, 'RadBERT-RoBERTa-4m') THEN 'RadBERT-4m-document'
                   ELSE model_name END AS Model,
              CASE method WHEN 'Baseline' THEN 'baseline loss' WHEN 'Contrastive_Last_Layer' THEN 'contrastive loss' END AS Loss,
              round_even(accuracy * 100, 2) AS accuracy,
              round_even(tn / nullif(tn + fp, 0) * 100, 2) AS specificity,
              round_even(recall * 100, 2) AS sensitivity, round_even(f1 * 100, 2) AS f1
       FROM mt WHERE split = 'test')"""


def held_out_metrics(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("split") == "test")
    return M.split_metrics(s, ["model_name", "method"])


@register("v8_argmax_predict", oracle(["predictions"], _SCORED + """
SELECT doc_id, method, prediction FROM sc
"""))
def v8_argmax_predict(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "method", "prediction")


@register("a3_label_distribution", oracle(["predictions"], _SCORED + """
SELECT method, split, prediction, count(*) AS count FROM sc GROUP BY method, split, prediction
"""))
def a3_label_distribution(spark, sf_dir):
    return M.label_distribution(scored(spark, sf_dir), "method", "split", "prediction")


@register("a4_confusion", oracle(["predictions"], _CONF + """
SELECT model_name, method, split, tn, fp, fn, tp FROM cf
"""))
def a4_confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), "label", "prediction", ["model_name", "method", "split"])


@register("a4_confusion_single_class", oracle(["predictions"], _SCORED + """
SELECT method,
       count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
FROM (SELECT method, label, 1 AS prediction FROM sc) t GROUP BY method
"""))
def a4_confusion_single_class(spark, sf_dir):
    # every row predicted positive (the published radbert run): tn = fn = 0
    s = scored(spark, sf_dir).withColumn("prediction", F.lit(1))
    return M.confusion(s, "label", "prediction", ["method"])


@register("a6_logit_stats", oracle(["predictions"], _SCORED + """
SELECT method, split, round(avg(logit0), 9) AS logit_class0_mean, round(stddev_pop(logit0), 9) AS logit_class0_std,
       round(avg(logit1), 9) AS logit_class1_mean, round(stddev_pop(logit1), 9) AS logit_class1_std,
       round(avg(logit1 - logit0), 9) AS logit_diff_mean,
       count(*) FILTER (WHERE prediction = 0) AS pred_class0, count(*) FILTER (WHERE prediction = 1) AS pred_class1
FROM sc GROUP BY method, split
"""))
def a6_logit_stats(spark, sf_dir):
    out = M.logit_stats(scored(spark, sf_dir), ["method", "split"])
    # population std is summed in a different order by each engine: compare at 9 decimals
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("logit_") else c for c in out.columns])


@register("a7_epoch_rollup", oracle(["step_log"], """
SELECT model_name, epoch, avg(loss) AS train_loss, count(*) AS steps, avg(grad_norm) AS grad_norm_mean
FROM step_log GROUP BY model_name, epoch
"""))
def a7_epoch_rollup(spark, sf_dir):
    return M.epoch_rollup(view(spark, sf_dir, "step_log"))


@register("e1_classification_status", oracle(["predictions"], _SCORED + """
SELECT doc_id, method, CASE WHEN label = 1 AND prediction = 1 THEN 'TP' WHEN label = 0 AND prediction = 1 THEN 'FP'
                            WHEN label = 1 AND prediction = 0 THEN 'FN' WHEN label = 0 AND prediction = 0 THEN 'TN'
                            ELSE 'Unknown' END AS status
FROM sc
"""))
def e1_classification_status(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("doc_id", "method", classification_status("label", "prediction").alias("status"))


@register("e2_binary_metrics", oracle(["predictions"], _CONF + """
SELECT model_name, method, split, tn, fp, fn, tp, accuracy, precision, recall, f1 FROM mt
"""))
def e2_binary_metrics(spark, sf_dir):
    return M.split_metrics(scored(spark, sf_dir), ["model_name", "method", "split"])


@register("e3_specificity_sensitivity", oracle(["predictions"], _CONF + """
SELECT model_name, method, split, tn / nullif(tn + fp, 0) AS specificity, recall AS sensitivity FROM mt
"""))
def e3_specificity_sensitivity(spark, sf_dir):
    m = M.specificity_sensitivity(M.split_metrics(scored(spark, sf_dir), ["model_name", "method", "split"]))
    return m.select("model_name", "method", "split", "specificity", "sensitivity")


@register("e4_prediction_report", oracle(["predictions"], _SCORED + """
SELECT sc.doc_id, sc.method, d.text, sc.prediction, sc.label AS true_label,
       CASE WHEN label = 1 AND prediction = 1 THEN 'TP' WHEN label = 0 AND prediction = 1 THEN 'FP'
            WHEN label = 1 AND prediction = 0 THEN 'FN' WHEN label = 0 AND prediction = 0 THEN 'TN'
            ELSE 'Unknown' END AS status
FROM sc JOIN documents d ON d.doc_id = sc.doc_id
"""))
def e4_prediction_report(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("Context"))
    return M.prediction_report(scored(spark, sf_dir), texts, ["doc_id"], keep=("method",))


@register("j7_predictions_by_key", oracle(["predictions"], _SCORED + """
SELECT sc.doc_id, sc.method, d.lang, sc.prediction FROM sc JOIN documents d ON d.doc_id = sc.doc_id
"""))
def j7_predictions_by_key(spark, sf_dir):
    preds = scored(spark, sf_dir).select("doc_id", "method", "prediction")
    return preds.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "inner") \
                .select("doc_id", "method", "lang", "prediction")


@register("e5_split_metrics", oracle(["predictions"], _CONF + """
SELECT method, split, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp,
       coalesce(sum(tp + tn) / nullif(sum(tp + tn + fp + fn), 0), 0) AS accuracy,
       coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0) AS precision,
       coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0) AS recall,
       coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS f1
FROM cf GROUP BY method, split
"""))
def e5_split_metrics(spark, sf_dir):
    return M.split_metrics(scored(spark, sf_dir), ["method", "split"])


@register("e6_skip_missing_models", oracle(["predictions"], _CONF + """,
ex AS (SELECT DISTINCT model_name FROM sc),
me AS (SELECT 'Baseline' AS method UNION ALL SELECT 'Contrastive_Last_Layer' UNION ALL SELECT 'Contrastive_Encoder'),
av AS (SELECT * FROM mt WHERE split = 'test')
SELECT ex.model_name, me.method, av.tp, av.f1, CASE WHEN av.tp IS NULL THEN 'missing' ELSE 'evaluated' END AS status
FROM ex CROSS JOIN me LEFT JOIN av ON av.model_name = ex.model_name AND av.method = me.method
"""))
def e6_skip_missing_models(spark, sf_dir):
    s = scored(spark, sf_dir)
    # expected runs: every model seen × the three methods (a narrow explode, no join)
    methods = F.array(*[F.lit(m) for m in ("Baseline", "Contrastive_Last_Layer", "Contrastive_Encoder")])
    expected = s.select("model_name").distinct().select("model_name", F.explode(methods).alias("method"))
    available = held_out_metrics(spark, sf_dir)
    return M.skip_missing_models(expected, available, ["model_name", "method"]).select(
        "model_name", "method", "tp", "f1", "status")


@register("r1_summary_table", oracle(["predictions"], _SUMMARY + """
SELECT * FROM sm
"""))
def r1_summary_table(spark, sf_dir):
    return M.summary_table(held_out_metrics(spark, sf_dir))


@register("r2_method_delta", oracle(["predictions"], _SUMMARY + """
SELECT Model,
       round_even(max(accuracy) FILTER (WHERE Loss = 'contrastive loss') - max(accuracy) FILTER (WHERE Loss = 'baseline loss'), 2) AS accuracy_delta,
       CASE WHEN max(accuracy) FILTER (WHERE Loss = 'contrastive loss') > max(accuracy) FILTER (WHERE Loss = 'baseline loss') THEN 'contrastive'
            WHEN max(accuracy) FILTER (WHERE Loss = 'contrastive loss') < max(accuracy) FILTER (WHERE Loss = 'baseline loss') THEN 'baseline'
            WHEN max(accuracy) FILTER (WHERE Loss = 'contrastive loss') = max(accuracy) FILTER (WHERE Loss = 'baseline loss') THEN 'tie' END AS accuracy_best,
       round_even(max(f1) FILTER (WHERE Loss = 'contrastive loss') - max(f1) FILTER (WHERE Loss = 'baseline loss'), 2) AS f1_delta,
       CASE WHEN max(f1) FILTER (WHERE Loss = 'contrastive loss') > max(f1) FILTER (WHERE Loss = 'baseline loss') THEN 'contrastive'
            WHEN max(f1) FILTER (WHERE Loss = 'contrastive loss') < max(f1) FILTER (WHERE Loss = 'baseline loss') THEN 'baseline'
            WHEN max(f1) FILTER (WHERE Loss = 'contrastive loss') = max(f1) FILTER (WHERE Loss = 'baseline loss') THEN 'tie' END AS f1_best
FROM sm GROUP BY Model
"""))
def r2_method_delta(spark, sf_dir):
    return M.method_delta(M.summary_table(held_out_metrics(spark, sf_dir)), ["accuracy", "f1"])


@register("r3_results_table", oracle(["predictions"], _CONF + """
SELECT model_name, method, accuracy, precision, recall, f1, tn, fp, fn, tp FROM mt WHERE split = 'test'
UNION ALL
SELECT model_name, method, accuracy, precision, recall, f1, tn, fp, fn, tp FROM mt WHERE split = 'train'
"""))
def r3_results_table(spark, sf_dir):
    s = scored(spark, sf_dir)
    runs = [M.split_metrics(s.where(F.col("split") == sp), ["model_name", "method"]) for sp in ("test", "train")]
    return M.results_table(*runs)


@register("o7_summary_order", oracle(["predictions"], _SUMMARY + """
SELECT * FROM sm ORDER BY Model, Loss
"""))
def o7_summary_order(spark, sf_dir):
    return M.summary_table(held_out_metrics(spark, sf_dir)).orderBy("Model", "Loss")
