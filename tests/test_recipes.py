"""End to end at sf0.001: report files → teachers → consensus → classifier →
metrics → summary, and the cost plan."""

import tempfile

import pandas as pd
from pyspark.sql import functions as F

from conftest import SMALL
from labelforge import recipes as R
from labelforge.operators import teacher as TE
from labelforge.sources import sinks
from labelforge.sources.fixtures import view


def test_sentence_flow(spark, tmp_path):
    """Every prompt is sent once per try; a report whose sentence fails ends there."""
    log = str(tmp_path / "calls")
    base = TE.rule_teacher(0, TE.SENTENCE_LABELS, "Result", "Explanation", fence_every=0)

    def teacher():
        inner = base()
        tries = {}

        def call(prompts):
            out = []
            with open(log, "a") as f:
                for p, r in zip(prompts, inner(prompts)):
                    tries[p] = tries.get(p, 0) + 1
                    f.write("x\n")
                    out.append("not json" if "broken" in p or "shaky" in p and tries[p] == 1 else r)
            return pd.Series(out, index=prompts.index, dtype=object)

        return call

    reports = spark.createDataFrame(
        [("p1", "s1", "One clear lung. A shaky line.", "Nothing else."), ("p2", "s2", "All fine. A broken part. Never seen.", "End.")],
        "subject_id string, study_id string, findings string, impression string")
    out, failed = R.sentence_consensus(reports, teacher, max_errors=2)
    got = sorted((r.subject_id, r.sentence_index) for r in out.collect())
    assert got == [("p1", 0), ("p1", 1), ("p1", 2), ("p2", 0)]
    assert {"text_file", "parquet_file", "row_index", "source", "confidence"} <= set(out.columns)
    assert [(r.subject_id, r.first_failed_sentence) for r in failed.collect()] == [("p2", 1)]
    # 3 and 1 good sentences in 3 passes, one re-sent; the broken one is given up at its
    # third failure, and what follows it is never asked
    assert len(open(log).readlines()) == 3 * 3 + 1 + 3 + 3

    out, failed = R.sentence_consensus(reports.where("subject_id = 'p1'"), base, call_budget=3 * 3 * 2)
    assert sorted(r.sentence_index for r in out.collect()) == [0, 1] and failed.count() == 0


def test_end_to_end(spark):
    root = tempfile.mkdtemp(prefix="lf-e2e-")
    sinks.write_report_files(view(spark, SMALL, "reports_raw"), root)
    train_reports = R.reports_from_files(spark, root, partition="p10")
    test_reports = R.reports_from_files(spark, root, partition="p11", first_n=60)
    assert train_reports.count() == 100 and test_reports.count() == 60

    teachers = {"teacher_a": TE.rule_teacher(0, gate=1), "teacher_b": TE.rule_teacher(1, gate=3),
                "teacher_c": TE.rule_teacher(2, gate=2)}
    train_votes = R.label_reports(train_reports, teachers, "train_votes")
    test_votes = R.label_reports(test_reports, teachers, "test_votes")
    assert train_votes.count() == 300
    train = R.consensus_training_set(train_votes)
    test = R.consensus_training_set(test_votes)
    assert train.count() > 0 and test.count() > 0
    assert set(r.Result for r in train.collect()) <= {0, 1}

    report, metrics = R.train_and_evaluate(train, test, "zzxslp/RadBERT-RoBERTa-4m", max_iter=5,
                                           num_features=1 << 12)
    m = metrics.first()
    assert metrics.columns == R.METRICS_COLUMNS
    assert m.tn + m.fp + m.fn + m.tp == test.count() == report.count()
    table, delta = R.summary(metrics.unionByName(metrics.withColumn("method", F.lit("Contrastive_Last_Layer"))))
    assert [r.Loss for r in table.collect()] == ["baseline loss", "contrastive loss"]
    assert delta.first().accuracy_best == "tie"

    plan = R.cost_plan(train_reports).first()
    assert plan.chat_calls == 3 * plan.total_sentences and plan.embedding_calls == 6 * plan.total_sentences
    assert plan.total_cost > 0
