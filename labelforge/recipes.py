"""End-to-end flows of the reference's scripts, composed from the operators.

Each function is a few DataFrame operator calls; nothing here adds logic of
its own.  Steps whose output is reused or comes from a non-deterministic
teacher are written once (``materialize``) before the next step reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions.encode import parse_json_strict
from labelforge.functions.text import context_period, sentence_prompt
from labelforge.operators import calls as CA
from labelforge.operators import consensus as C
from labelforge.operators import cost as K
from labelforge.operators import metrics as M
from labelforge.operators import ml as ML
from labelforge.operators import sentences as S
from labelforge.operators import teacher as TE
from labelforge.sources import files

KEYS = ["subject_id", "study_id"]
#: Fixed value: the column order of a metrics file.
METRICS_COLUMNS = ["run_timestamp_utc", "model_name", "method", "num_epochs", "learning_rate",
                   "accuracy", "precision", "recall", "f1", "tn", "fp", "fn", "tp"]


def reports_from_files(spark: SparkSession, root: str, partition: str | None = None,
                       first_n: int | None = None) -> DataFrame:
    """Report files → ``reports`` (S4, S3 as a path glob, P1, P2, O1, O2).

    ``partition`` (e.g. ``"p10"``) lists only that folder; ``first_n`` keeps
    the first rows in (subject, study) order, as the test split does."""
    path = f"{root.rstrip('/')}/files/{partition}/" if partition else root
    reports = files.parse_reports(files.read_report_files(spark, path))
    return S.first_rows(reports, KEYS, first_n) if first_n else S.order_reports(reports, KEYS)


def label_reports(reports: DataFrame, teachers: dict[str, TE.TeacherFactory], name: str = "extract",
                  partitions: int | None = None) -> DataFrame:
    """Every teacher labels every report (T1, one pass), then explanation
    confidence (T5); written once and read back (the scored vote table)."""
    extract = TE.label_documents_all(reports, teachers, KEYS, partitions=partitions)
    return TE.materialize(TE.explanation_confidence(extract), name)


def sentence_consensus(reports: DataFrame, teacher: TE.TeacherFactory, keys: list[str] = KEYS, passes: int = 3,
                       call_budget: int | None = None, encoder=None, **retry) -> tuple[DataFrame, DataFrame]:
    """The sentence labelling flow: sentences (P10) → passes with retries, in
    report order and within a call budget (T2, T3, T4) → embeddings and
    confidence (T7, T6) → consensus (C2) with provenance (C4).  Returns the
    consensus and the failed reports.

    A reply that is not one JSON object is a failed call.  ``retry`` goes to
    ``ordered_calls`` (tries, waits, timeout, request size).  The replies are
    written once, so every prompt is sent once per try; a report's calls stop at
    its first dead sentence.  With a budget the running tasks share it, and a
    sentence without all its passes has no consensus."""
    sentence_keys = [*keys, "sentence_index"]
    text = reports.select(*keys, context_period("findings", "impression").alias("text"))
    plan = TE.with_passes(S.split_sentences(text, "text", "period"), passes)
    asked = plan.select(*sentence_keys, "pass", F.col("sentence").alias("Context"), sentence_prompt("sentence").alias("prompt"))
    replies = CA.ordered_calls(asked, "prompt", teacher, [*sentence_keys, "pass", "Context"], keys, validate=TE.strict_json_object,
                               budget=call_budget, **retry)
    if call_budget is None:
        replies = TE.materialize(replies, "sentence_replies")
    fields = parse_json_strict("raw_ai_output", ("Result", "Explanation"))
    votes = TE.skip_after_failure(replies, keys).withColumn("_p", fields).select(
        *sentence_keys, "pass", "Context", F.col("_p.value.Result").alias("Result"), F.col("_p.value.Explanation").alias("Explanation"))
    both = TE.embed_text(TE.embed_text(votes, "Context", encoder, "ctx_emb"), "Explanation", encoder, "exp_emb")
    scored = TE.materialize(both.select(*sentence_keys, "pass", "Result", TE.embedding_confidence("ctx_emb", "exp_emb").alias("confidence")),
                            "sentence_votes_scored")
    return C.with_provenance(C.sentence_consensus(scored, sentence_keys, n_passes=passes)), TE.dead_letter(replies, keys)


def consensus_training_set(votes: DataFrame) -> DataFrame:
    """Votes → consensus (C1) → training pairs ``(keys, Context, Result)``."""
    return M.training_pairs(C.consensus(votes))


def train_and_evaluate(train: DataFrame, test: DataFrame, model_name: str, method: str = "Baseline",
                       num_epochs: int = 20, learning_rate: float = 4e-5, **fit) -> tuple[DataFrame, DataFrame]:
    """V6 + V12 + E2: fit the text classifier on ``train``, score ``test``
    keeping keys, and return ``(predictions report, metrics row)``."""
    model = ML.train_text_classifier(train, "Context", "Result", **fit)
    preds = ML.score_model(model, test, KEYS, label="Result")
    report = M.prediction_report(preds, test, KEYS)
    metrics = M.binary_metrics(M.confusion(preds, "label", "prediction"))
    row = M.run_metadata(metrics, model_name, num_epochs, learning_rate).withColumn("method", F.lit(method))
    return report, row.select(*METRICS_COLUMNS)


def summary(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R1 + R2: the published-style summary table and the method deltas."""
    table = M.summary_table(metrics).orderBy("Model", "Loss")
    return table, M.method_delta(M.summary_table(metrics))


def cost_plan(reports: DataFrame) -> DataFrame:
    """K1–K5 over all sentences of the reports (period split of the ". "-joined
    sections, as the labeller splits them)."""
    text = reports.select(*KEYS, context_period("findings", "impression").alias("text"))
    return K.cost_report(K.token_plan(S.split_sentences(text, "text", "period")))
