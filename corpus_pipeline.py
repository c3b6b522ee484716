"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns rows of ``docs`` with all
their columns, whatever their names.  Every stage sees all that its predecessor
kept.  A stage's result is written and read again before the next stage is
called; the next stage then removes what the earlier ones left in the shared
folder, but for tables that its own input still reads.

Repeated rows are rows of their own, NULL texts count as empty, and an empty
table gives an empty result with the same columns.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelforge.llm import block_naming, decontaminate, mixing, pu_quality, simhash  # noqa: E402
from labelforge.llm.common import Numbered, column_or_null, free_name, keep_rows, numbered, remove, stored, written  # noqa: E402
from labelforge.session import table  # noqa: E402

#: No SQL: the quality model is trained and fingerprints are not SQL functions.
#: The pipeline is tested against brute force instead.
ORACLE_SQL = None

_LEFT: dict[str, list[str]] = {}


def _opened(spark: SparkSession, docs: DataFrame) -> None:
    """Removes what stages that are over have left behind."""
    app = spark.sparkContext.applicationId
    files = docs.inputFiles()
    spent = [folder for folder in _LEFT.get(app, []) if folder in written(spark) and not any(folder.rsplit("/", 1)[1] in f for f in files)]
    remove(spark, spent)


def _closed(spark: SparkSession, before: list[str], out: DataFrame) -> DataFrame:
    """Notes what the stage has stored since ``before``, for the next stage to remove."""
    _LEFT[spark.sparkContext.applicationId] = [folder for folder in written(spark) if folder not in before]
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more).

    A NULL or empty text has the score of an empty text.  Without any label the
    prior is at its least and no trusted document exists; all scores are then equal."""
    _opened(spark, docs)
    before = written(spark)
    known = F.col("doc_id").isNotNull() & ~pu_quality.fold(3, 1)
    model = pu_quality.train(spark, docs, table(spark, sf_dir, "labels"), known)
    score, name = pu_quality.score_column(spark, model, column_or_null(docs, "text", "string")), free_name(docs.columns, "quality_score")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return _closed(spark, before, docs.select(*names, score.alias(name)).where(F.col(name) >= 0.5).select(*names))


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[Numbered, list[str]]:
    _opened(spark, docs)
    before = written(spark)
    return numbered(spark, docs), before


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id (NULL is smaller than any); of
    rows that repeat it, one.  NULL and empty texts are equal."""
    rows, before = _numbered(spark, docs)
    return _closed(spark, before, keep_rows(rows, block_naming.exact_groups(spark, rows).where("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the row with the smallest doc_id (NULL is larger than
    any), one where that id repeats.  Texts without a word are one group."""
    rows, before = _numbered(spark, docs)
    groups = simhash.near_groups(spark, rows, simhash.SHINGLE_WORDS, simhash.MAX_BITS)
    return _closed(spark, before, keep_rows(rows, groups.where("row = first_row")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item; without items all stay."""
    rows, before = _numbered(spark, docs)
    found = stored(spark, decontaminate.find(spark, rows, table(spark, sf_dir, "benchmark")).select("row").distinct(), "contaminated")
    return _closed(spark, before, keep_rows(rows, found, "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to source, language and topic
    targets.  NULL source and language are values of their own; documents without
    a word have probability zero; rows with equal id and text share their fate."""
    rows, before = _numbered(spark, docs)
    return _closed(spark, before, keep_rows(rows, mixing.mix(spark, rows).where("kept")))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back.  A stage's input is
    removed when its output is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(spark, out, f"stage-{k}")
        if last:
            remove(spark, [last])
        last = written(spark)[-1]
    _opened(spark, docs)
    return docs
