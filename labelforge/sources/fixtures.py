"""Derived report-shaped views over the driver tables.

The driver tables carry no radiology sections, votes or logits, so these
views derive them deterministically from ``documents``, ``labels`` and
``embeddings``.  One SQL text serves both engines: Spark runs it through
``spark.sql(text, **dataframes)`` and the DuckDB oracle inlines it as a CTE
(``{name}`` placeholders become the registered view names; ``{{``/``}}`` are
literal braces).  Every view grows with its base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.operators.sentences import split_sentences
from labelforge.session import table

# name -> (sql text, base tables / views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}

VIEWS["reports_raw"] = (
    """
SELECT 'files/p1' || cast(doc_id % 2 AS string) || '/p' || lpad(cast(doc_id % 97 AS string), 8, '0')
       || '/s' || lpad(cast(doc_id AS string), 8, '0') || '.txt' AS path,
       CASE doc_id % 10
         WHEN 0 THEN text
         WHEN 1 THEN 'FINDINGS: ' || text
         WHEN 2 THEN 'IMPRESSION: ' || text
         WHEN 3 THEN 'FINDINGS:' || chr(10) || chr(10) || 'IMPRESSION: ' || text || chr(10)
         WHEN 4 THEN 'findings: ' || substr(text, 1, k) || chr(10) || ' impression: ' || substr(text, k + 1)
         WHEN 5 THEN 'FINDINGS: ' || substr(text, 1, k) || ' IMPRESSION: ' || substr(text, k + 1)
         ELSE 'EXAM: x' || chr(10) || 'FINDINGS: ' || substr(text, 1, k) || chr(10) || chr(10)
              || 'IMPRESSION: ' || substr(text, k + 1) || chr(10)
       END AS text
FROM (SELECT doc_id, text, cast(floor(length(text) * 2 / 3e0) AS int) AS k FROM {documents}) d
""",
    ("documents",),
)

# The two sections hold the whole text between them (two thirds and the rest);
# rows with empty, blank and missing sections are added under ids of their own.
VIEWS["reports"] = (
    """
SELECT 'p' || lpad(cast(doc_id % 97 AS string), 8, '0') AS subject_id,
       's' || lpad(cast(doc_id AS string), 8, '0') AS study_id, findings, impression, doc_id
FROM (
  SELECT doc_id, substr(text, 1, k) AS findings, substr(text, k + 1) AS impression
  FROM (SELECT doc_id, text, cast(floor(length(text) * 2 / 3e0) AS int) AS k FROM {documents}) d
  UNION ALL
  SELECT doc_id + 50000000 AS doc_id,
         CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS findings,
         CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE text END AS impression
  FROM {documents} WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0
) r
""",
    ("documents",),
)

VIEWS["votes"] = (
    """
SELECT r.subject_id, r.study_id, r.findings, r.impression, v.label,
       CASE WHEN v.label IS NULL THEN NULL WHEN (r.doc_id + t.k) % 31 = 0 THEN '  ' ELSE v.label || ' because ' || t.model END AS explanation,
       CASE WHEN v.label IS NULL OR (r.doc_id + t.k) % 31 = 0 THEN NULL ELSE ((r.doc_id * (37 + t.k)) % 1024) / 1024e0 END AS confidence,
       t.model
FROM {reports} r
CROSS JOIN (SELECT 0 AS k, 'teacher_a' AS model UNION ALL SELECT 1, 'teacher_b' UNION ALL SELECT 2, 'teacher_c') t
JOIN (SELECT doc_id, kk,
             CASE WHEN doc_id % 29 = 0 OR (doc_id + kk) % 17 = 0 THEN NULL
                  WHEN (doc_id * (kk + 3)) % 7 < 3 THEN 'Normal'
                  WHEN (doc_id * (kk + 2)) % 11 < 9 THEN 'Abnormal'
                  ELSE 'Uncertain' END AS label
      FROM {reports} CROSS JOIN (SELECT 0 AS kk UNION ALL SELECT 1 UNION ALL SELECT 2) q) v
  ON v.doc_id = r.doc_id AND v.kk = t.k
WHERE r.doc_id % 23 <> t.k
""",
    ("reports",),
)

# Every sentence of every document (P10).  Spark builds this view with the
# operator itself (``BUILT`` below); the SQL is for DuckDB alone.
VIEWS["document_sentences"] = (
    r"""
SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS i, unnest(s) AS sentence
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '.'),
             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM {documents})
""",
    ("documents",),
)

# Three teacher passes over those sentences; the votes depend on the sentence's length.
VIEWS["sentence_votes"] = (
    """
SELECT 'shard-' || cast(doc_id % 3 AS string) || '.parquet' AS parquet_file, doc_id AS row_index, s.i AS sentence_index, p.pass,
       CASE WHEN (length(sentence) * (p.pass + 2) + s.i) % 5 < 2 THEN 'Yes'
            WHEN (doc_id + length(sentence) + p.pass * s.i) % 7 < 5 THEN 'No' ELSE 'Uncertain' END AS Result,
       ((doc_id * 13 + length(sentence) * 7 + p.pass * 29) % 64) / 64e0 AS confidence
FROM {document_sentences} s
CROSS JOIN (SELECT 1 AS pass UNION ALL SELECT 2 UNION ALL SELECT 3) p
WHERE (doc_id + s.i) % 41 <> p.pass
""",
    ("document_sentences",),
)

VIEWS["raw_outputs"] = (
    """
SELECT doc_id,
       CASE doc_id % 8
         WHEN 0 THEN '{{"label":"Normal","explanation":"clear"}}'
         WHEN 1 THEN '{{"label":"Abnormal","explanation":"opacity"}}'
         WHEN 2 THEN '```json' || chr(10) || '{{"label":"Normal"}}' || chr(10) || '```'
         WHEN 3 THEN 'Sure: {{"label":"Normal"}}'
         WHEN 4 THEN '{{"label":"Normal"'
         WHEN 5 THEN '{{"label":null,"explanation":"x"}}'
         WHEN 6 THEN NULL
         ELSE '{{"label":"Uncertain","explanation":""}}' END AS raw_ai_output
FROM {documents}
""",
    ("documents",),
)

VIEWS["predictions"] = (
    """
SELECT l.doc_id, m.method, CASE WHEN l.doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, l.quality AS label,
       ((l.doc_id * (17 + m.s)) % 64) / 16e0 AS logit0,
       (((l.doc_id * (31 + m.s)) % 64) + 24 * l.quality) / 16e0 AS logit1
FROM {labels} l CROSS JOIN (SELECT 'Baseline' AS method, 0 AS s UNION ALL SELECT 'Contrastive_Last_Layer', 2) m
""",
    ("labels",),
)

VIEWS["tokens"] = (
    """
SELECT cast(floor(vec_id / 8e0) AS bigint) AS seq_id, vec_id % 8 AS pos,
       CASE WHEN vec_id < 8 THEN 0 WHEN vec_id % 8 < 3 + floor(vec_id / 8e0) % 6 THEN 1 ELSE 0 END AS mask,
       embedding AS vec, label
FROM {embeddings}
""",
    ("embeddings",),
)

VIEWS["batches"] = (
    """
SELECT cast(floor(vec_id / 32e0) AS bigint) AS batch_id, vec_id, label, embedding FROM {embeddings}
""",
    ("embeddings",),
)

VIEWS["step_log"] = (
    """
SELECT 'm' || cast(doc_id % 2 AS string) AS model_name, doc_id % 20 + 1 AS epoch, doc_id AS step,
       ((doc_id * 53) % 1024) / 1024e0 AS loss, ((doc_id * 19) % 64) / 64e0 AS grad_norm
FROM {documents}
""",
    ("documents",),
)


def _document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return split_sentences(docs, "text", "period", index="i")


#: Views that Spark builds with an operator instead of the SQL text.
BUILT = {"document_sentences": _document_sentences}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived view (or load a driver table) as a lazy DataFrame."""
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text, deps = VIEWS[name]
    return spark.sql(text, **{d: view(spark, sf_dir, d) for d in deps})


def stored_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view written once to the shared checkpoint folder and read
    back: the realistic input for operators that scan their input more than
    once (the votes are a stored table in a real pipeline)."""
    from labelforge.session import scratch_path

    path = scratch_path(spark, f"view-{name}")
    view(spark, sf_dir, name).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in VIEWS or n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named views (and their dependencies) for DuckDB."""
    order = _closure(names)
    if not order:
        return ""
    parts = []
    for n in order:
        text, deps = VIEWS[n]
        parts.append(f"{n} AS ({text.format(**{d: d for d in deps}).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
