"""Text family: P1–P24 and the sentence splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import encode as E
from labelforge.functions import text as T
from labelforge.operators import consensus as C
from labelforge.operators import sentences as S
from labelforge.plans.q_consensus import _CONSENSUS_CTES
from labelforge.plans import settings as ST
from labelforge.plans.registry import register
from labelforge.plans.sqltext import oracle
from labelforge.sources import files
from labelforge.sources.fixtures import view
from labelforge.session import table


def lit(s: str) -> str:
    """SQL string literal (quotes doubled; DuckDB keeps backslashes as is)."""
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


FIND_SQL = r"(?is)FINDINGS:\s*(.*?)\n\s*(IMPRESSION:|$)"
IMPR_SQL = r"(?is)IMPRESSION:\s*(.*)"
PATH_SQL = r"([^/]+)/([^/]+)\.txt$"

# ------------------------------------------------------------------ parsing


@register("p1_parse_sections", oracle(["reports_raw"], f"""
SELECT path, {strip_sql(f"regexp_extract(text, '{FIND_SQL}', 1)")} AS findings,
             {strip_sql(f"regexp_extract(text, '{IMPR_SQL}', 1)")} AS impression
FROM reports_raw
"""))
def p1_parse_sections(spark, sf_dir):
    raw = view(spark, sf_dir, "reports_raw")
    return raw.select("path", T.findings("text").alias("findings"), T.impression("text").alias("impression"))


@register("p2_ids_from_path", oracle(["reports_raw"], f"""
SELECT regexp_extract(path, '{PATH_SQL}', 1) AS subject_id, regexp_extract(path, '{PATH_SQL}', 2) AS study_id,
       {strip_sql(f"regexp_extract(text, '{FIND_SQL}', 1)")} AS findings,
       {strip_sql(f"regexp_extract(text, '{IMPR_SQL}', 1)")} AS impression
FROM reports_raw
"""))
def p2_ids_from_path(spark, sf_dir):
    return files.parse_reports(view(spark, sf_dir, "reports_raw"))


@register("p3_strip", oracle(["reports"], f"""
SELECT study_id, {strip_sql('findings')} AS findings, {strip_sql('impression')} AS impression FROM reports
"""))
def p3_strip(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    return r.select("study_id", T.strip("findings").alias("findings"), T.strip("impression").alias("impression"))


@register("p4_context_space", oracle(["reports"], f"""
SELECT study_id, {strip_sql("coalesce(findings, '') || ' ' || coalesce(impression, '')")} AS Context FROM reports
"""))
def p4_context_space(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    return r.select("study_id", T.context_space("findings", "impression").alias("Context"))


@register("p5_context_period", oracle(["reports"], f"""
SELECT study_id, concat_ws('. ', nullif({strip_sql('findings')}, ''), nullif({strip_sql('impression')}, '')) AS Context
FROM reports
"""))
def p5_context_period(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    return r.select("study_id", T.context_period("findings", "impression").alias("Context"))


@register("p6_context_sql", oracle(["reports"], """
SELECT study_id, coalesce(findings, '') || ' ' || coalesce(impression, '') AS context_text FROM reports
"""))
def p6_context_sql(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    return r.select("study_id", T.context_sql("findings", "impression").alias("context_text"))


@register("p7_training_filter", oracle(["votes"], _CONSENSUS_CTES + f""",
c1 AS (SELECT subject_id, study_id, findings, impression, cl AS label FROM win WHERE rn = 1),
f AS (SELECT subject_id, study_id, label,
             {strip_sql("coalesce(findings, '') || ' ' || coalesce(impression, '')")} AS Context
      FROM c1 WHERE findings IS NOT NULL AND impression IS NOT NULL AND label IN ('Normal', 'Abnormal'))
SELECT subject_id, study_id, Context, CASE label WHEN 'Normal' THEN 0 WHEN 'Abnormal' THEN 1 END AS Result
FROM f WHERE length(Context) > 0
"""))
def p7_training_filter(spark, sf_dir):
    from labelforge.operators.metrics import training_pairs

    return training_pairs(C.consensus(view(spark, sf_dir, "votes")))


@register("p8_encode_label", oracle(["votes"], """
SELECT study_id, model, label, CASE label WHEN 'Normal' THEN 0 WHEN 'Abnormal' THEN 1 END AS Result FROM votes
"""))
def p8_encode_label(spark, sf_dir):
    v = view(spark, sf_dir, "votes")
    return v.select("study_id", "model", "label", E.encode_label("label").alias("Result"))


@register("p9_encode_sentence_label", oracle(["sentence_votes"], """
SELECT parquet_file, row_index, sentence_index, pass,
       CASE Result WHEN 'Yes' THEN 0 WHEN 'No' THEN 1 ELSE 2 END AS label_id FROM sentence_votes
"""))
def p9_encode_sentence_label(spark, sf_dir):
    v = view(spark, sf_dir, "sentence_votes")
    return v.select("parquet_file", "row_index", "sentence_index", "pass",
                    E.encode_sentence_label("Result").alias("label_id"))


# ----------------------------------------------------------------- sentences

_PERIOD_LIST = (f"list_filter(list_transform(string_split(concat_ws('. ', nullif({strip_sql('findings')}, ''), "
                f"nullif({strip_sql('impression')}, '')), '.'), lambda x: {strip_sql('x')}), lambda x: x <> '')")


@register("p10_split_sentences", oracle(["reports"], f"""
l AS (SELECT subject_id, study_id, {_PERIOD_LIST} AS s FROM reports)
SELECT subject_id, study_id, unnest(range(0, len(s))) AS sentence_index, unnest(s) AS sentence FROM l
"""))
def p10_split_sentences(spark, sf_dir):
    r = view(spark, sf_dir, "reports").select("subject_id", "study_id",
                                              T.context_period("findings", "impression").alias("text"))
    return S.split_sentences(r, "text", "period")


@register("p11_split_raw", oracle(["reports_raw"], """
l AS (SELECT path, string_split(text, '.') AS parts FROM reports_raw),
m AS (SELECT path, list_slice(parts, 1, len(parts) - 1) AS s FROM l)
SELECT path, unnest(range(0, len(s))) AS sentence_index, unnest(s) AS sentence FROM m
"""))
def p11_split_raw(spark, sf_dir):
    return S.split_sentences(view(spark, sf_dir, "reports_raw"), "text", "raw")


@register("p12_split_punct", oracle(["reports"], f"""
l AS (SELECT subject_id, study_id,
             list_filter(list_transform(regexp_split_to_array(coalesce(findings || ' ', '') || coalesce(impression, ''),
                                                              '[.!?]'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS s
      FROM reports)
SELECT subject_id, study_id, len(s) AS n_sentences, s[1] AS first_sentence FROM l
"""))
def p12_split_punct(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    text = F.concat(F.coalesce(F.concat(F.col("findings"), F.lit(" ")), F.lit("")), F.coalesce("impression", F.lit("")))
    arr = S.sentence_array(text, "punct")
    return r.select("subject_id", "study_id", S.count_sentences(text, "punct").alias("n_sentences"),
                    F.get(arr, 0).alias("first_sentence"))


@register("p13_cap_work", oracle(["reports"], f"""
l AS (SELECT 'shard-' || cast(doc_id % 3 AS string) || '.parquet' AS parquet_file, doc_id AS row_index,
             {_PERIOD_LIST} AS s FROM reports),
e AS (SELECT parquet_file, row_index, unnest(range(0, len(s))) AS sentence_index, unnest(s) AS sentence FROM l)
SELECT * FROM e WHERE row_index < {ST.SMALL_RUN_MAX_ROWS_PER_FILE} AND sentence_index < {ST.SMALL_RUN_MAX_SENTENCES}
  AND parquet_file = (SELECT min(parquet_file) FROM e)
"""))
def p13_cap_work(spark, sf_dir):
    # The reference's small-run knobs (1 shard, 5 rows per shard, 3 sentences per report).
    r = view(spark, sf_dir, "reports").select(
        F.concat(F.lit("shard-"), (F.col("doc_id") % 3).cast("string"), F.lit(".parquet")).alias("parquet_file"),
        F.col("doc_id").alias("row_index"), T.context_period("findings", "impression").alias("text"))
    return S.cap_work(S.split_sentences(r, "text", "period"), max_files=ST.SMALL_RUN_MAX_FILES,
                       max_rows_per_file=ST.SMALL_RUN_MAX_ROWS_PER_FILE,
                       max_sentences=ST.SMALL_RUN_MAX_SENTENCES)


@register("w4_provenance_index", oracle([], f"""
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS s
      FROM documents)
SELECT 'documents.parquet' AS parquet_file, doc_id AS row_index, unnest(range(0, len(s))) AS sentence_index,
       unnest(s) AS sentence FROM l
"""))
def w4_provenance_index(spark, sf_dir):
    # documents are stored in doc_id order, so the shard row index equals doc_id
    docs = files.read_reports(spark, f"{sf_dir}/documents.parquet").select("parquet_file", "row_index", "text")
    return S.split_sentences(docs, "text", "period")


# ------------------------------------------------------------------ prompts


@register("p14_doc_prompt", oracle(["reports"], f"""
SELECT study_id, {lit(T.DOC_INSTRUCTION)} || findings || {lit(T.DOC_IMPRESSION_JOIN)} || impression AS prompt
FROM reports
"""))
def p14_doc_prompt(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    return r.select("study_id", T.doc_prompt("findings", "impression").alias("prompt"))


_HEAD, _TAIL = T.SENTENCE_TEMPLATE.split("{sentence}")


@register("p15_sentence_prompt", oracle(["reports"], f"""
l AS (SELECT study_id, {_PERIOD_LIST} AS s FROM reports),
e AS (SELECT study_id, unnest(range(0, len(s))) AS sentence_index, unnest(s) AS sentence FROM l)
SELECT study_id, sentence_index, {lit(T.SENTENCE_SYSTEM)} AS system_message,
       {lit(_HEAD)} || sentence || {lit(_TAIL)} AS user_message FROM e
"""))
def p15_sentence_prompt(spark, sf_dir):
    r = view(spark, sf_dir, "reports").select("study_id", T.context_period("findings", "impression").alias("text"))
    s = S.split_sentences(r, "text", "period")
    return s.select("study_id", "sentence_index", F.lit(T.SENTENCE_SYSTEM).alias("system_message"),
                    T.sentence_prompt("sentence").alias("user_message"))


@register("p16_flatten_newlines", oracle(["reports"], """
SELECT study_id, replace(findings, chr(10), ' ') AS findings_flat FROM reports
"""))
def p16_flatten_newlines(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    return r.select("study_id", T.flatten_newlines("findings").alias("findings_flat"))


# --------------------------------------------------------------------- JSON


@register("p17_extract_label_json", oracle(["raw_outputs"], """
SELECT doc_id,
       CASE WHEN json_valid(raw_ai_output) THEN json_extract_string(raw_ai_output, '$.label') END AS label,
       CASE WHEN json_valid(raw_ai_output) THEN json_extract_string(raw_ai_output, '$.explanation') END AS explanation,
       raw_ai_output
FROM raw_outputs
"""))
def p17_extract_label_json(spark, sf_dir):
    r = view(spark, sf_dir, "raw_outputs")
    return r.select("doc_id", E.extract_label_json("raw_ai_output", "label").alias("label"),
                    E.extract_label_json("raw_ai_output", "explanation").alias("explanation"), "raw_ai_output")


@register("p18_parse_json_strict", oracle(["raw_outputs"], """
SELECT doc_id,
       coalesce(CASE WHEN json_valid(raw_ai_output) THEN json_type(raw_ai_output) = 'OBJECT' END, false) AS ok,
       CASE WHEN json_valid(raw_ai_output) THEN json_extract_string(raw_ai_output, '$.label') END AS label,
       CASE WHEN json_valid(raw_ai_output) THEN json_extract_string(raw_ai_output, '$.explanation') END AS explanation
FROM raw_outputs
"""))
def p18_parse_json_strict(spark, sf_dir):
    r = view(spark, sf_dir, "raw_outputs").select("doc_id", E.parse_json_strict("raw_ai_output").alias("p"))
    return r.select("doc_id", F.col("p.ok").alias("ok"), F.col("p.value.label").alias("label"),
                    F.col("p.value.explanation").alias("explanation"))


@register("p19_first_text_part", oracle([], """
SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '' ELSE text END AS content FROM conversations
"""))
def p19_first_text_part(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    part = lambda t, x: F.struct(F.lit(t).alias("type"), x.cast("string").alias("text"))
    parts = (F.when(F.col("turn") % 3 == 0, F.array(part("image_url", F.lit(None)), part("text", F.col("text"))))
             .when(F.col("turn") % 3 == 1, F.array(part("text", F.lit(None)), part("text", F.col("text"))))
             .otherwise(F.array(part("refusal", F.col("text")))))
    return conv.select("conv_id", "turn", E.first_text_part(parts).alias("content"))


# ------------------------------------------------------------- names, tags

_M0, _M1, _M2 = ST.MODEL_NAMES
_MODEL_NAMES_SQL = f"""CASE doc_id % 5 WHEN 0 THEN '{_M0}' WHEN 1 THEN '{_M1}'
                       WHEN 2 THEN '{_M2}' WHEN 3 THEN 'local/other-model'
                       ELSE '{_M0}' END"""


def model_name_col():
    return F.expr(_MODEL_NAMES_SQL)


@register("p20_short_model_name", oracle([], f"""
SELECT doc_id, {_MODEL_NAMES_SQL} AS model_name,
       CASE WHEN contains({_MODEL_NAMES_SQL}, 'Bio_ClinicalBERT') THEN 'Bio_ClinicalBERT-document'
            WHEN contains({_MODEL_NAMES_SQL}, 'deberta-v3-base') THEN 'DeBERTa-v3-base-document'
            WHEN contains({_MODEL_NAMES_SQL}, 'RadBERT-RoBERTa-4m') THEN 'RadBERT-4m-document'
            ELSE {_MODEL_NAMES_SQL} END AS Model,
       replace({_MODEL_NAMES_SQL}, '/', '_') AS clean_name
FROM labels
"""))
def p20_short_model_name(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", model_name_col().alias("model_name"))
    return lab.select("doc_id", "model_name", E.short_model_name("model_name").alias("Model"),
                      E.clean_name("model_name").alias("clean_name"))


@register("p21_method_label", oracle(["predictions"], """
SELECT doc_id, method, CASE method WHEN 'Baseline' THEN 'baseline loss'
                                   WHEN 'Contrastive_Last_Layer' THEN 'contrastive loss' END AS Loss
FROM predictions
"""))
def p21_method_label(spark, sf_dir):
    p = view(spark, sf_dir, "predictions")
    return p.select("doc_id", "method", E.method_label("method").alias("Loss"))


@register("p22_tag_column", oracle(["reports"], """
SELECT subject_id, study_id, 'teacher_a' AS model FROM reports
"""))
def p22_tag_column(spark, sf_dir):
    return view(spark, sf_dir, "reports").select("subject_id", "study_id").withColumn("model", F.lit("teacher_a"))


@register("p23_run_metadata", oracle(["predictions"], """
p AS (SELECT *, CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS prediction FROM predictions)
SELECT true AS stamped, 'local/other-model' AS model_name, method,
       count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
       20 AS num_epochs, CAST(4e-5 AS DOUBLE) AS learning_rate
FROM p GROUP BY method
"""))
def p23_run_metadata(spark, sf_dir):
    from labelforge.operators.metrics import confusion, run_metadata

    p = view(spark, sf_dir, "predictions").withColumn(
        "prediction", F.when(F.col("logit1") > F.col("logit0"), 1).otherwise(0))
    m = run_metadata(confusion(p, "label", "prediction", ["method"]), model_name="local/other-model",
                     num_epochs=ST.NUM_EPOCHS, learning_rate=ST.LEARNING_RATE)
    # the run time differs per run: check its shape (ISO, UTC) rather than its value
    stamped = F.col("run_timestamp_utc").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$")
    return m.select(stamped.alias("stamped"), *[c for c in m.columns if c != "run_timestamp_utc"])


@register("p24_is_blank", oracle(["votes"], """
SELECT study_id, model, explanation IS NULL OR trim(explanation) = '' AS blank FROM votes
"""))
def p24_is_blank(spark, sf_dir):
    v = view(spark, sf_dir, "votes")
    return v.select("study_id", "model", T.is_blank("explanation").alias("blank"))


@register("p17_extract_json_events", oracle([], """
SELECT event_id, event_type, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k
FROM events
"""))
def p17_extract_json_events(spark, sf_dir):
    # the same field extraction over a driver column of JSON text
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "event_type", E.extract_label_json("props", "k").alias("k"))
