"""Sources and sinks (S1–S20) and restartable runs.

Sink queries write to a fresh folder under the session's shared checkpoint
folder and return the table read back, so the oracle checks the round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.operators import consensus as C
from labelforge.operators import incremental as I
from labelforge.operators import metrics as M
from labelforge.operators import teacher as TE
from labelforge.plans import settings as ST
from labelforge.plans.q_consensus import _CONSENSUS_CTES
from labelforge.plans.q_metrics import _CONF, scored
from labelforge.plans.q_text import FIND_SQL, IMPR_SQL, PATH_SQL, strip_sql
from labelforge.plans.registry import register
from labelforge.plans.sqltext import oracle
from labelforge.session import scratch_path, table
from labelforge.sources import files, sinks
from labelforge.sources.fixtures import view
from labelforge.streaming import folders
from labelforge.streaming.resume import run_to_completion

KEYS = ["subject_id", "study_id"]

_PARSED_SQL = oracle(["reports_raw"], f"""
SELECT regexp_extract(path, '{PATH_SQL}', 1) AS subject_id, regexp_extract(path, '{PATH_SQL}', 2) AS study_id,
       {strip_sql(f"regexp_extract(text, '{FIND_SQL}', 1)")} AS findings,
       {strip_sql(f"regexp_extract(text, '{IMPR_SQL}', 1)")} AS impression
FROM reports_raw
""")

_C1_SQL = oracle(["votes"], _CONSENSUS_CTES + """
SELECT subject_id, study_id, findings, impression, cl AS label, explanation, cc AS confidence FROM win WHERE rn = 1
""")


def _tname(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


@register("s1_read_reports", oracle([], """
SELECT doc_id, 'documents.parquet' AS parquet_file, doc_id AS row_index FROM documents
UNION ALL SELECT doc_id, 'labels.parquet', row_number() OVER (ORDER BY doc_id) - 1 FROM labels
"""))
def s1_read_reports(spark, sf_dir):
    # two shards stacked; both driver files are stored in doc_id order
    df = files.read_reports(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet")
    return df.select("doc_id", "parquet_file", "row_index")


@register("s2_read_study_list", oracle([], "SELECT page_id, url FROM pages"))
def s2_read_study_list(spark, sf_dir):
    path = scratch_path(spark, "study_list")
    table(spark, sf_dir, "pages").select("page_id", "url").write.option("header", True) \
        .option("compression", "gzip").csv(path)
    return files.read_study_list(spark, path, "page_id long, url string", partitions=8)


@register("s3_partition_prefix_filter", oracle(["reports_raw"], """
SELECT path FROM reports_raw WHERE starts_with(path, 'files/p10/')
"""))
def s3_partition_prefix_filter(spark, sf_dir):
    return files.partition_prefix_filter(view(spark, sf_dir, "reports_raw").select("path"), "files/p10/")


def _staged_reports(spark, sf_dir):
    root = scratch_path(spark, "reports_txt")
    sinks.write_report_files(view(spark, sf_dir, "reports_raw"), root)
    return root


@register("s4_read_report_files", _PARSED_SQL)
def s4_read_report_files(spark, sf_dir):
    root = _staged_reports(spark, sf_dir)
    return files.parse_reports(files.read_report_files(spark, root))


@register("s3_partition_glob", oracle(["reports_raw"], f"""
SELECT regexp_extract(path, '{PATH_SQL}', 2) AS study_id FROM reports_raw WHERE starts_with(path, 'files/p10/')
"""))
def s3_partition_glob(spark, sf_dir):
    # only the p10 folder is listed: the partition choice is a path glob
    root = _staged_reports(spark, sf_dir)
    raw = files.read_report_files(spark, f"{root}/files/p10/")
    return raw.select(F.regexp_extract("path", PATH_SQL, 2).alias("study_id"))


@register("s5_unzip_reports", _PARSED_SQL)
def s5_unzip_reports(spark, sf_dir):
    root = scratch_path(spark, "reports_zip")
    sinks.write_zip_archives(view(spark, sf_dir, "reports_raw"), root)
    members = files.unzip_reports(spark, f"{root}/*.zip")
    return files.parse_reports(members.select(F.col("member").alias("path"), "text"))


@register("s6_read_folder_batches", oracle(["reports_raw"], r"""
SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS folder, count(*) AS n_files FROM reports_raw GROUP BY 1
"""))
def s6_read_folder_batches(spark, sf_dir):
    root = _staged_reports(spark, sf_dir)
    df = files.read_folder_batches(spark, root)
    return df.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


@register("s7_write_parquet", oracle(["reports"], """
SELECT subject_id, study_id, findings, impression FROM reports
"""))
def s7_write_parquet(spark, sf_dir):
    path = scratch_path(spark, "reports_parquet")
    sinks.write_parquet(view(spark, sf_dir, "reports").select(*KEYS, "findings", "impression"), path, KEYS)
    return spark.read.parquet(path)


@register("s8_save_table", _C1_SQL)
def s8_save_table(spark, sf_dir):
    name = _tname("consensus")
    sinks.save_table(C.consensus(view(spark, sf_dir, "votes")), name, scratch_path(spark, name))
    return sinks.read_table(spark, name)


@register("s9_create_table_as", oracle(["reports"], """
SELECT subject_id, study_id, findings, impression FROM reports
"""))
def s9_create_table_as(spark, sf_dir):
    name = _tname("extract")
    full = sinks.create_table_as(view(spark, sf_dir, "reports").select(*KEYS, "findings", "impression"), name, 1,
                                 scratch_path(spark, name))
    return spark.table(full)


@register("s10_rewrite_with_column", oracle(["votes"], """
SELECT subject_id, study_id, model, explanation IS NULL OR trim(explanation) = '' AS blank_expl,
       confidence IS NULL AS null_conf FROM votes
"""))
def s10_rewrite_with_column(spark, sf_dir):
    name = _tname("scored")
    sinks.create_table_as(view(spark, sf_dir, "votes").drop("confidence"), name, 1, scratch_path(spark, name))
    sinks.rewrite_with_column(spark, name, 1, lambda d: TE.explanation_confidence(d, [*KEYS, "model"]),
                              scratch_path(spark, name + "_v2"))
    t = spark.table(name)  # the swapped view
    from labelforge.functions.text import is_blank

    return t.select(*KEYS, "model", is_blank("explanation").alias("blank_expl"),
                    F.col("confidence").isNull().alias("null_conf"))


@register("s11_read_table", oracle(["votes"], "SELECT subject_id, study_id, model, label FROM votes"))
def s11_read_table(spark, sf_dir):
    name = _tname("votes")
    sinks.save_table(view(spark, sf_dir, "votes"), name, scratch_path(spark, name))
    return sinks.read_table(spark, name).select(*KEYS, "model", "label")


@register("s12_read_training_set", oracle(["votes"], _CONSENSUS_CTES + """
SELECT subject_id, study_id, findings, impression, cl AS label, cc AS confidence FROM win
WHERE rn = 1 AND findings IS NOT NULL AND impression IS NOT NULL AND cl IN ('Normal', 'Abnormal')
"""))
def s12_read_training_set(spark, sf_dir):
    name = _tname("consensus")
    sinks.save_table(C.consensus(view(spark, sf_dir, "votes")), name, scratch_path(spark, name))
    return sinks.read_training_set(spark, name)


_SV_COLS = "parquet_file, row_index, sentence_index, pass, Result, confidence"


@register("s13_read_vote_json", oracle(["sentence_votes"], f"SELECT {_SV_COLS} FROM sentence_votes"))
def s13_read_vote_json(spark, sf_dir):
    root = scratch_path(spark, "vote_arrays")
    sv = view(spark, sf_dir, "sentence_votes")
    sinks.write_json_arrays(sv, root)
    schema = T.StructType([T.StructField("parquet_file", T.StringType()), T.StructField("row_index", T.LongType()),
                           T.StructField("sentence_index", T.IntegerType()), T.StructField("pass", T.IntegerType()),
                           T.StructField("Result", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return files.read_vote_json(spark, root, schema)


@register("s14_write_vote_json", oracle(["sentence_votes"], f"SELECT {_SV_COLS} FROM sentence_votes"))
def s14_write_vote_json(spark, sf_dir):
    path = scratch_path(spark, "vote_lines")
    sv = view(spark, sf_dir, "sentence_votes")
    sinks.write_vote_json(sv, path)
    return spark.read.schema(sv.schema).json(path).select(*[c.strip() for c in _SV_COLS.split(",")])


_METRICS_SCHEMA = ("model_name string, method string, split string, tn long, fp long, fn long, tp long, "
                   "accuracy double, precision double, recall double, f1 double")
_METRICS_SQL = "SELECT model_name, method, split, tn, fp, fn, tp, accuracy, precision, recall, f1 FROM mt"


@register("s15_append_metrics", oracle(["predictions"], _CONF + f"""
{_METRICS_SQL} UNION ALL {_METRICS_SQL}
"""))
def s15_append_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics_append")
    m = M.split_metrics(scored(spark, sf_dir), ["model_name", "method", "split"])
    sinks.append_metrics(m, path)
    sinks.append_metrics(m, path)
    return files.read_metrics_glob(spark, path, _METRICS_SCHEMA)


@register("s16_overwrite_metrics", oracle(["predictions"], _CONF + "\n" + _METRICS_SQL))
def s16_overwrite_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics_overwrite")
    m = M.split_metrics(scored(spark, sf_dir), ["model_name", "method", "split"])
    sinks.overwrite_metrics(m, path)
    sinks.overwrite_metrics(m, path)
    return files.read_metrics_glob(spark, path, _METRICS_SCHEMA)


@register("s17_read_metrics_glob", oracle(["predictions"], _CONF + "\n" + _METRICS_SQL))
def s17_read_metrics_glob(spark, sf_dir):
    from labelforge.functions.encode import clean_name

    root = scratch_path(spark, "metrics_dir")
    m = M.split_metrics(scored(spark, sf_dir), ["model_name", "method", "split"])
    # one <clean model name>_metrics.csv folder per model, written in one job
    named = m.withColumn("metrics_file", F.concat(clean_name("model_name"), F.lit("_metrics.csv")))
    named.write.mode("overwrite").option("header", True).partitionBy("metrics_file").csv(root)
    return files.read_metrics_glob(spark, f"{root}/metrics_file=*_metrics.csv", _METRICS_SCHEMA)


@register("s18_write_predictions", oracle(["predictions"], """
SELECT p.doc_id, p.method, d.text, CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS prediction, p.label AS true_label
FROM predictions p JOIN documents d ON d.doc_id = p.doc_id
"""))
def s18_write_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions_csv")
    rep = M.prediction_report(scored(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("Context")),
                              ["doc_id"], keep=("method",))
    sinks.write_predictions(rep.select("doc_id", "method", "text", "prediction", "true_label"), path)
    return sinks.read_predictions(spark, path, "doc_id long, method string, text string, prediction int, true_label int")


@register("s20_describe_source", oracle([], """
c AS (SELECT count(*) AS n, count(doc_id) AS c0, count(text) AS c1, count(lang) AS c2, count(source) AS c3,
             count(n_chars) AS c4 FROM documents),
s AS (SELECT ordinal_position - 1 AS position, column_name AS name,
             CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
                            WHEN 'DOUBLE' THEN 'double' ELSE lower(data_type) END AS type, true AS nullable
      FROM information_schema.columns WHERE table_name = 'documents')
SELECT s.position, s.name, s.type, s.nullable, c.n AS rows,
       CASE s.position WHEN 0 THEN c.c0 WHEN 1 THEN c.c1 WHEN 2 THEN c.c2 WHEN 3 THEN c.c3 ELSE c.c4 END AS non_null
FROM s CROSS JOIN c
"""))
def s20_describe_source(spark, sf_dir):
    return files.describe_source(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------- resumable runs

def _units(spark, sf_dir):
    return view(spark, sf_dir, "reports_raw").select(
        "path", "text", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))


def _label(df):
    out = files.parse_reports(df)
    return out.withColumn("folder", F.col("subject_id"))


@register("j5_remaining_work", oracle(["reports_raw"], r"""
f AS (SELECT path, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS folder FROM reports_raw),
done AS (SELECT DISTINCT path FROM f ORDER BY path LIMIT {cap})
SELECT path, folder FROM f WHERE path NOT IN (SELECT path FROM done)
""".replace("{cap}", str(ST.TEST_FOLDER_CAP))))
def j5_remaining_work(spark, sf_dir):
    # the unit of work is a report file: what one capped run leaves
    root = scratch_path(spark, "resume_j5")
    units = _units(spark, sf_dir).select("path", "folder")
    I.resume_labelling(spark, units, "path", root, lambda d: d, cap=ST.TEST_FOLDER_CAP)
    processed, _ = I.load_state(spark, root)
    return I.remaining_work(units, processed, "path")


@register("x1_resume_labelling", _PARSED_SQL)
def x1_resume_labelling(spark, sf_dir):
    # capped runs until nothing is left; the union of committed results equals one full run
    root = scratch_path(spark, "resume_x1")
    _run_to_the_end(spark, _units(spark, sf_dir), root, _label)
    return I.committed_results(spark, root, "folder").drop("folder")


def _run_to_the_end(spark, units, root, label, **kw):
    total = units.select("folder").distinct().count()
    for _ in range(-(-total // ST.TEST_FOLDER_CAP) + 1):
        I.resume_labelling(spark, units, "folder", root, label, cap=ST.TEST_FOLDER_CAP, **kw)


def _label_or_fail(df):
    """A labeller that cannot reach the folders whose number ends in 3."""
    return _label(df).withColumn("error", F.when(F.col("folder").endswith("3"), F.concat(F.lit("unreachable: "), "folder")))


@register("x1_resume_with_failures", _PARSED_SQL + r"""
WHERE NOT regexp_matches(path, '3/[^/]+$')
""")
def x1_resume_with_failures(spark, sf_dir):
    root = scratch_path(spark, "resume_failures")
    _run_to_the_end(spark, _units(spark, sf_dir), root, _label_or_fail, error_col="error")
    return I.committed_results(spark, root, "folder").drop("folder")


@register("s19_dead_letter", oracle(["reports_raw"], r"""
f AS (SELECT DISTINCT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS unit FROM reports_raw)
SELECT unit, 'unreachable: ' || unit AS error FROM f WHERE ends_with(unit, '3')
"""))
def s19_dead_letter(spark, sf_dir):
    root = scratch_path(spark, "resume_dead")
    _run_to_the_end(spark, _units(spark, sf_dir), root, _label_or_fail, error_col="error")
    _, dead = I.load_state(spark, root)
    return dead.select("unit", "error")


@register("s19_checkpoint_state", oracle(["reports_raw"], r"""
SELECT DISTINCT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS unit FROM reports_raw
"""))
def s19_checkpoint_state(spark, sf_dir):
    root = scratch_path(spark, "resume_s19")
    units = _units(spark, sf_dir).select("path", "folder")
    I.resume_labelling(spark, units, "folder", root, lambda d: d, cap=None)
    processed, _ = I.load_state(spark, root)
    return processed.select("unit")


@register("x1_resume_stream", _PARSED_SQL)
def x1_resume_stream(spark, sf_dir):
    inbox = scratch_path(spark, "inbox")
    units = _units(spark, sf_dir)
    # a folder's rows by one task: the files, and with them the micro-batches, grow with the rows, not with folders times tasks
    units.repartition("folder").write.option("maxRecordsPerFile", 20_000).partitionBy("folder").parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    out = run_to_completion(spark, inbox, schema, scratch_path(spark, "stream_out"),
                            scratch_path(spark, "stream_ckpt"), lambda b: files.parse_reports(b), files_per_trigger=16)
    return out.drop("batch_id")


@register("x1_stream_folder_status", oracle(["reports_raw"], r"""
f AS (SELECT regexp_extract(path, '([^/]+)/[^/]+$', 1) AS unit, coalesce(length(text), 0) % 5 = 0 OR ends_with(regexp_extract(path, '([^/]+)/[^/]+$', 1), '3') AS bad
      FROM reports_raw),
n AS (SELECT unit, count(*) AS rows, count(*) FILTER (bad) AS failed FROM f GROUP BY 1)
SELECT unit, rows, failed, CASE WHEN failed = 0 THEN 'done' WHEN failed < rows THEN 'partial' ELSE 'failed' END AS status,
       CASE WHEN failed > 0 THEN 'unreachable: ' || unit END AS error
FROM n
"""))
def x1_stream_folder_status(spark, sf_dir):
    # the labeller fails on whole folders and on single texts (by length)
    inbox, root = scratch_path(spark, "status_inbox"), scratch_path(spark, "status_run")
    # shards of many folders: a file for each folder would be a file for each few reports
    _units(spark, sf_dir).write.option("maxRecordsPerFile", 20_000).parquet(inbox)
    schema = spark.read.parquet(inbox).schema

    def label(df):
        bad = (F.coalesce(F.length("text"), F.lit(0)) % 5 == 0) | F.col("folder").endswith("3")
        return df.withColumn("error", F.when(bad, F.concat(F.lit("unreachable: "), "folder")))

    return folders.drain(spark, inbox, schema, root, label, "folder", "error", files_per_trigger=4).drop("closed")
