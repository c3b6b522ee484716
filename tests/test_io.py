"""Sources, sinks and restartable runs on small staged files."""

import io
import json
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from labelforge.operators import incremental as I
from labelforge.sources import files, sinks


def test_report_files_drop_bad_bytes(spark):
    root = tempfile.mkdtemp(prefix="lf-reports-")
    d = os.path.join(root, "files", "p10", "p10000032")
    os.makedirs(d)
    with open(os.path.join(d, "s50414267.txt"), "wb") as f:
        f.write(b"FINDINGS: clear\xff lungs.\nIMPRESSION: normal.\n")
    with open(os.path.join(d, "notes.md"), "wb") as f:
        f.write(b"ignored")
    rows = files.parse_reports(files.read_report_files(spark, root)).collect()
    assert [(r.subject_id, r.study_id, r.findings, r.impression) for r in rows] == \
        [("p10000032", "s50414267", "clear lungs.", "normal.")]


def test_zip_members_case_insensitive(spark):
    root = tempfile.mkdtemp(prefix="lf-zip-")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("files/p10/p1/s1.TXT", "FINDINGS: a\nIMPRESSION: b")
        zf.writestr("files/p10/p1/readme.pdf", "x")
        zf.writestr("files/p10/", "")
    with open(os.path.join(root, "a.zip"), "wb") as f:
        f.write(buf.getvalue())
    rows = files.unzip_reports(spark, f"{root}/*.zip").collect()
    assert [r.member for r in rows] == ["files/p10/p1/s1.TXT"]


def test_vote_json_arrays_with_empty_file(spark):
    root = tempfile.mkdtemp(prefix="lf-json-")
    rec = {"Result": "No", "Explanation": "e", "Context": "c", "confidence": 0.96,
           "parquet_file": "train-00000-of-00002.parquet", "row_index": 0, "sentence_index": 0}
    with open(os.path.join(root, "v1.json"), "w") as f:
        json.dump([rec, dict(rec, sentence_index=1)], f)
    for name in ("v2.json", "v3.json"):
        with open(os.path.join(root, name), "w") as f:
            f.write("[]")
    df = files.read_vote_json(spark, root)
    assert df.count() == 2 and "Result" in df.columns
    empty = files.read_vote_json(spark, os.path.join(root, "v2.json"))
    assert empty.count() == 0 and empty.columns == df.columns


def test_resume_equals_one_full_run(spark):
    root = tempfile.mkdtemp(prefix="lf-resume-")
    units = spark.createDataFrame([(f"f{i % 9}", i) for i in range(90)], "folder string, x long")
    label = lambda d: d.withColumn("y", F.col("x") * 2)
    runs = 0
    while True:
        processed, _ = I.load_state(spark, root)
        if I.remaining_work(units, processed, "folder").count() == 0:
            break
        I.resume_labelling(spark, units, "folder", root, label, cap=4)
        runs += 1
    assert runs == 3
    got = sorted((r.folder, r.x, r.y) for r in I.committed_results(spark, root, "folder").collect())
    assert got == sorted((f"f{i % 9}", i, 2 * i) for i in range(90))


def test_uncommitted_run_is_invisible(spark):
    root = tempfile.mkdtemp(prefix="lf-crash-")
    units = spark.createDataFrame([("a", 1), ("b", 2)], "folder string, x long")
    # results written but the run "died" before its processed rows were saved
    units.where("folder = 'a'").withColumn("run_id", F.lit("dead")).write.parquet(f"{root}/results/run_id=dead")
    units.where("folder = 'a'").drop("x").withColumn("run_id", F.lit("dead")).limit(0).write.mode("append") \
        .parquet(f"{root}/processed")
    I.resume_labelling(spark, units, "folder", root, lambda d: d)
    got = sorted(r.folder for r in I.committed_results(spark, root, "folder").collect())
    assert got == ["a", "b"]


def test_predictions_csv_round_trip_with_newlines(spark):
    path = tempfile.mkdtemp(prefix="lf-pred-") + "/p"
    df = spark.createDataFrame([(1, 'line1\nline2 "quoted", comma', 1, 0)],
                               "doc_id long, text string, prediction int, true_label int")
    sinks.write_predictions(df, path)
    back = sinks.read_predictions(spark, path, "doc_id long, text string, prediction int, true_label int")
    assert back.collect() == df.collect()


def test_describe_source(spark):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert [tuple(r) for r in files.describe_source(df, with_counts=False).collect()] == \
        [(0, "k", "bigint", True), (1, "v", "string", True)]
    df2 = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert [tuple(r) for r in files.describe_source(df2).collect()] == \
        [(0, "k", "bigint", True, 2, 2), (1, "v", "string", True, 2, 1)]


def test_stream_resume_only_new_files(spark):
    from labelforge.streaming.resume import run_to_completion

    base = tempfile.mkdtemp(prefix="lf-stream-")
    inbox, out, ckpt = f"{base}/inbox", f"{base}/out", f"{base}/ckpt"
    mk = lambda rows: spark.createDataFrame(rows, "path string, text string")
    mk([("files/p10/p1/s1.txt", "FINDINGS: a\nIMPRESSION: b")]).write.mode("append").parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    first = run_to_completion(spark, inbox, schema, out, ckpt, files.parse_reports, files_per_trigger=1)
    assert first.count() == 1
    mk([("files/p10/p2/s2.txt", "IMPRESSION: c")]).write.mode("append").parquet(inbox)
    second = run_to_completion(spark, inbox, schema, out, ckpt, files.parse_reports, files_per_trigger=1)
    got = sorted((r.study_id, r.impression) for r in second.collect())
    assert got == [("s1", "b"), ("s2", "c")]  # the first file was not processed again


def test_resume_with_dead_letters(spark):
    root = tempfile.mkdtemp(prefix="lf-dead-")
    units = spark.createDataFrame([(f"f{i % 4}", i) for i in range(20)], "folder string, x long")
    # folder f3 always fails: its rows go to the dead-letter table, the rest are committed
    label = lambda d: d.withColumn("error", F.when(F.col("folder") == "f3", F.lit("boom")))
    I.resume_labelling(spark, units, "folder", root, label, error_col="error")
    processed, dead = I.load_state(spark, root)
    assert sorted((r.unit, r.status) for r in processed.collect()) == \
        [("f0", "done"), ("f1", "done"), ("f2", "done"), ("f3", "failed")]
    assert [(r.unit, r.error) for r in dead.collect()] == [("f3", "boom")]  # one row per unit and run
    # the queue moves past a failed unit: a second run finds nothing left to do
    I.resume_labelling(spark, units, "folder", root, label, error_col="error")
    processed, dead = I.load_state(spark, root)
    assert processed.count() == 4 and dead.count() == 1
    got = sorted(r.x for r in I.committed_results(spark, root, "folder").collect())
    assert got == sorted(i for i in range(20) if i % 4 != 3)


def test_capped_runs_move_past_failing_and_empty_units(spark):
    root = tempfile.mkdtemp(prefix="lf-starve-")
    units = spark.createDataFrame([(f"f{i % 6}", i) for i in range(30)], "folder string, x long")
    # f0 and f1 always fail, f2 gives no rows, f3 fails in part
    label = lambda d: d.where("folder <> 'f2'").withColumn(
        "error", F.when(F.col("folder").isin("f0", "f1") | (F.col("x") == 3), F.lit("boom")))
    for _ in range(4):
        I.resume_labelling(spark, units, "folder", root, label, cap=2, error_col="error")
    processed, dead = I.load_state(spark, root)
    assert sorted((r.unit, r.status) for r in processed.collect()) == [
        ("f0", "failed"), ("f1", "failed"), ("f2", "empty"), ("f3", "partial"), ("f4", "done"), ("f5", "done")]
    assert sorted(r.unit for r in dead.collect()) == ["f0", "f1", "f3"]
    got = sorted(r.x for r in I.committed_results(spark, root, "folder").collect())
    assert got == [i for i in range(30) if i % 6 in (4, 5) or (i % 6 == 3 and i != 3)]


def test_each_row_is_labelled_once(spark):
    root = tempfile.mkdtemp(prefix="lf-once-")
    calls = spark.sparkContext.accumulator(0)

    def count_calls(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(error=[None if x % 2 else "odd one out" for x in pdf["x"]])

    units = spark.createDataFrame([(f"f{i % 3}", i) for i in range(6)], "folder string, x long")
    I.resume_labelling(spark, units, "folder", root,
                       lambda d: d.mapInPandas(count_calls, "folder string, x long, error string"),
                       cap=10, error_col="error")
    assert calls.value == 6
    assert sorted(r.x for r in I.committed_results(spark, root, "folder").collect()) == [1, 3, 5]


def test_one_archive_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "big.zip")
    want = {f"files/p10/p{i}/s{i}.txt": f"FINDINGS: {i} " + "x" * (i % 50) for i in range(500)}
    with zipfile.ZipFile(path, "w") as zf:
        for name, text in want.items():
            zf.writestr(name, text)
    got = files.unzip_reports(spark, path, part_bytes=4096, batch_bytes=1000, partitions=8)
    rows = got.select("member", "text", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 500 and {r.member: r.text for r in rows} == want
    assert len({r.task for r in rows}) > 4


def test_csv_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "a_metrics.csv").write_text('model_name,tp,accuracy\n"a, ""b""",3,0.5\n')
    (tmp_path / "b_metrics.csv").write_text("accuracy,extra,model_name,tp\n0.25,1,m,7\n,,n,\n")
    (tmp_path / "c_metrics.csv").write_text("model_name,tp\n")
    rows = files.read_metrics_glob(spark, f"{tmp_path}/*_metrics.csv", "model_name string, accuracy double, tp long").collect()
    assert sorted(map(tuple, rows), key=str) == [("a, \"b\"", 0.5, 3), ("m", 0.25, 7), ("n", None, None)]
    (tmp_path / "list.csv").write_text("url,page_id\nu1,1\nu2,x\n")
    rows = files.read_study_list(spark, f"{tmp_path}/list.csv", "page_id long, url string").collect()
    assert [tuple(r) for r in rows] == [(1, "u1"), (None, "u2")]
    (tmp_path / "list2.csv").write_text("page_id,url\n3,u3\n")
    with pytest.raises(Exception):
        files.read_study_list(spark, f"{tmp_path}/list*.csv", "page_id long, url string").collect()


def test_rewrite_only_where_the_table_is(spark, tmp_path):
    df = spark.createDataFrame([("m", 1)], "model_name string, tp long")
    path = str(tmp_path / "metrics")
    assert not sinks.rewrite_metrics(df, path) and not os.path.exists(path)
    sinks.append_metrics(df, path)
    assert sinks.rewrite_metrics(df, path)
    assert files.read_metrics_glob(spark, path, "model_name string, tp long").count() == 1
