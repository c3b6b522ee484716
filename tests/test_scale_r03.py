"""Steps that grew faster than their input: memory of the scripted teacher, plans, listings, shares."""

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from labelforge.operators import calls as CA
from labelforge.operators import consensus as C
from labelforge.operators import embedding_store as ES
from labelforge.operators import neighbours as N
from labelforge.operators import teacher as TE
from labelforge.sources import files, sinks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scripted_teacher_forgets(monkeypatch):
    """answered prompts are kept up to a bound, those on their way all."""
    monkeypatch.setattr(TE, "REMEMBERED", 50)
    call = TE.scripted_failures(TE.rule_teacher(fence_every=0))()
    prompts = pd.Series([f"{i:05d}" for i in range(300)], dtype=object)  # length 5: fails twice
    late = [sum(isinstance(r, TimeoutError) for r in call(prompts)) for _ in range(3)]
    assert late == [300, 300, 0]
    held = [c.cell_contents for c in call.__closure__ if isinstance(c.cell_contents, dict)]
    assert len(held) == 2 and sum(map(len, held)) == 50
    assert not any(isinstance(r, TimeoutError) for r in call(prompts[-50:]))


def test_skip_after_failure_hashes_the_reports(spark):
    """the results are not sorted for the join."""
    res = spark.createDataFrame([("a", 0, None), ("a", 1, "x"), ("a", 2, None), ("b", 0, None)], "rep string, sentence_index int, error string")
    out = TE.skip_after_failure(res, ["rep"])
    assert "shuffle_hash" in plan_of(out)
    assert sorted((r.rep, r.sentence_index) for r in out.collect()) == [("a", 0), ("b", 0)]


def test_teachers_are_asked_in_one_scan(spark):
    """one scan and one trip of the prompt, for reports and for sentences."""
    teachers = [TE.rule_teacher(s) for s in range(3)]
    s = spark.createDataFrame([("r", 0, "a"), ("r", 1, None)], "rep string, sentence_index int, sentence string")
    votes = TE.label_sentences(s, teachers, ["rep", "sentence_index"])
    assert plan_of(votes).count("LogicalRDD") == 1 and "Union" not in plan_of(votes)
    got = {(r.sentence_index, r["pass"]): r.raw_ai_output for r in votes.collect()}
    assert len(got) == 6 and {p for _, p in got} == {1, 2, 3}
    r = spark.createDataFrame([("p", "s", "f", "i"), ("p", "t", None, "i")], "subject_id string, study_id string, findings string, impression string")
    both = TE.label_documents_all(r, dict(zip("abc", teachers)))
    assert "MapInPandas" not in plan_of(both)
    each = [TE.label_documents(r, t, m) for m, t in zip("abc", teachers)]
    want = each[0].unionByName(each[1]).unionByName(each[2])
    assert sorted(map(str, both.collect())) == sorted(map(str, want.select(*both.columns).collect())) and both.count() == 6


def test_encoder_counts_by_batch(spark):
    """unit vectors of bucket counts, whatever repeats; no shuffle in place."""
    import hashlib

    texts = [None, "", "  ", "a b a", "a b a", "Éa-1_b\nb", "ZZ"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    out = TE.embed_text(df, "t", dedupe=False)
    assert "Join" not in plan_of(out) and "Aggregate" not in plan_of(out)
    words = [[], [], [], ["a", "b", "a"], ["a", "b", "a"], ["éa", "1", "b", "b"], ["zz"]]
    for r in out.collect():
        v = np.zeros(64)
        for w in words[r.k]:
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        assert r.embedding == (v / max(np.sqrt((v * v).sum()), 1e-12)).tolist()


def test_text_of_null_labels_stays_behind(spark):
    """the loser's text and that of NULL labels do not ride along."""
    rows = [("p", "s", None, None, None, "m", "f" * 50, "i")] * 3 + [("p", "t", "N", "e", 0.5, "m", "f", "i"), ("p", "t", "N", "d", 0.7, "l", "g", "i")]
    v = spark.createDataFrame(rows, "subject_id string, study_id string, label string, explanation string, confidence double, model string, findings string, impression string")
    out = C.consensus_with_text(v)
    assert [tuple(r) for r in out.collect()] == [("p", "t", "g", "i", "N", "d", 0.6)]
    loser = next(line for line in plan_of(out).splitlines() if " AS bot" in line).split(" AS bot")[0].split("min(")[-1]
    assert "w#" not in loser, loser


def test_shares_grow_with_the_work(spark):
    """the exchanges do not grow in number with the calls."""
    df = spark.createDataFrame([(f"r{r}", s, 1, "p") for r in range(60) for s in range(40)], "rep string, sentence_index int, pass int, prompt string")
    start = time.monotonic()
    made = CA.ordered_calls(df, "prompt", TE.rule_teacher(), ["rep", "sentence_index", "pass"], ["rep"], budget=3600, tasks=2, lease=8)
    rows = made.collect()
    took = time.monotonic() - start
    assert len(rows) == 1200 and sum(r.calls for r in rows) == 3600
    assert took < 40, took  # shares of 8 would take 75 exchanges of a second


def test_report_files_are_listed_by_tasks(spark, tmp_path):
    """Names and texts without the driver's file index; odd names and bytes as Spark reads them."""
    texts = {"files/p10/a b/s1.txt": b"x\xff\xc3y", "files/p10/a b/.hid.txt": b"n", "files/p11/_no/s2.txt": b"n", "files/p11/s3.TXT": b"n",
             "files/p11/s4.txt": b"", "s5.txt": "é�z".encode(), "files/p11/p/s6.md": b"n"}
    for name, data in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    df = files.read_report_files(spark, str(tmp_path))
    assert "binaryFile" not in plan_of(df) and "text(" not in plan_of(df)
    got = {r.path.split(tmp_path.name + "/")[1].replace("%20", " "): r.text for r in df.collect()}
    assert got == {"files/p10/a b/s1.txt": "xy", "s5.txt": "éz"}
    old = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(str(tmp_path), wholetext=True)
    assert sorted(r.path for r in df.collect()) == sorted(r.path for r in old.select(F.col("_metadata.file_path").alias("path")).collect())
    assert files._name_patterns("*.{txt,md}") == ["*.txt", "*.md"]
    assert files.read_report_files(spark, str(tmp_path / "files/p1*"), "*.{md,txt}").count() == 2


def test_vote_arrays_keep_their_cells(spark, tmp_path):
    """numbers as they are (a missing one used to turn a batch's integers into floats), not-a-number as NULL."""
    rows = [("a\"é\n", 1 << 60, 0.1, None), (None, None, float("nan"), True), ("x", 3, 1e-9, False)]
    df = spark.createDataFrame(rows, "t string, n long, d double, b boolean").coalesce(1)
    root = str(tmp_path / "v")
    assert sinks.write_json_arrays(df, root) == 2
    assert isinstance(json.load(open(f"{root}/votes-00000-00000.json")), list) and len(os.listdir(root)) == 2
    got = files.read_vote_json(spark, root, df.schema).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], (None, None, None, True), rows[2]]))


def test_store_joins_by_bytes(spark, tmp_path):
    """digests travel as bytes, and no text is shuffled for the lookup."""
    d = spark.createDataFrame([("a",), (None,)], "t string").select(ES.text_digest("t").alias("d"))
    assert sorted(len(r.k) for r in d.select(ES.digest_key("d").alias("k")).collect()) == [4, 32]


def test_pairs_meet_between(spark):
    """the second round finds the same neighbours as all pairs through a neighbour."""
    x = np.random.default_rng(5).normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    assert N._points(df, "id", "v").schema["v"].dataType.elementType.typeName() == "float"
    first = {}
    for r in N.nearest_neighbours(df, "id", "v", 4, 2, 40, refine=0).collect():
        first.setdefault(r.key, set()).add(r.neighbour)
    got = {}
    for r in N.nearest_neighbours(df, "id", "v", 4, 2, 40).collect():
        got.setdefault(r.key, {})[r.place] = r.neighbour
    y = x.astype(float)
    for key, near in first.items():
        reach = (near | set().union(*(first[m] for m in near))) - {key}
        want = sorted(reach, key=lambda j: (np.sqrt(((y[j] - y[key]) ** 2).sum()), j))[:4]
        assert [got[key][p] for p in (1, 2, 3, 4)] == want
