"""Teacher calls, retries, budgets and similarities."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from labelforge.operators import teacher as TE


def test_budget_five_gives_one_pass_one_record(spark):
    # the reference's debugging run: budget 5 calls, 3 calls per (sentence, pass)
    s = spark.createDataFrame([("f", 0, i) for i in range(3)], "file string, row long, sentence_index int")
    plan = TE.call_plan_rows(s, passes=3)
    kept = TE.api_budget(plan, ["file", "row", "sentence_index", "pass"], budget=5).collect()
    assert [(r.sentence_index, r["pass"]) for r in kept] == [(0, 1)]
    per_pass = Counter(r["pass"] for r in kept)
    assert (per_pass[1], per_pass[2], per_pass[3]) == (1, 0, 0)


def test_budget_monotone(spark):
    s = spark.createDataFrame([("f", r, i) for r in range(5) for i in range(4)],
                              "file string, row long, sentence_index int")
    plan = TE.call_plan_rows(s, passes=3)
    sizes = [TE.api_budget(plan, ["file", "row", "sentence_index", "pass"], b).count() for b in (0, 10, 100, 1000)]
    assert sizes == sorted(sizes) and sizes[0] == 0 and sizes[-1] == 60


def test_running_total_with_hot_key(spark):
    rnd = random.Random(1)
    # one "file" holds a third of the rows
    rows = [("hot" if i % 3 == 0 else f"f{i % 11}", i, rnd.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "file string, row long, calls int")
    got = {(r.file, r.row): r.cum for r in TE.running_total(df, ["file", "row"], "calls", partitions=7).collect()}
    acc = 0
    for f, r, c in sorted(rows):
        acc += c
        assert got[(f, r)] == acc


def test_retry_and_dead_letter(spark):
    # prompts of length divisible by 13 always fail; by 5 fail twice then succeed
    texts = ["a" * n for n in (13, 10, 7, 26, 11)]
    df = spark.createDataFrame([("r1", i, t) for i, t in enumerate(texts)], "rep string, sentence_index int, prompt string")
    fan = TE.with_passes(df, 3)
    res = TE.call_with_retry(fan, "prompt", TE.scripted_failures(TE.rule_teacher(fence_every=0)),
                             ["rep", "sentence_index", "pass"], ["rep", "sentence_index"], max_errors=50)
    rows = {(r.sentence_index, r["pass"]): r for r in res.collect()}
    assert all(rows[(0, p)].error and rows[(0, p)].raw_ai_output is None for p in (1, 2, 3))
    assert all(rows[(1, p)].error is None and rows[(1, p)].raw_ai_output for p in (1, 2, 3))
    assert sum(rows[(1, p)].attempts for p in (1, 2, 3)) == 3 + 2  # two transient failures in total
    kept = TE.skip_after_failure(res, ["rep"]).collect()
    assert kept == []  # sentence 0 failed: the rest of the report is skipped
    dl = TE.dead_letter(res, ["rep"]).first()
    assert dl.first_failed_sentence == 0 and dl.failed_calls == 6


def test_tf_cosine_matches_python(spark):
    pairs = [("the cat sat on the mat", "the cat"), ("", "x"), ("Été chaud, été!", "été"), ("a b", "c d")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = {r.k: r.similarity for r in TE.tf_cosine(df, ["k"], "a", "b").collect()}
    per_row = {r.k: r.s for r in df.select("k", TE.tf_cosine_udf("a", "b").alias("s")).collect()}

    def cos(a, b):
        ta = Counter(t for t in re.split(r"[^\w]+", a.lower()) if t)
        tb = Counter(t for t in re.split(r"[^\w]+", b.lower()) if t)
        dot = sum(ta[t] * tb[t] for t in ta)
        na = math.sqrt(sum(v * v for v in ta.values()))
        nb = math.sqrt(sum(v * v for v in tb.values()))
        return dot / (na * nb) if na and nb else 0.0

    for i, (a, b) in enumerate(pairs):
        assert abs(got.get(i, 0.0) - cos(a, b)) < 1e-12
        assert abs(per_row[i] - cos(a, b)) < 1e-12


def test_embedding_confidence(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([2.0, 0.0], [3.0, 0.0])], "a array<double>, b array<double>")
    raw = [r[0] for r in df.select(TE.embedding_confidence("a", "b")).collect()]
    unit = [r[0] for r in df.select(TE.embedding_confidence("a", "b", normalize=True)).collect()]
    assert raw == [0.5, 3.5] and unit == [0.5, 1.0]


def test_label_documents_null_prompt(spark):
    r = spark.createDataFrame([("p", "s1", "f", None), ("p", "s2", "f", "i")],
                              "subject_id string, study_id string, findings string, impression string")
    out = {x.study_id: x for x in TE.label_documents(r, TE.rule_teacher(fence_every=0), "t").collect()}
    assert out["s1"].raw_ai_output is None and out["s1"].label is None
    assert out["s2"].label in TE.DOC_LABELS and out["s2"].model == "t"


def test_embed_text_hashed(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (2, "a b c"), (3, "zzz")], "k int, t string")
    emb = {r.k: r.embedding for r in TE.embed_text(df, "t").collect()}
    assert emb[1] == emb[2]  # newline-flattened text embeds identically
    assert abs(sum(x * x for x in emb[3]) - 1.0) < 1e-12
    assert df.select(F.col("k")).count() == 3


def test_embed_text_without_dedupe(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (2, "a b c")], "k int, t string")
    a = {r.k: r.embedding for r in TE.embed_text(df, "t").collect()}
    b = {r.k: r.embedding for r in TE.embed_text(df, "t", dedupe=False).collect()}
    assert a == b


def test_invalid_replies_are_retried(spark):
    import pandas as pd

    def flaky():
        seen = {}

        def call(prompts):
            out = []
            for p in prompts:
                seen[p] = seen.get(p, 0) + 1
                # first reply has trailing text (json.loads fails), the second is clean
                out.append('{"Result": "No"} extra' if seen[p] == 1 else '{"Result": "No", "Explanation": "e"}')
            return pd.Series(out, index=prompts.index, dtype=object)

        return call

    df = spark.createDataFrame([("r", 0, "p0")], "rep string, sentence_index int, prompt string")
    res = TE.call_with_retry(df, "prompt", flaky, ["rep", "sentence_index"], ["rep", "sentence_index"],
                             validate=TE.strict_json_object).first()
    assert res.attempts == 2 and res.error is None and res.raw_ai_output.endswith('"e"}')


def test_request_batches_are_capped(spark):
    import pandas as pd

    sizes = []

    def counting():
        def call(prompts):
            sizes.append(len(prompts))
            return pd.Series(['{"label": "Normal"}'] * len(prompts), index=prompts.index, dtype=object)

        return call

    df = spark.createDataFrame([(i, f"p{i}") for i in range(25)], "k int, prompt string").coalesce(1)
    out = TE.call_teacher(df, "prompt", counting, ["k"], request_batch=10).collect()
    assert len(out) == 25 and all(r.raw_ai_output for r in out)


def test_wait_and_timeout(spark):
    """A request without an answer in time is a failed call and is sent again after a wait."""

    def slow_once():
        calls = []

        def call(prompts):
            import time

            calls.append(time.time())
            if len(calls) == 1:
                time.sleep(5)
            assert len(calls) < 2 or calls[1] - calls[0] >= 0.9
            return prompts

        return call

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string").coalesce(1)
    rows = TE.call_with_retry(df, "prompt", slow_once, ["k"], ["k"], wait=0.5, timeout=0.5).collect()
    assert sorted((r.k, r.raw_ai_output, r.attempts, r.error) for r in rows) == [(1, "a", 2, None), (2, "b", 2, None)]
