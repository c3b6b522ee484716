"""Calls in report order, stops and the shared budget."""

import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelforge.operators import calls as CA
from labelforge.operators import teacher as TE

KEEP = ["rep", "sentence_index", "pass"]


def counting_teacher(log, fail=(), flaky=()):
    """Writes every prompt that it sees to a file of its own; some fail always, some the first time."""

    def make():
        seen = set()

        def call(prompts):
            out = []
            with open(f"{log}/{os.getpid()}", "a") as f:
                for p in prompts:
                    f.write(f"{p}\n")
                    if p in fail:
                        out.append(RuntimeError("broken"))
                    elif p in flaky and p not in seen:
                        seen.add(p)
                        out.append(TimeoutError("late"))
                    else:
                        out.append(json.dumps({"Result": p}))
            return pd.Series(out, index=prompts.index, dtype=object)

        return call

    return make


def asked(log):
    return sorted(line.strip() for f in os.listdir(log) for line in open(f"{log}/{f}"))


def plan(spark, reports=20, sentences=6, passes=3):
    rows = [(f"r{r}", s, p, f"{r}/{s}/{p}") for r in range(reports) for s in range(sentences) for p in range(1, passes + 1)]
    return spark.createDataFrame(rows, "rep string, sentence_index int, pass int, prompt string").repartition(5)


@pytest.mark.parametrize("open_reports,read_ahead", [(1, 1), (3, 4), (256, 10_000)])
def test_no_call_after_a_dead_sentence(spark, open_reports, read_ahead):
    log = tempfile.mkdtemp(prefix="lf-calls-")
    fail, flaky = {"3/2/2", "7/0/1", "7/4/1"}, {"5/1/1", "6/5/3"}
    made = CA.ordered_calls(plan(spark), "prompt", counting_teacher(log, fail, flaky), KEEP, ["rep"], max_errors=2, tasks=3,
                            open_reports=open_reports, read_ahead=read_ahead, request_batch=7)
    rows = {(r.rep, r.sentence_index, r["pass"]): r for r in made.collect()}
    every = [(r, s, p) for r in range(20) for s in range(6) for p in (1, 2, 3)]
    before = {"3": (2, 2), "7": (0, 1)}
    called = [f"{r}/{s}/{p}" for r, s, p in every if (s, p) <= before.get(str(r), (99, 9))]
    # a dead call is tried three times, a flaky one twice, nothing after a dead one at all
    assert asked(log) == sorted(called + ["3/2/2"] * 2 + ["7/0/1"] * 2 + ["5/1/1", "6/5/3"])
    kept = {(f"r{r}", s, p) for r, s, p in every if s <= before.get(str(r), (99,))[0]}
    assert set(rows) == kept
    dead = {k for k, r in rows.items() if r.error}
    assert dead == {("r3", 2, p) for p in (1, 2, 3)} | {("r7", 0, p) for p in (1, 2, 3)}
    assert all(rows[k].raw_ai_output is None and rows[k].error == "RuntimeError: broken" for k in dead)
    assert {p: rows["r3", 2, p].attempts for p in (1, 2, 3)} == {1: 1, 2: 3, 3: 0}
    assert rows["r5", 1, 1].attempts == 2 and rows["r5", 1, 1].calls == 4 and rows["r5", 1, 2].calls == 3
    assert sum(r.attempts for r in rows.values()) == len(asked(log))


def test_same_rows_as_calls_in_any_order(spark):
    """What is kept equals the older form, which makes all calls and drops what follows a failure."""
    teacher = TE.scripted_failures(TE.rule_teacher(fence_every=0))
    df = plan(spark).withColumn("prompt", F.repeat(F.lit("a"), F.pmod(F.xxhash64("rep", "sentence_index"), F.lit(40)).cast("int") + 1))
    new = CA.ordered_calls(df, "prompt", teacher, KEEP, ["rep"], max_errors=5)
    old = TE.call_with_retry(df.orderBy(*KEEP).coalesce(1), "prompt", teacher, KEEP, KEEP[:2], max_errors=50)
    rows = lambda d: sorted((r.rep, r.sentence_index, r["pass"], r.raw_ai_output) for r in TE.skip_after_failure(d, ["rep"]).collect())
    assert rows(new) == rows(old) and len(rows(new)) > 0
    letters = {r.rep: r.first_failed_sentence for r in TE.dead_letter(old, ["rep"]).collect()}
    assert {r.rep: r.first_failed_sentence for r in TE.dead_letter(new, ["rep"]).collect()} == letters


@pytest.mark.parametrize("budget", [0, 2, 3, 100, 101, 10_000])
def test_shared_budget_is_never_exceeded(spark, budget):
    log = tempfile.mkdtemp(prefix="lf-calls-")
    made = CA.ordered_calls(plan(spark), "prompt", counting_teacher(log), KEEP, ["rep"], budget=budget, tasks=4, open_reports=5, lease=40)
    rows = made.collect()
    assert len(rows) == min(360, budget // 3) == len(asked(log))
    assert sum(r.calls for r in rows) <= budget and all(r.raw_ai_output and r.calls == 3 for r in rows)
    # in each report a prefix of its calls
    for rep in {r.rep for r in rows}:
        mine = sorted((r.sentence_index, r["pass"]) for r in rows if r.rep == rep)
        assert mine == [(s, p) for s in range(6) for p in (1, 2, 3)][:len(mine)]


def test_failed_tries_are_paid(spark):
    log = tempfile.mkdtemp(prefix="lf-calls-")
    fail = {f"{r}/1/1" for r in range(10)}
    made = CA.ordered_calls(plan(spark, 10), "prompt", counting_teacher(log, fail), KEEP, ["rep"], max_errors=3, budget=100, tasks=4)
    rows = made.collect()
    paid = sum(r.calls for r in rows)
    assert len(asked(log)) + 2 * sum(r.raw_ai_output is not None for r in rows) <= 100
    assert paid <= 100 and max(r.sentence_index for r in rows) <= 1


def test_fair_shares():
    assert CA.fair_shares([5, 0, 1], 4) == [3, 0, 1]
    assert CA.fair_shares([2, 2], 100) == [2, 2]
    assert CA.fair_shares([9, 9, 9], 2) == [1, 1, 0]
    assert CA.fair_shares([], 5) == [] and CA.fair_shares([3], 0) == [0]


def test_ledger_counts_lost_attempts(tmp_path):
    lost = CA._Ledger(str(tmp_path), "11")
    lost.note(6)
    lost.note(9)
    CA._Ledger(str(tmp_path), "12").note(4)
    mine = CA._Ledger(str(tmp_path), "13")
    mine.note(100)
    assert mine.others({"13"}) == 13 and mine.others({"12", "13"}) == 9


def test_empty_plan(spark):
    empty = plan(spark).limit(0)
    log = tempfile.mkdtemp(prefix="lf-calls-")
    assert CA.ordered_calls(empty, "prompt", counting_teacher(log), KEEP, ["rep"]).collect() == []
    assert CA.ordered_calls(empty, "prompt", counting_teacher(log), KEEP, ["rep"], budget=10, tasks=2).collect() == []
