"""Consensus kept up to date by signed batches against full runs."""

import random

import pytest
from pyspark.sql import functions as F

from labelforge.operators import consensus as C
from labelforge.operators import consensus_state as CS
from labelforge.sources import sinks

SCHEMA = "subject_id string, study_id string, label string, model string, confidence double, explanation string"


def votes(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        study = rng.choice(["hot"] * 4 + [f"s{k}" for k in range(40)])
        out.append((None if study == "s3" else "p" + study[-1], study, rng.choice(["Normal", "Abnormal", None]), rng.choice("abcde"),
                    rng.choice([None, *[k / 64 for k in range(64)]]), f"e{rng.randrange(9)}"))
    return out


def full(spark, rows):
    found = C.consensus_labels(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((tuple(r) for r in found), key=str)


def now(store):
    return sorted((tuple(r) for r in store.decisions().select(*C.KEYS, "consensus_label", "consensus_confidence", "winner_model").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_equals_a_full_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = votes(seed=seed)
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    cuts = [rows[k::4] for k in range(4)]
    gone = [r for cut in cuts for r in rng.sample(cut, 20)]
    store = CS.ConsensusStore(spark, f"{tmp_path}/store")
    order = list(range(4))
    rng.shuffle(order)
    for k in order[:2]:
        assert store.apply(f"b{k}", frame(cuts[k]))
    have = [r for k in order[:2] for r in cuts[k]]
    assert now(store) == full(spark, have)
    if seed == 1:
        store.compact()
    assert not store.apply(f"b{order[0]}", frame(cuts[order[0]]))  # already there
    assert store.apply("rest", frame(cuts[order[2]] + cuts[order[3]]), frame(gone))  # new and taken-back votes in one batch
    left = list(rows)
    for r in gone:
        left.remove(r)
    assert now(store) == full(spark, left)
    store.compact()
    assert now(store) == full(spark, left)
    assert store.apply("all", retracted=frame(left)) and now(store) == []


def test_unknown_votes_cannot_be_taken_back(spark, tmp_path):
    store = CS.ConsensusStore(spark, f"{tmp_path}/store")
    assert now(store) == []
    row = ("p", "s", "Normal", "a", 0.5, "e")
    store.apply("one", spark.createDataFrame([row], SCHEMA))
    for wrong in (("p", "s", "Normal", "b", 0.5, "e"), ("p", "s", "Normal", "a", 0.25, "e"), ("p", "s", None, "a", 0.5, "e")):
        with pytest.raises(ValueError):
            store.apply("two", retracted=spark.createDataFrame([wrong], SCHEMA))
    assert now(store) == [("p", "s", "Normal", 0.5, "a")]
    # the failed batch left nothing behind: its name and number are free
    assert store.apply("two", spark.createDataFrame([("p", "s", "Normal", "b", 1.0, "e")], SCHEMA))
    assert now(store) == [("p", "s", "Normal", 0.75, "a")]
    with pytest.raises(ValueError):
        store.apply("three")


def test_a_batch_reads_decides_and_writes_only_what_it_touches(spark, tmp_path):
    store = CS.ConsensusStore(spark, f"{tmp_path}/store")
    store.apply("one", spark.createDataFrame(votes(), SCHEMA))
    store.apply("two", spark.createDataFrame([("p9", "s9", "Normal", "z", 0.5, "e")], SCHEMA))
    assert spark.read.parquet(f"{tmp_path}/store/decisions/seq=2").count() == 1


def test_duplicate_votes(spark):
    rows = [("p", "s", "Normal", "a", 0.5, "x"), ("p", "s", "Abnormal", "a", 0.75, "y"), ("p", "s", None, "b", None, None),
            ("p", "s", None, "b", None, None), ("p", "t", "Normal", "a", 0.5, "x"), (None, None, "Normal", "a", None, "x"), (None, None, "Normal", "a", 0.1, "w")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.study_id, r.model, r.vote_rows, r.labels) for r in CS.duplicate_votes(df).collect()}
    assert got == {("s", "a", 2, 2), ("s", "b", 2, 1), (None, "a", 2, 1)}
    first = {(r.study_id, r.model): (r.label, r.confidence) for r in CS.first_votes(df).collect()}
    assert first == {("s", "a"): ("Abnormal", 0.75), ("s", "b"): (None, None), ("t", "a"): ("Normal", 0.5), (None, "a"): ("Normal", 0.1)}
    assert CS.duplicate_votes(df.limit(0)).collect() == []


def test_a_rewritten_table_is_seen_by_other_sessions(spark, tmp_path):
    sinks.create_table_as(spark.range(3).toDF("x"), "swap_t", 1, f"{tmp_path}/v1")
    sinks.rewrite_with_column(spark, "swap_t", 1, lambda d: d.withColumn("y", F.col("x") * 2), f"{tmp_path}/v2")
    other = spark.newSession()
    assert sorted(r.y for r in other.table("swap_t").collect()) == [0, 2, 4]
    sinks.rewrite_with_column(spark, "swap_t", 2, lambda d: d.withColumn("z", F.lit(1)), f"{tmp_path}/v3")
    assert other.table("swap_t").columns == ["x", "y", "z"]
    for name in ("VIEW swap_t", "TABLE swap_t_v1", "TABLE swap_t_v2", "TABLE swap_t_v3"):
        spark.sql(f"DROP {name}")


def test_winning_votes_join_on_the_label(spark):
    df = spark.createDataFrame(votes(), SCHEMA)
    decided = C.consensus_labels(df)
    got = sorted((tuple(r) for r in C.winning_votes(df, decided).select("study_id", "model", "label", "consensus_label").collect()), key=str)
    want = sorted((tuple(r) for r in df.join(decided, C.KEYS).where("label = consensus_label").select("study_id", "model", "label", "consensus_label").collect()), key=str)
    assert got == want and got
