"""Folder statuses of a stream: the batch form's statuses, replays, late files, quiet folders."""

import time

import pytest
from pyspark.sql import functions as F

from labelforge.operators import incremental as I
from labelforge.streaming import folders

SCHEMA = "folder string, name string, outcome string"
ROWS = [("p1", "a", "good"), ("p1", "b", "good"), ("p2", "a", "bad"), ("p2", "b", "good"), ("p3", "a", "bad"), ("p3", "b", "ugly"),
        ("p4", "a", "none"), (None, "a", "good"), ("p5", "a", None)]


@pytest.fixture(autouse=True)
def two_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def label(df):
    """No result row for 'none'; an error for 'bad' and 'ugly'."""
    return (df.where("outcome is null or outcome <> 'none'")
            .withColumn("error", F.when(F.col("outcome").isin("bad", "ugly"), F.concat("outcome", F.lit(" "), "folder"))))


def drop(spark, inbox, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)


def drain(spark, base, quiet=None):
    got = folders.drain(spark, f"{base}/inbox", folders.T._parse_datatype_string(SCHEMA), f"{base}/run", label, "folder", "error", quiet, files_per_trigger=4)
    return {r.unit: (r.rows, r.failed, r.status, r.error) for r in got.collect()}


def test_statuses_equal_the_batch_form(spark, tmp_path):
    for row in ROWS:  # a file each, three micro-batches
        drop(spark, f"{tmp_path}/inbox", [row])
    got = drain(spark, tmp_path)
    assert got[None] == (1, 0, "done", None) and got["p3"] == (2, 2, "failed", "bad p3")
    units = spark.createDataFrame([r for r in ROWS if r[0]], SCHEMA)
    I.resume_labelling(spark, units, "folder", f"{tmp_path}/batch", label, error_col="error")
    done, dead = I.load_state(spark, f"{tmp_path}/batch")
    assert {u: s[2] for u, s in got.items() if u} == {r.unit: r.status for r in done.collect()}
    assert {(r.unit, r.error) for r in folders.dead_letters(spark, f"{tmp_path}/run").collect()} == {(r.unit, r.error) for r in dead.collect()}


def test_state_goes_on_and_a_replayed_batch_counts_once(spark, tmp_path):
    import glob
    import os

    drop(spark, f"{tmp_path}/inbox", ROWS)
    first = drain(spark, tmp_path)
    assert drain(spark, tmp_path) == first  # nothing new
    drop(spark, f"{tmp_path}/inbox", [("p1", "c", "bad"), ("p6", "a", "good")])
    want = first | {"p1": (3, 1, "partial", "bad p1"), "p6": (1, 0, "done", None)}
    assert drain(spark, tmp_path) == want
    for stream in ("labels", "status"):  # the last micro-batch of each was not committed: it runs again
        last = max(glob.glob(f"{tmp_path}/run/checkpoints/{stream}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
        for f in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
            if os.path.exists(f):
                os.remove(f)
    assert drain(spark, tmp_path) == want
    assert spark.read.parquet(f"{tmp_path}/run/results").count() == 10


def test_quiet_folders_are_closed_and_opened_again(spark, tmp_path):
    drop(spark, f"{tmp_path}/inbox", ROWS[:3])
    drain(spark, tmp_path, quiet=1_000)
    closed = lambda: {r.unit for r in folders.statuses(spark, f"{tmp_path}/run").where("closed").collect()}
    assert closed() == set()
    time.sleep(1.5)
    drop(spark, f"{tmp_path}/inbox", [("p9", "a", "good")])
    drain(spark, tmp_path, quiet=60_000)
    assert closed() == {"p1", "p2"}
    drop(spark, f"{tmp_path}/inbox", [("p2", "c", "good")])
    assert drain(spark, tmp_path, quiet=60_000)["p2"] == (2, 1, "partial", "bad p2") and closed() == {"p1"}


def test_empty_inbox(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/inbox")
    assert drain(spark, tmp_path) == {}


@pytest.mark.parametrize("n", [0, 1, 25_000])
def test_partial_counts(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("u"), F.col("id") % 3).alias("unit"), F.lit(1).cast("bigint").alias("row"), F.when(F.col("id") % 2 == 0, "e").alias("error"))
    got = rows.coalesce(1).mapInArrow(folders._added_up, folders.PARTIAL)
    assert got.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))).first()[:] == (n, (n + 1) // 2)
    assert got.count() <= 3 * (n // 10_000 + 1)
