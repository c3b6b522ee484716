"""Restartable, capped labelling runs (X1 batch form, J5, O6, S19).

State lives in Parquet tables under a run root on shared storage:

* ``attempts/run_id=…``    — the units a run has chosen, written before any text is read;
* ``results/run_id=…``     — its labelled rows, each labelled once; ``row_error`` marks the failed ones;
* ``dead_letter``          — one row per (unit, run) with an error, extended by every run;
* ``processed``            — one row per attempted unit with its status, written last.

A unit counts as attempted whatever became of it (the work queue moves past a
failed folder), so failing units never keep later ones from being reached.
Readers join results and dead letters to ``processed``: a run that died half-way
leaves no visible output and its units are simply picked up again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROCESSED_SCHEMA = T.StructType([T.StructField("unit", T.StringType()), T.StructField("status", T.StringType()),
                                 T.StructField("run_id", T.StringType())])
DEAD_SCHEMA = T.StructType([T.StructField("unit", T.StringType()), T.StructField("error", T.StringType()),
                            T.StructField("run_id", T.StringType())])


def cap_folders(df: DataFrame, folder: str, n: int) -> DataFrame:
    """Rows of the first ``n`` folders in name order (distinct → order →
    limit → semi-join; the broadcast side is bounded by ``n`` rows)."""
    first = df.select(folder).distinct().orderBy(folder).limit(n)
    return df.join(F.broadcast(first), folder, "left_semi")


def remaining_work(units: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Units not yet attempted (left anti-join)."""
    return units.join(processed.select(F.col("unit").alias(key)), key, "left_anti")


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # first run: nothing written yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def load_state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """S19 load: ``(processed, dead_letter)`` of committed runs (empty on the first run)."""
    processed = _read_or_empty(spark, f"{root}/processed", PROCESSED_SCHEMA)
    dead = _read_or_empty(spark, f"{root}/dead_letter", DEAD_SCHEMA)
    return processed, dead.join(processed.select("unit", "run_id"), ["unit", "run_id"], "left_semi").select("unit", "error", "run_id")


def save_state(units: DataFrame, root: str, table: str, run_id: str) -> None:
    """S19 save: append this run's units to a state table."""
    units.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{root}/{table}")


def resume_labelling(spark: SparkSession, units: DataFrame, key: str, root: str,
                     label: Callable[[DataFrame], DataFrame], cap: int | None = None,
                     error_col: str | None = None) -> str:
    """X1 (batch): one capped, restartable run.  Returns the run id.

    ``label`` maps the rows of the selected units to result rows that keep
    ``key``; it is evaluated once per run.  With ``error_col``, rows that carry
    an error are dead letters and no results.  Every chosen unit is committed
    with a status: ``done``, ``partial`` (some rows failed), ``failed`` (all
    did) or ``empty`` (the label function returned none).

    Choosing reads only the key column of ``units``; the rows themselves are
    read for the chosen units alone (a table partitioned by ``key`` is pruned
    to their folders).
    """
    run_id = "r" + uuid.uuid4().hex[:12]
    processed, _dead = load_state(spark, root)
    todo = remaining_work(units.select(key).distinct(), processed, key)
    if cap is not None:
        todo = todo.orderBy(key).limit(cap)
    attempts_path, out_path = f"{root}/attempts/run_id={run_id}", f"{root}/results/run_id={run_id}"
    todo.write.mode("overwrite").parquet(attempts_path)
    chosen = spark.read.schema(todo.schema).parquet(attempts_path)

    side = F.broadcast(chosen) if cap is not None else chosen  # a capped run broadcasts at most ``cap`` names
    out = label(units.join(side, key, "left_semi"))
    error = F.col(error_col).cast("string") if error_col else F.lit(None).cast("string")
    kept = [c for c in out.columns if c != error_col]
    out.select(*kept, error.alias("row_error")).write.mode("overwrite").parquet(out_path)

    written = spark.read.parquet(out_path)
    per_unit = written.groupBy(F.col(key).alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), F.count("row_error").alias("bad"), F.min("row_error").alias("error"))
    status = (F.when(F.col("n").isNull(), "empty").when(F.col("bad") == 0, "done")
              .when(F.col("bad") < F.col("n"), "partial").otherwise("failed"))
    save_state(per_unit.where("bad > 0").select("unit", "error"), root, "dead_letter", run_id)
    attempted = chosen.select(F.col(key).alias("unit"))
    save_state(attempted.join(per_unit, "unit", "left").select("unit", status.alias("status")), root, "processed", run_id)
    return run_id


def committed_results(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Good rows of committed runs only (results ⋉ processed on unit and run id)."""
    # a run that died, or an older one, may have left files of another layout
    res = spark.read.option("mergeSchema", True).parquet(f"{root}/results").where(F.col("row_error").isNull()).drop("row_error")
    processed, _ = load_state(spark, root)
    ok = processed.select(F.col("unit").alias(key), "run_id")
    return res.join(ok, [key, "run_id"], "left_semi").drop("run_id")
