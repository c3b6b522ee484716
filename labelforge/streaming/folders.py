"""Folder status of a labelling stream (X1): keyed state per folder.

Two streams.  ``start_labels`` labels the files of an inbox and appends the rows
to a table by the streaming file sink, which shows a replayed micro-batch once.
``start_status`` reads that table and the inbox's folder names and keeps for each
folder the rows seen, the failed ones and the least error in ``transformWithState``;
it emits a status whenever one changes, and closes a folder that has been quiet for
a time.  Status rows of a micro-batch go to a folder named after its number, which
a replay overwrites.

Rows are added up in their task before they are shuffled, so a folder that holds a
third of all rows sends a row per Arrow batch, and its state is four numbers long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelforge.session import ship_package

STATUS = "unit string, rows bigint, failed bigint, status string, error string, closed boolean"
PARTIAL = "unit string, rows bigint, failed bigint, error string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``unit, row, error`` added up by unit within an Arrow batch."""
    for batch in batches:
        counts = pa.Table.from_batches([batch]).group_by("unit").aggregate([("row", "sum"), ("error", "count"), ("error", "min")])
        for part in counts.select(["unit", "row_sum", "error_count", "error_min"]).rename_columns(["unit", "rows", "failed", "error"]).to_batches():
            yield part


class FolderStatus(StatefulProcessor):
    """Adds up the partial counts of a folder; ``quiet`` milliseconds without news close it."""

    def __init__(self, quiet: int | None):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows bigint, failed bigint, error string, closed boolean")

    def _status(self, unit: str | None, state: tuple) -> pd.DataFrame:
        rows, failed, error, closed = state
        status = "empty" if not rows else "done" if not failed else "partial" if failed < rows else "failed"
        return pd.DataFrame({"unit": [unit], "rows": [rows], "failed": [failed], "status": [status], "error": [error], "closed": [closed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, failed, error, _ = self.seen.get() if self.seen.exists() else (0, 0, None, False)
        for part in rows:
            total, failed = total + int(part["rows"].sum()), failed + int(part["failed"].sum())
            error = min([e for e in part["error"] if isinstance(e, str)] + ([error] if error is not None else []), default=None)
        state = (total, failed, error, False)
        self.seen.update(state)
        if self.quiet is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield self._status(key[0], state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = (*self.seen.get()[:3], True)
        self.seen.update(state)
        yield self._status(key[0], state)

    def close(self) -> None:
        pass


def _inbox(spark: SparkSession, inbox: str, schema: T.StructType, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(inbox)


def _start(writer, processing_time: str | None):
    return (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()


def start_labels(spark: SparkSession, inbox: str, schema: T.StructType, root: str, label: Callable[[DataFrame], DataFrame],
                 files_per_trigger: int = 10, processing_time: str | None = None):
    """Label the inbox into ``root/results``.  ``label`` maps a streaming DataFrame
    row by row (any number of result rows) and keeps the folder column and the
    error; each row of a committed micro-batch is labelled once."""
    out = label(_inbox(spark, inbox, schema, files_per_trigger))
    return _start(out.writeStream.format("parquet").option("path", f"{root}/results").option("checkpointLocation", f"{root}/checkpoints/labels"), processing_time)


def start_status(spark: SparkSession, inbox: str, schema: T.StructType, results: T.StructType, root: str, key: str, error_col: str,
                 quiet_ms: int | None = None, files_per_trigger: int = 10, processing_time: str | None = None):
    """Follow ``root/results`` (of schema ``results``) into ``root/status``.

    The inbox is read for its folder column alone, so that a folder whose rows
    yield no result has a status too.  A folder that gets news after it was closed is
    open again; a NULL folder is a folder of its own.  The stream's state store is
    RocksDB, which ``transformWithState`` needs.

    A stream that drains the inbox runs no micro-batch without news (it would never
    end), so it closes quiet folders with the next news; one that keeps running
    (``processing_time``) closes them when their time is over."""
    ship_package(spark)
    labelled = spark.readStream.schema(results).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/results")
    news = labelled.select(F.col(key).cast("string").alias("unit"), F.lit(1).cast("bigint").alias("row"), F.col(error_col).cast("string").alias("error"))
    there = _inbox(spark, inbox, schema, files_per_trigger).select(F.col(key).cast("string").alias("unit"), F.lit(0).cast("bigint").alias("row"), F.lit(None).cast("string").alias("error"))
    status = (news.unionByName(there).mapInArrow(_added_up, PARTIAL).groupBy("unit")
              .transformWithStateInPandas(FolderStatus(quiet_ms), STATUS, "Update", "None" if quiet_ms is None else "ProcessingTime"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/status/batch_id={number}")

    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(processing_time is not None).lower()}
    before = {name: spark.conf.get(name) for name in settings}  # a started stream has its own copy of the settings
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return _start(status.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoints/status"), processing_time)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def statuses(spark: SparkSession, root: str) -> DataFrame:
    """The latest status of every folder seen (columns of ``STATUS``)."""
    log = spark.read.schema(STATUS + ", batch_id bigint").parquet(f"{root}/status")
    names = [f.name for f in T._parse_datatype_string(STATUS).fields if f.name != "unit"]
    last = log.groupBy("unit").agg(F.max_by(F.struct(*names), F.struct("batch_id", "rows", "closed")).alias("s"))
    return last.select("unit", *(F.col(f"s.{n}").alias(n) for n in names))


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """``unit, error`` of the folders with a failed row."""
    return statuses(spark, root).where("failed > 0").select("unit", "error")


def drain(spark: SparkSession, inbox: str, schema: T.StructType, root: str, label: Callable[[DataFrame], DataFrame], key: str,
          error_col: str, quiet_ms: int | None = None, files_per_trigger: int = 10) -> DataFrame:
    """Run both streams over what is in the inbox (again: over what is new) and
    return the statuses.  Labelled rows are in ``root/results``."""
    start_labels(spark, inbox, schema, root, label, files_per_trigger).awaitTermination()
    results = label(spark.createDataFrame([], schema)).schema
    start_status(spark, inbox, schema, results, root, key, error_col, quiet_ms, files_per_trigger).awaitTermination()
    return statuses(spark, root)
