"""Streaming twin of the restartable labeller.

New report shards dropped into an inbox folder are picked up by the file
source (``maxFilesPerTrigger`` caps a micro-batch like the folder cap of a
run), labelled by any DataFrame function, and written per micro-batch to a
folder named after the batch id — a replayed batch after a failure overwrites
its own folder, so the sink is idempotent.  The checkpoint records which files
are done; ``trigger(availableNow=True)`` drains the inbox and stops, which is
the "resume" behaviour of the batch runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def start_labelling_stream(spark: SparkSession, inbox: str, schema: T.StructType, out: str, checkpoint: str,
                           label: Callable[[DataFrame], DataFrame], files_per_trigger: int = 10,
                           fmt: str = "parquet", processing_time: str | None = None):
    """Start the stream; returns the ``StreamingQuery`` (caller awaits it).

    By default the inbox is drained and the query stops (``availableNow``,
    the batch-run behaviour); ``processing_time="1 minute"`` keeps it running
    and picks up new files as they land."""
    src = (spark.readStream.format(fmt).schema(schema)
           .option("maxFilesPerTrigger", files_per_trigger).load(inbox))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        label(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


def run_to_completion(spark: SparkSession, inbox: str, schema: T.StructType, out: str, checkpoint: str,
                      label: Callable[[DataFrame], DataFrame], files_per_trigger: int = 10) -> DataFrame:
    """Drain the inbox (restartable: rerunning with the same checkpoint only
    processes new files) and return everything written so far."""
    q = start_labelling_stream(spark, inbox, schema, out, checkpoint, label, files_per_trigger)
    q.awaitTermination()
    return spark.read.parquet(out)
