"""Writers (S7–S19) and the file-layout writers used to stage report files.

Table writes go through the DataFrame writer (parallel, one file per task,
commit protocol).  The only Python writers are the per-task file writers for
layouts Spark's writers cannot produce (one ``.txt`` per report, zip
archives, JSON-array files); they use ``pyarrow.fs`` so the same code writes
to local disk, HDFS or object storage, each task writes only its own rows,
and file names are derived from the row / partition / batch, so a retried
task overwrites what its failed attempt wrote.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def write_parquet(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Sorted Parquet output (range-partitioned global sort when ``sort_by``)."""
    (df.orderBy(*sort_by) if sort_by else df).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Overwrite a catalog table (schema may change: plain Spark replaces it).

    ``path`` makes it an external table on shared storage."""
    w = df.write.mode("overwrite")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def save_votes_bucketed(df: DataFrame, name: str, buckets: int, path: str | None = None,
                        keys: tuple[str, ...] = ("subject_id", "study_id")) -> None:
    """S8 variant: a vote table bucketed (and sorted) by study.  Read back with
    ``spark.table(name)`` and with
    ``spark.sql.requireAllClusterKeysForCoPartition=false``, consensus plans no
    shuffle at all.  Only for vote sets where no study dominates: a bucket is
    one task, so a hot study is not split (the default shuffle plan is)."""
    w = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def create_table_as(df: DataFrame, name: str, version: int, path: str | None = None) -> str:
    """CTAS of a labelled table as ``name_v{version}``; returns the table name."""
    full = f"{name}_v{version}"
    save_table(df, full, path)
    return full


def rewrite_with_column(spark: SparkSession, name: str, version: int, fn: Callable[[DataFrame], DataFrame],
                        path: str | None = None) -> str:
    """Replace a table by a query over itself.

    Spark refuses to overwrite a table it is reading, so the result goes to
    ``name_v{version+1}`` and the catalog view ``name`` is swapped to it: other
    sessions read the new table from then on, and a reader that has begun keeps the old one."""
    src = spark.table(f"{name}_v{version}")
    new = create_table_as(fn(src), name, version + 1, path)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {new}")
    return new


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """S11."""
    return spark.table(name)


def read_training_set(spark: SparkSession, name: str) -> DataFrame:
    """Labelled rows for training, filter pushed to the scan."""
    return (spark.table(name)
            .where(F.col("findings").isNotNull() & F.col("impression").isNotNull()
                   & F.col("label").isin("Normal", "Abnormal"))
            .select("subject_id", "study_id", "findings", "impression", "label", "confidence"))


def write_vote_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    df.write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append rows (header in every part file; readers skip it)."""
    df.write.mode("append").option("header", True).csv(path)


def overwrite_metrics(df: DataFrame, path: str) -> None:
    """Rewrite, whether or not the table is there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def rewrite_metrics(df: DataFrame, path: str) -> bool:
    """S16, guarded: rewrite only a table that is there; False if it is not."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return False
    overwrite_metrics(df, path)
    return True


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV safe for texts with newlines and quotes (read back with multiLine)."""
    (df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
     .csv(path))


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema(schema).csv(path))


# ------------------------------------------------------- staged file layouts

def write_report_files(df: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """One ``.txt`` per row at ``root/<path>`` (the raw-report layout); returns
    the number of files written.  Each task writes its own rows."""
    root = root.rstrip("/")

    def run(batches):
        fs, base = _fs(root)
        made: set[str] = set()  # folders that this task has made
        for pdf in batches:
            for p, t in zip(pdf[path], pdf[text]):
                full = f"{base}/{p}"
                folder = full.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    if len(made) >= 10_000:
                        made.clear()
                    made.add(folder)
                with fs.open_output_stream(full) as out:
                    out.write((t or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select(path, text).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_zip_archives(df: DataFrame, root: str, member: str = "path", text: str = "text") -> int:
    """Zip archives of rows (one archive per Arrow batch, members named by
    ``member``); returns the number of archives."""
    root = root.rstrip("/")

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        fs, base = _fs(root)
        fs.create_dir(base, recursive=True)
        for i, pdf in enumerate(batches):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                for m, t in zip(pdf[member], pdf[text]):
                    zf.writestr(m, (t or "").encode("utf-8"))
                zf.writestr("README.md", b"not a report")
            # deterministic name: a retried task overwrites its own archive
            with fs.open_output_stream(f"{base}/part-{pid:05d}-{i:05d}.zip") as out:
                out.write(buf.getvalue())
            yield pd.DataFrame({"n": [1]})

    return df.select(member, text).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_json_arrays(df: DataFrame, root: str, add_empty: bool = True) -> int:
    """The reference's vote files: one JSON array per Arrow batch (plus an
    empty ``[]`` file, which is legal); returns the number of files."""
    root = root.rstrip("/")
    # the objects are made by the JVM, the tasks only join them; a cell that is not a number is NULL
    cells = [F.nanvl(F.col(f"`{f.name}`"), F.lit(None)).alias(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f"`{f.name}`")
             for f in df.schema.fields]
    lines = df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("line"))

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        fs, base = _fs(root)
        fs.create_dir(base, recursive=True)
        for i, batch in enumerate(batches):
            with fs.open_output_stream(f"{base}/votes-{pid:05d}-{i:05d}.json") as out:
                out.write(("[" + ",\n".join(batch.column("line").to_pylist()) + "]").encode("utf-8"))
            yield pa.RecordBatch.from_pydict({"n": [1]})

    n = lines.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if add_empty:
        fs, base = _fs(root)
        with fs.open_output_stream(f"{base}/votes-empty.json") as out:
            out.write(b"[]")
        n += 1
    return n
