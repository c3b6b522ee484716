"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.session import scratch_path, ship_package

#: Folders that ``stored`` has written, by application, and nobody has removed.
_WRITTEN: dict[str, list[str]] = {}


@dataclass(frozen=True)
class Numbered:
    """A stored table whose rows have a number, in a column ``row`` that no other column has the name of."""

    frame: DataFrame
    row: str

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.row]


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(spark: SparkSession, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts
    the lineage, and a lost executor costs no recomputation."""
    path = scratch_path(spark, f"llm-{name}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The folders that ``stored`` has written so far in this application."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders that ``stored`` has written and nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    mine = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
        mine.remove(folder)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to ``kind``, or NULL of that type where it is absent."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def numbered(spark: SparkSession, docs: DataFrame | Numbered, *names: str) -> Numbered:
    """``docs`` (the named columns that it has, or all) with a number per row,
    written once: every job that reads the result sees the same numbers.  A
    scan position is no such number, since the splits of a scan depend on the
    cores registered when its job starts.  A numbered table stays as it is."""
    if isinstance(docs, Numbered):
        return docs
    kept = [c for c in docs.columns if c in names or not names]
    row = free_name(kept, "__row")
    return Numbered(stored(spark, docs.select(*(F.col(f"`{c}`") for c in kept), F.monotonically_increasing_id().alias(row)), "numbered"), row)


def documents(docs: DataFrame | Numbered, *names: str) -> DataFrame:
    """``row`` (a number per row) plus the named columns of ``docs`` in their
    usual types; every other column is left behind, so names cannot clash.

    ``row`` is the stored number of a table from ``numbered``; elsewhere it is the
    scan position, which holds within one job and may be used by one job only."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    frame, row = (docs.frame, F.col(docs.row)) if isinstance(docs, Numbered) else (docs, F.monotonically_increasing_id())
    return frame.select(row.alias("row"), *(column_or_null(frame, n, kinds.get(n, "string")).alias(n) for n in names))


def keep_rows(docs: Numbered, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of a numbered table (its columns without the number) whose number
    is in ``rows.row``, or with ``left_anti`` those whose number is not."""
    return docs.frame.join(rows.select(F.col("row").alias(docs.row)), docs.row, how).select(*(F.col(f"`{c}`") for c in docs.columns))


def fold(modulus: int, remainder: int, name: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; false for a NULL id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_sample(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` of the distinct rows, chosen by a 64-bit hash of the whole
    row: the same rows at every run, however many there are and however often an
    id or a row is repeated.  All distinct rows, if there are no more than ``rows``."""
    place = F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns), F.lit(seed)), 1)
    total = df.select(place.alias("place")).distinct().count()
    return (df if total <= rows else df.where(place < sample_bound(rows, total))).distinct()


def sample_bound(rows: int, total: int) -> int:
    """The 63-bit hashes below it are ``rows`` of ``total``; exact, so never zero."""
    return max(1, (rows << 63) // total)


def label_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int,
                 seed: int = 7) -> tuple[DataFrame, int, float]:
    """(doc_id, text, label) of about ``rows`` labelled training documents, the
    number of labelled training rows and the share of label 1 among all of them.

    Only the sampled ids are broadcast: their number is bounded by ``rows``, and
    so is, by a second choice, the number of documents that repeat them."""
    known = (labels.select(column_or_null(labels, "doc_id", "bigint").alias("doc_id"), column_or_null(labels, label, "int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    total, ones = known.agg(F.count("*"), F.sum("label")).first()
    ids = stored(spark, hash_sample(known, rows, seed), "sampled-ids")
    texts = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    return hash_sample(found, max(rows, ids.count()), seed + 1), total, (ones or 0) / max(total, 1)


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the Arrow batches holding about ``max_bytes`` of text each (one
    row at least), so that what a task derives from a slice stays small."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if batch.num_rows > start:
            yield batch.slice(start)


def utf8(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; NULL as empty."""
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]


def ship(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers."""
    ship_package(spark)
