"""Sentence splitting and work caps.

All three split modes are array expressions followed by ``posexplode`` — a
narrow, per-row operation with no shuffle; a 20,000-word report explodes in
its own task like any other row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import strip
from labelforge.operators.teacher import running_total


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sentence_array(text: Column | str, mode: str = "period") -> Column:
    """Array of sentences of ``text``.

    * ``period`` — split on ``.``, strip, drop blanks (P10)
    * ``raw``    — split on ``.``, drop the last fragment, keep blanks unstripped (P11)
    * ``punct``  — split on ``[.!?]``, strip, drop blanks (P12)
    """
    t = _c(text)
    if mode == "period":
        parts = F.split(t, r"\.", -1)
        return F.filter(F.transform(parts, strip), lambda s: s != "")
    if mode == "punct":
        parts = F.split(t, r"[.!?]", -1)
        return F.filter(F.transform(parts, strip), lambda s: s != "")
    if mode == "raw":
        parts = F.split(t, r"\.", -1)
        return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    raise ValueError(f"unknown split mode {mode!r}")


def split_sentences(df: DataFrame, text: str, mode: str = "period", keep: list[str] | None = None,
                    index: str = "sentence_index", out: str = "sentence") -> DataFrame:
    """One row per sentence with its 0-based index after filtering.

    NULL text yields no rows (as the reference skips non-strings).
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(sentence_array(text, mode)).alias(index, out))


def count_sentences(text: Column | str, mode: str = "punct") -> Column:
    """P12 (count form): number of non-blank sentences; 0 for NULL."""
    return F.coalesce(F.size(sentence_array(text, mode)), F.lit(0))


def cap_work(df: DataFrame, max_files: int | None = None, max_rows_per_file: int | None = None,
             max_sentences: int | None = None, file_col: str = "parquet_file", row_col: str = "row_index",
             sentence_col: str = "sentence_index") -> DataFrame:
    """The reference's small-run knobs as filters.

    Files are taken in sorted name order: the distinct file names (one row
    per input file) are ordered and limited, then semi-joined back; the
    broadcast side is bounded by ``max_files`` rows.
    """
    out = df
    if max_rows_per_file is not None:
        out = out.where(F.col(row_col) < max_rows_per_file)
    if max_sentences is not None:
        out = out.where(F.col(sentence_col) < max_sentences)
    if max_files is not None:
        first = df.select(file_col).distinct().orderBy(file_col).limit(max_files)
        out = out.join(F.broadcast(first), file_col, "left_semi")
    return out


def preview(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """O3: the first few rows in ``order``: every task keeps ``k`` rows and one
    task merges them.  For slices of thousands of rows use ``first_rows``."""
    return df.orderBy(*order).limit(k)


def first_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows in ``order`` (ascending, NULLs first), exact.

    The keys are counted and ranked by the distributed running total, and the
    rows are joined to the keys that start before rank ``k``; no key reaches
    the driver and no task holds more than its share.  Where equal keys
    straddle rank ``k``, those rows are ranked by their other columns.
    """
    others = [c for c in df.columns if c not in order]
    keys = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(keys, order, "_n", out="_upto")
    wanted = ranked.where(F.col("_upto") - F.col("_n") < k).select(
        *[F.col(c).alias(f"_key_{i}") for i, c in enumerate(order)],
        (F.lit(k) - F.col("_upto") + F.col("_n")).alias("_room"), "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(order)]
    found = df.join(wanted, same, "inner").select(*df.columns, "_room", "_n")
    whole = found.where(F.col("_n") <= F.col("_room")).select(*df.columns)
    cut = running_total(found.where(F.col("_n") > F.col("_room")), [*order, *others], F.lit(1), out="_rank")
    return whole.unionByName(cut.where(F.col("_rank") <= F.col("_room")).select(*df.columns)).orderBy(*order)


def order_reports(reports: DataFrame, keys: list[str]) -> DataFrame:
    """O1: reports in the order of their keys (a range-partitioned sort; equal keys
    in the order of their other columns, so that the order is the same at every run)."""
    return reports.orderBy(*keys, *[c for c in reports.columns if c not in keys])
