"""Native word shingles shared by the licence scan and the decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Rows up to which a lookup table is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; NULL has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a further column that is evaluated once per row:
    an optimizer that merged it into a later lambda would evaluate it per element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def hashes(name: str, width: int = SHINGLE_WORDS) -> Column:
    """xxhash64 of every run of ``width`` words of array column ``name``, by place."""
    parts = ", ".join(f"{name}[i + {j}]" for j in range(width))
    return F.expr(f"if(size({name}) < {width}, cast(array() as array<bigint>), transform(sequence(0, size({name}) - {width}), i -> xxhash64({parts})))")


def texts(name: str, width: int = SHINGLE_WORDS) -> Column:
    """The runs of ``width`` words of array column ``name`` as strings, by place."""
    return F.expr(f"if(size({name}) < {width}, cast(array() as array<string>), transform(sequence(0, size({name}) - {width}), i -> array_join(slice({name}, i + 1, {width}), ' ')))")


def lookup(table: DataFrame, rows: int) -> DataFrame:
    """``table`` with a broadcast hint if its counted ``rows`` are within the bound."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
