"""Exact deduplication by deterministic block naming (native).

Every text is cut into fixed-size blocks.  The distinct blocks are sorted and
their rank is their integer name; adjacent names are paired and the distinct
pairs are sorted and named in turn, until each document has one name.  Equal
names at the same level mean equal texts, and different names different texts:
the identity is free of collisions.

The text itself crosses the network once (to find the distinct blocks).  Where
two different blocks share a 64-bit hash, the block text stays part of the key;
everywhere else the hash alone stands for its only block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, stored

BLOCK_CHARS = 4096


def _named(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct keys with their place in sorted order as integer ``name``."""
    return keys.select(*cols).distinct().orderBy(*cols).select(*cols, F.monotonically_increasing_id().alias("name"))


def name_texts(spark: SparkSession, docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row: ``row, doc_id, text_sha256, level, name``.

    Two rows have the same (level, name) exactly if their texts are equal.
    NULL text counts as empty; an empty text is one empty block.  Repeated rows
    and repeated ids are separate rows with the same name.  An empty table
    gives an empty result.  Columns other than doc_id and text are not read.
    """
    base = documents(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = base.select(cut.alias("blocks")).select(F.explode("blocks").alias("block"))
    hashes = stored(spark, blocks.select(F.xxhash64("block").alias("h"), "block").distinct().select("h"), "block-hashes")
    shared = stored(spark, hashes.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("shared")), "shared-hashes")

    placed = (base.select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), cut.alias("blocks"))
              .select("row", "doc_id", "text_sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
              .withColumn("h", F.xxhash64("block"))
              .join(shared, "h", "left"))
    first = stored(spark, placed.select(
        "row", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("pos") == 0, F.col("text_sha256")).alias("text_sha256"),
        "n", "pos", "h", F.when(F.col("shared"), F.col("block")).otherwise("").alias("block")), "blocks")

    state = first.join(_named(first, "h", "block"), ["h", "block"]).select("row", "n", "pos", "name")
    most = first.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    state = stored(spark, state, "names-0")
    while True:
        done.append(state.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        pairs = (state.where("n > 1").groupBy("row", F.floor(F.col("pos") / 2).alias("pos"))
                 .agg(F.max("n").alias("n"),
                      F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
                 .withColumn("n", F.floor((F.col("n") + 1) / 2).cast("int")))
        level, most = level + 1, (most + 1) // 2
        state = stored(spark, pairs.join(_named(pairs, "left", "right"), ["left", "right"]).select("row", "n", "pos", "name"), f"names-{level}")
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    heads = first.where("pos = 0").select("row", "doc_id", "text_sha256")
    return heads.join(names, "row")


def exact_groups(spark: SparkSession, docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row, doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the row with the largest doc_id stays; among rows that
    repeat it, the last one by position.  A NULL id is smaller than any other.
    The group sums are pre-aggregated, so a hot text costs each task one row;
    they are written before the join, which can then split a hot group.
    """
    named = stored(spark, name_texts(spark, docs, block_chars), "identities")
    groups = stored(spark, named.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "row", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256")
