"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming
blocks, then exact weighted-shingle similarity (native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import column_or_null, documents, numbered, stored
from labelforge.llm.shingles import SHINGLE_WORDS, hashes, lookup, once, texts, words

SIMILARITY = 0.8
#: Windows of similarity 0.8 differ in 9.7 of 64 bits on average with a standard
#: deviation of 2.9; the radius leaves more than three of them.
RADIUS = 19
#: Ten blocks: of 19 differing bits some block has one at most.
BLOCKS = 10


def _features(run: str) -> str:
    """SQL for the features of a run of shingle hashes: every occurrence of a
    shingle is one, hashed with its number among the run's occurrences.  Weighted
    Jaccard of the shingles is plain Jaccard of the features, so a repeated
    shingle swings no more bits than another."""
    return f"transform(array(array_sort({run})), s -> transform(s, (x, i) -> xxhash64(x, if(i > 0 AND s[i - 1] = x, i - array_position(s, x) + 1, 0L))))[0]"


def _simhash(rows: DataFrame, wide: bool, *keys: str) -> DataFrame:
    """``keys, fp``: SimHash of the feature hashes ``h`` of each key, a bit being set if
    more than half of the hashes have it.  Several bits are summed at a time in
    lanes of one long: 16 bits wide, or 32 where a window may hold more than
    65,535 shingles."""
    width = 32 if wide else 16
    mask = sum(1 << at for at in range(0, 64, width))
    sums = [F.sum(F.expr(f"shiftrightunsigned(h, {i}) & {mask}L")).alias(f"s{i}") for i in range(width)]
    bits: list[Column] = [F.expr(f"if(2 * (shiftrightunsigned(s{i}, {at}) & {(1 << width) - 1}L) > total, shiftleft(1L, {i + at}), 0L)")
                          for i in range(width) for at in range(0, 64, width)]
    while len(bits) > 1:  # a balanced tree of ORs
        bits = [reduce(lambda a, b: a.bitwiseOR(b), bits[k:k + 2]) for k in range(0, len(bits), 2)]
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *sums).select(*keys, bits[0].alias("fp"))


def block_values(fp: str) -> Column:
    """The blocks of a fingerprint as an array of (block, value, bits)."""
    out, at = [], 0
    for b in range(BLOCKS):
        bits = 64 // BLOCKS + (b < 64 % BLOCKS)
        out.append(F.struct(F.lit(b).alias("block"), F.expr(f"shiftrightunsigned({fp}, {at}) & {(1 << bits) - 1}L").alias("value"), F.lit(bits).alias("bits")))
        at += bits
    return F.array(*out)


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``row, doc_id, item_id, similarity, first_word``: the benchmark items that a
    window of each row repeats, with the best window's similarity and place.

    A window has as many five-word shingles as the item (a shorter document is
    one window).  Similarity is weighted Jaccard over shingles with their counts
    as weights.  A window without any shingle of an item has similarity zero, so
    windows are made only around shared shingles; their fingerprints are looked
    up in the items' Hamming blocks (one wildcard bit each), and every candidate
    is verified exactly.  Texts and items of fewer than five words have no
    shingle and match nothing; NULL counts as empty; repeated rows give repeated results, repeated items one
    each.  An empty table gives an empty result.
    """
    if radius >= 2 * BLOCKS:
        raise ValueError(f"a radius of {radius} bits needs more than {BLOCKS} blocks")
    items = benchmark.select(column_or_null(benchmark, "item_id", "bigint").alias("item_id"), column_or_null(benchmark, "text", "string").alias("text"))
    items = once(once(items, "w", words(F.col("text"))), "hs", hashes("w")).withColumn("m", F.size("hs")).where("m > 0")
    items = stored(spark, items.select(F.monotonically_increasing_id().alias("item"), "item_id", "w", "hs", "m"), "items")
    n_items, longest, n_shingles = items.agg(F.count("*"), F.max("m"), F.sum("m")).first()
    n_items, n_shingles, wide = n_items or 0, n_shingles or 0, (longest or 0) > 65_535

    # places of shared shingles
    base = once(documents(numbered(spark, docs, "doc_id", "text"), "doc_id", "text"), "w", words(F.col("text"))).select("row", "doc_id", "w")
    shared = items.select("m", F.explode("hs").alias("h")).distinct()
    hits = (once(base, "hs", hashes("w")).select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("place", "h"))
            .join(lookup(shared, n_shingles), "h").select("row", "n", "m", "place").distinct())
    hits = stored(spark, hits, "benchmark-hits")
    rows = stored(spark, hits.select("row").distinct(), "benchmark-rows")
    found = stored(spark, base.join(lookup(rows, rows.count()), "row", "left_semi"), "benchmark-documents")

    # windows around them, and their fingerprints
    starts = stored(spark, hits.withColumn("start", F.explode(F.expr("sequence(greatest(0, place - m + 1), least(place, greatest(0, n - m)))")))
                    .select("row", "m", "start").distinct(), "benchmark-windows")
    inside = (starts.groupBy("row").agg(F.collect_list(F.struct("m", "start")).alias("windows"))  # within one document
              .join(once(found, "hs", hashes("w")), "row").select("row", "hs", F.explode("windows").alias("x"))
              .select("row", "x.m", "x.start", F.explode(F.expr(_features("slice(hs, x.start + 1, x.m)"))).alias("h")))
    windows = _simhash(inside, wide, "row", "m", "start")
    prints = _simhash(items.select("item", "m", F.explode(F.expr(_features("hs"))).alias("h")), wide, "item", "m")

    # Hamming blocks: the items' blocks with at most one bit changed
    near = prints.select("item", "m", "fp", F.explode(block_values("fp")).alias("b")).select(
        "item", "m", F.col("fp").alias("item_fp"), "b.block",
        F.explode(F.expr("concat(array(b.value), transform(sequence(0, b.bits - 1), k -> b.value ^ shiftleft(1L, k)))")).alias("value"))
    blocks = windows.select("row", "m", "start", "fp", F.explode(block_values("fp")).alias("b")).select("row", "m", "start", "fp", "b.block", "b.value")
    candidates = (blocks.join(lookup(near, n_items * 74), ["m", "block", "value"])
                  .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
                  .select("row", "m", "start", "item").distinct())
    candidates = stored(spark, candidates, "benchmark-candidates")

    # exact similarity
    parts = (candidates.groupBy("row").agg(F.collect_list(F.struct("item", "m", "start")).alias("windows")).join(found, "row")
             .select("row", "w", F.explode("windows").alias("x"))
             .select("row", "w", "x.item", "x.m", "x.start"))
    parts = once(parts, "part", F.expr(f"slice(w, start + 1, m + {SHINGLE_WORDS - 1})"))
    parts = (once(parts, "shingles", texts("part")).select("row", "item", "start", F.size("shingles").alias("have"), F.explode("shingles").alias("shingle"))
             .groupBy("row", "item", "start", "have", "shingle").agg(F.count("*").alias("k")))
    wanted = items.select("item", "item_id", "m", F.explode(texts("w")).alias("shingle")).groupBy("item", "item_id", "m", "shingle").agg(F.count("*").alias("q"))
    scored = (parts.join(lookup(wanted, n_shingles), ["item", "shingle"]).groupBy("row", "item_id", "item", "start", "have", "m")
              .agg(F.sum(F.least("k", "q")).alias("common"))
              .withColumn("similarity", F.col("common") / (F.col("have") + F.col("m") - F.col("common"))).where(F.col("similarity") >= similarity))
    best = (scored.groupBy("row", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start")).alias("best"))
            .select("row", "item_id", (-F.col("best.less")).alias("similarity"), F.col("best.start").alias("first_word")))
    return best.join(found.select("row", "doc_id"), "row").select("row", "doc_id", "item_id", "similarity", "first_word")
