"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked until their marginals meet
the targets; each document is then kept with its cell's calibrated probability.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, ship, small_batches, stored

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
#: Without given targets a value's share is its token share to this power, rescaled: rare values gain, frequent ones lose.
TEMPERATURE = 0.5
#: Share of all tokens to keep.
KEEP = 0.5
TOLERANCE = 1e-3
#: Raking that is not within the tolerance by then fails.
MAX_ROUNDS = 10_000
#: Cells up to which the raking runs on the driver.
LOCAL_CELLS = 100_000
SEED = 17
#: Stands for a NULL source or language, a category of its own.
NONE = "\x00"
_WORD = re.compile(r"[^\W\d_]{4,}")


def topic_of(text: str | None, topics: int = TOPICS) -> str:
    """The word group (by a hash) that most words of four letters or more belong
    to; the first one at a tie, ``none`` without such a word.  It stands in for
    a topic model where the table has no topic column."""
    groups: Counter[int] = Counter()
    for word, k in Counter(_WORD.findall((text or "").lower())).items():
        groups[zlib.crc32(word.encode("utf-8", "surrogatepass")) % topics] += k
    return f"t{min(groups, key=lambda g: (-groups[g], g))}" if groups else "none"


def measured(spark: SparkSession, docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """``row, doc_id, source, lang, topic, n_tokens, u`` for every row: tokens are
    runs without white space, ``u`` is a hash of id and text in [0, 1)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "source", "lang", "u")), pa.array([topic_of(t, topics) for t in texts], pa.string()),
                 pa.array([len((t or "").split()) for t in texts], pa.int64())], names=["row", "doc_id", "source", "lang", "u", "topic", "n_tokens"])

    u = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)).alias("u")
    base = documents(docs, "doc_id", "text", "source", "lang")
    return base.select("row", "doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), "text", u).mapInArrow(
        run, "row bigint, doc_id bigint, source string, lang string, u double, topic string, n_tokens bigint")


def tempered(cells: DataFrame, dimension: str, power: float = TEMPERATURE) -> DataFrame:
    """``value, share``: the token share of each value to a power, rescaled to one."""
    shares = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("n"), F.lit(power)).alias("p"))
    return shares.crossJoin(F.broadcast(shares.agg(F.sum("p").alias("all")))).select("value", (F.col("p") / F.col("all")).alias("share"))


def rake(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Bounded iterative proportional fitting of cells (dimensions, ``n`` tokens)
    to targets (``value, share``) of ``keep`` times all tokens: the cells with
    their ``weight``, the tokens to keep of each, between 0 and n.

    Each dimension is fitted in turn, and no cell may exceed its tokens, until
    no weight changes by more than ``tolerance`` of itself.  Where the targets
    can be met, the marginals then meet them; a value with fewer tokens than its
    target is kept whole.  A value without a target gets nothing; shares are
    rescaled over the values that have tokens.  Weights that still change after
    ``max_rounds`` are an error, no result.  Up to LOCAL_CELLS cells, by
    count, are raked on the driver; more stay in Spark and one number comes back
    each round.  Both ways do the same steps."""
    if cells.count() <= LOCAL_CELLS:
        return _rake_here(spark, cells, targets, keep, tolerance, max_rounds)
    now = cells.where("n > 0").withColumn("weight", F.col("n") * F.lit(float(keep)))
    budget = float(keep) * float(cells.agg(F.sum("n")).first()[0] or 0)
    goals = {}
    for d, target in targets.items():
        present = cells.where("n > 0").select(F.col(d).alias("value")).distinct().join(target, "value", "left").fillna({"share": 0.0})
        whole = present.agg(F.sum("share")).first()[0] or 1.0
        goals[d] = stored(spark, present.select(F.col("value").alias(d), (F.col("share") / F.lit(whole) * F.lit(budget)).alias("goal")), f"target-{d}")
    for _ in range(max_rounds):
        now = now.withColumn("before", F.col("weight"))
        for d, goal in goals.items():
            sums = now.groupBy(d).agg(F.sum("weight").alias("have")).join(goal, d)
            scaled = F.when(F.col("have") > 0, F.col("weight") * F.col("goal") / F.col("have")).otherwise(0.0)
            now = now.join(sums, d).withColumn("weight", F.least(scaled, F.col("n").cast("double"))).drop("have", "goal")
        now = stored(spark, now, "raked")
        change = now.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest("before", F.lit(1e-12)))).first()[0] or 0.0
        now = now.drop("before")
        if change <= tolerance:
            return now
    raise RuntimeError(f"raking still changes a weight by {change:.2g} of itself after {max_rounds} rounds")


def _rake_here(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame], keep: float, tolerance: float, max_rounds: int) -> DataFrame:
    """The same raking of a counted, small number of cells in arrays."""
    rows = cells.where("n > 0").orderBy(*DIMENSIONS).collect()
    tokens = np.array([r.n for r in rows], float)
    weight = tokens * keep
    codes, goals = {}, {}
    for d, target in targets.items():
        values = sorted({r[d] for r in rows})
        share = dict.fromkeys(values, 0.0)
        present = spark.createDataFrame([(v,) for v in values], "value string")
        share |= {r.value: r.share or 0.0 for r in target.join(present, "value", "left_semi").collect()}
        place = {v: i for i, v in enumerate(values)}
        codes[d] = np.array([place[r[d]] for r in rows], np.int64)
        goal = np.array([share[v] for v in values])
        goals[d] = goal / (goal.sum() or 1.0) * keep * tokens.sum()
    change = np.inf if rows else 0.0
    for _ in range(max_rounds):
        if change <= tolerance:
            break
        before = weight
        for d, goal in goals.items():
            have = np.bincount(codes[d], weight, minlength=len(goal))
            weight = np.minimum(weight * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[codes[d]], tokens)
        change = (np.abs(weight - before) / np.maximum(before, 1e-12)).max()
    if change > tolerance:
        raise RuntimeError(f"raking still changes a weight by {change:.2g} of itself after {max_rounds} rounds")
    return spark.createDataFrame([(*(r[d] for d in DIMENSIONS), int(r.n), float(w)) for r, w in zip(rows, weight, strict=True)],
                                 ", ".join(f"{d} string" for d in DIMENSIONS) + ", n bigint, weight double")


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = TEMPERATURE, keep: float = KEEP) -> DataFrame:
    """``row, doc_id, source, lang, topic, n_tokens, probability, kept`` for every row.

    A document is kept if its hash is below its cell's probability, the raked
    weight over the cell's tokens, so the expected tokens of the kept documents
    have the raked marginals.  NULL source and language are
    categories of their own; documents without a token have probability zero;
    repeated rows share their fate; an empty table gives an empty result.
    """
    rows = stored(spark, measured(spark, docs), "measured")
    cells = stored(spark, rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), "cells")
    targets = targets or {d: tempered(cells, d, power) for d in DIMENSIONS}
    raked = rake(spark, cells, targets, keep)
    rates = stored(spark, raked.select(*DIMENSIONS, (F.col("weight") / F.col("n")).alias("probability")), "rates")
    joined = rows.join(rates, list(DIMENSIONS), "left").withColumn("probability", F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0))
    return joined.select("row", "doc_id", F.nullif("source", F.lit(NONE)).alias("source"), F.nullif("lang", F.lit(NONE)).alias("lang"), "topic", "n_tokens",
                         "probability", (F.col("u") < F.col("probability")).alias("kept"))
