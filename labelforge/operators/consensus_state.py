"""C1 kept up to date: consensus decisions maintained by signed batches of votes.

A store in a shared folder holds, for each (study, label, model), how many votes
there are and the exact sum of their confidences, as signed deltas of the batches
that brought new teachers or took votes back.  A batch decides anew only the
studies that it touches.  All sums are decimals, so the state does not depend on
the order of the batches, and the first model of a label is the least one that
still has votes, so a retracted vote leaves no trace.

``deltas/seq=…`` and ``decisions/seq=…`` belong to a batch and count once
``commits/seq=…`` exists, which is written last; ``base/seq=…`` sums up everything
to its number.  A batch that died half-way is invisible and is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.operators.consensus import KEYS, _decide
from labelforge.operators.incremental import _read_or_empty

#: A confidence in the store: 15 places after the point.
SCORE = "decimal(38,15)"


class ConsensusStore:
    """The store in ``root``, a folder that the driver and all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str] = KEYS):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        names = [T.StructField(k, T.StringType()) for k in self.keys]
        self.counts = T.StructType([*names, T.StructField("label", T.StringType()), T.StructField("model", T.StringType()),
                                    T.StructField("n", T.LongType()), T.StructField("score", T.DecimalType(38, 15)),
                                    T.StructField("scored", T.LongType()), T.StructField("seq", T.IntegerType())])
        self.decided = T.StructType([*names, T.StructField("consensus_label", T.StringType()), T.StructField("consensus_confidence", T.DoubleType()),
                                     T.StructField("winner_model", T.StringType()), T.StructField("seq", T.IntegerType())])
        self.commits = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("seq", T.IntegerType())])

    def _committed(self) -> dict[str, tuple[int, bool]]:
        """batch → (number, whether it is a base); one row per batch."""
        rows = _read_or_empty(self.spark, f"{self.root}/commits", self.commits).collect()
        return {r.batch_id: (r.seq, r.base) for r in rows}

    def _visible(self, table: str, schema: T.StructType, commits: dict[str, tuple[int, bool]]) -> DataFrame:
        """The rows of ``table`` from the last base on, by folder."""
        first = max((seq for seq, base in commits.values() if base), default=0)
        seqs = [seq for seq, _ in commits.values() if seq >= first]
        if not seqs:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{table}/seq={seq}" for seq in seqs]
        return self.spark.read.option("basePath", f"{self.root}/{table}").schema(schema).parquet(*paths)

    def _deltas(self, votes: DataFrame, sign: int) -> DataFrame:
        score = F.col("confidence").cast(SCORE)
        return votes.groupBy(*self.keys, "label", "model").agg(
            (F.count("*") * sign).alias("n"), (F.coalesce(F.sum(score), F.lit(0)) * sign).cast(SCORE).alias("score"), (F.count("confidence") * sign).alias("scored"))

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys, "label", "model").agg(
            F.sum("n").alias("n"), F.sum("score").cast(SCORE).alias("score"), F.sum("scored").alias("scored"))

    def _decisions(self, state: DataFrame) -> DataFrame:
        """The consensus of every study of ``state`` (its votes summed), as C1 decides."""
        per_label = state.where("n > 0").groupBy(*self.keys, "label").agg(
            F.sum("n").alias("n"), F.try_divide(F.sum("score").cast("double"), F.sum("scored")).alias("c"), F.min("model").alias("first_model"))
        return _decide(per_label, self.keys, "label", ["first_model"]).select(
            *self.keys, F.col("top.lbl").alias("consensus_label"), F.col("top.c").alias("consensus_confidence"), F.col("top.first_model").alias("winner_model"))

    def apply(self, batch_id: str, added: DataFrame | None = None, retracted: DataFrame | None = None) -> bool:
        """Applies a batch of new and taken-back votes (``keys, label, model,
        confidence``; text columns are not read); false if it is already applied.

        A retracted vote must be there, with its label, model and confidence: if a
        count would fall below zero, nothing is applied and that is an error.
        NULL labels are votes of their own, NULL confidences count without a score,
        repeated votes count each, as in C1."""
        commits = self._committed()
        if batch_id in commits:
            return False
        seq = max((s for s, _ in commits.values()), default=0) + 1
        parts = [self._deltas(df, sign) for df, sign in ((added, 1), (retracted, -1)) if df is not None]
        if not parts:
            raise ValueError("a batch adds or retracts votes")
        delta = self._summed(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).where("n <> 0 OR score <> 0 OR scored <> 0")
        path = f"{self.root}/deltas/seq={seq}"
        delta.write.mode("overwrite").parquet(path)
        delta = self.spark.read.schema(delta.schema).parquet(path)
        touched = delta.select(*self.keys).distinct()
        before = self._visible("deltas", self.counts, commits).drop("seq")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in self.keys]
        old = before.alias("o").join(touched.alias("t"), same, "left_semi")
        state = self._summed(old.unionByName(delta))
        short = state.where("n < 0 OR scored < 0 OR (n = 0 AND score <> 0)").count()
        if short:
            raise ValueError(f"{short} retracted votes of batch {batch_id} are not in the store")
        now = self._decisions(state)
        keyed = touched.alias("t").join(now.alias("o"), same, "left").select(*[F.col(f"t.{k}").alias(k) for k in self.keys], "consensus_label", "consensus_confidence", "winner_model")
        keyed.write.mode("overwrite").parquet(f"{self.root}/decisions/seq={seq}")
        self._commit(batch_id, seq, False)
        return True

    def _commit(self, batch_id: str, seq: int, base: bool) -> None:
        self.spark.createDataFrame([(batch_id, base)], "batch_id string, base boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/seq={seq}")

    def decisions(self) -> DataFrame:
        """``keys, consensus_label, consensus_confidence, winner_model`` of every study with a consensus now."""
        rows = self._visible("decisions", self.decided, self._committed())
        last = rows.groupBy(*self.keys).agg(F.max(F.struct("seq", "consensus_label", "consensus_confidence", "winner_model")).alias("d"))
        return last.where("d.consensus_label IS NOT NULL").select(*self.keys, "d.consensus_label", "d.consensus_confidence", "d.winner_model")

    def compact(self) -> int:
        """Sums up all batches in one base, which readers start from; its number."""
        commits = self._committed()
        seq = max((s for s, _ in commits.values()), default=0) + 1
        self._summed(self._visible("deltas", self.counts, commits)).where("n <> 0").write.mode("overwrite").parquet(f"{self.root}/deltas/seq={seq}")
        self.decisions().write.mode("overwrite").parquet(f"{self.root}/decisions/seq={seq}")
        self._commit(f"base-{seq}", seq, True)
        return seq


def duplicate_votes(votes: DataFrame, keys: list[str] = KEYS, model: str = "model") -> DataFrame:
    """C1 audit (D6): the studies with more than one vote row of a teacher, how
    many rows and how many distinct labels they have.  Such rows count as votes each."""
    return (votes.groupBy(*keys, model).agg(F.count("*").alias("vote_rows"), F.count_distinct(F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))).alias("labels"))
            .where("vote_rows > 1"))


def first_votes(votes: DataFrame, keys: list[str] = KEYS, model: str = "model") -> DataFrame:
    """One vote row per study and teacher: the one with the highest confidence
    (NULL last), then by label and explanation.  The alternative to counting repeats."""
    order = Window.partitionBy(*keys, model).orderBy(F.desc_nulls_last("confidence"), F.asc_nulls_last("label"), F.asc_nulls_last("explanation"))
    return votes.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
