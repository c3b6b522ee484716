"""Teacher-vote consensus.

Rule (document level, C1): per study, the votes of all teachers are grouped by
label.  One distinct label (NULL counts as a label) → keep it, confidence is
the mean of its non-NULL scores.  Two labels → keep the majority label iff it
has strictly more votes *and* a strictly higher mean confidence than the
minority (a NULL mean makes the comparison unknown → drop).  Three or more
labels, ties, and a winning NULL label → drop.  Explanation and report text
come from the winning label's vote of the first teacher by name.

Plan shape: two partial+final aggregations over narrow rows (key, label,
model, confidence), then one join of the votes to the decision for the
winner's text and a final deduplication of the winners.  Partial aggregation
collapses a hot study before the narrow shuffles, the long text crosses the
network once, and no group is ever collected into a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["subject_id", "study_id"]


def union_votes(tables: list[DataFrame], models: list[str] | None = None) -> DataFrame:
    """Stack N >= 1 teacher tables by column name, tagging each with ``model``."""
    if not tables:
        raise ValueError("need at least one vote table")
    if models is not None:
        if len(models) != len(tables):
            raise ValueError("one model name per table")
        tables = [t.withColumn("model", F.lit(m)) for t, m in zip(tables, models)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def label_stats(votes: DataFrame, keys: list[str] = KEYS, label: str = "label",
                score: str = "confidence") -> DataFrame:
    """A1: per (key, label) the vote count and mean score (NULL label is its own group)."""
    return votes.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("label_count"),
        F.avg(score).alias("avg_conf"),
    )


def study_stats(stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A2: number of distinct labels per study, NULL included (count of A1 groups)."""
    return stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_labels"))


def with_study_stats(stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Label stats with their study's ``num_labels``: a count over the study
    instead of a join, so the stats are shuffled once (one row per label of a
    study, whatever its number of votes)."""
    from pyspark.sql import Window

    return stats.withColumn("num_labels", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _decide(per_label: DataFrame, keys: list[str], label: str, extra: list[str]) -> DataFrame:
    """Second aggregation + the keep rule over one row per (key, label)."""
    packed = F.struct(F.col("n"), F.col("c"), F.col(label).alias("lbl"), *[F.col(e) for e in extra])
    per_key = per_label.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.max(packed).alias("top"),
        # the loser's extras are never read: with texts among them they would double the shuffle
        F.min(F.struct("n", "c", F.col(label).alias("lbl"))).alias("bot"),
    )
    keep = F.col("top.lbl").isNotNull() & (
        (F.col("k") == 1)
        | ((F.col("k") == 2) & (F.col("top.n") > F.col("bot.n")) & (F.col("top.c") > F.col("bot.c")))
    )
    return per_key.where(keep)


def consensus_labels(votes: DataFrame, keys: list[str] = KEYS, label: str = "label",
                     score: str = "confidence", model: str = "model",
                     ignore_failed_votes: bool = False, kind: str | None = None) -> DataFrame:
    """Winning (label, confidence, first model) per study — narrow columns only.
    ``kind`` keeps the ``agreed`` studies (one label) or the ``majority`` ones (two).

    One plan at every size: votes are read once, and no job runs while it is
    built.  ``ignore_failed_votes=True`` drops NULL-label votes before counting
    (D4 alternative); the default keeps the reference behaviour."""
    v = votes.select(*keys, label, score, model)
    if ignore_failed_votes:
        v = v.where(F.col(label).isNotNull())
    per_label = v.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("c"),
        F.min(model).alias("first_model"),
    )
    decided = _decide(per_label, keys, label, ["first_model"])
    if kind:
        decided = decided.where(F.col("k") == {"agreed": 1, "majority": 2}[kind])
    return decided.select(
        *keys,
        F.col("top.lbl").alias("consensus_label"),
        F.col("top.c").alias("consensus_confidence"),
        F.col("top.first_model").alias("winner_model"),
    )


def union_decisions(parts: list[DataFrame]) -> DataFrame:
    """Decision tables of disjoint studies (agreed and majority ones, or those
    of several corpora) as one, by column name."""
    if not parts:
        raise ValueError("need at least one decision table")
    return reduce(DataFrame.unionByName, parts)


def consensus(votes: DataFrame, keys: list[str] = KEYS, text_cols: tuple[str, ...] = ("findings", "impression"),
              ignore_failed_votes: bool = False) -> DataFrame:
    """Consensus table ``keys + text_cols + label, explanation, confidence``.

    The decision is made on narrow rows (two partial+final aggregations over
    ``key, label, model, confidence`` — the Parquet scan reads only those
    columns).  The votes are then joined to the decision on
    ``(key, label, model)``: the long text crosses the network once and only
    the winning rows (about one per kept study) reach the final
    deduplication, which picks one row deterministically when a study has
    duplicated vote rows (rule D6).  A study holding a third of all votes is
    split by AQE's skew-join handling (the decision side is one row per
    study) and collapsed by the partial aggregation before the last shuffle.
    """
    decided = consensus_labels(votes, keys, ignore_failed_votes=ignore_failed_votes).select(
        *keys, F.col("consensus_label").alias("label"), F.col("winner_model").alias("model"),
        F.col("consensus_confidence").alias("confidence"))
    v = votes.select(*keys, "label", "model", "explanation", *text_cols)
    # join strategy left to AQE: a broadcast while the decision is small,
    # else a shuffled hash join built on the narrow decision when the session
    # sets spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold (the text
    # is then streamed, not sorted)
    winners = v.join(decided, [*keys, "label", "model"], "inner")
    pick = F.min(F.struct(F.col("explanation"), *[F.col(c) for c in text_cols])).alias("w")
    out = winners.groupBy(*keys).agg(F.first("label").alias("label"), F.first("confidence").alias("confidence"), pick)
    return out.select(*keys, *[F.col(f"w.{c}").alias(c) for c in text_cols], "label",
                      F.col("w.explanation").alias("explanation"), "confidence")


def consensus_with_text(votes: DataFrame, keys: list[str] = KEYS,
                        text_cols: tuple[str, ...] = ("findings", "impression")) -> DataFrame:
    """C1, two-exchange variant: the winner's text rides in the aggregation
    buffers (better when texts are short; text crosses the network twice)."""
    # a NULL label never wins: its votes count, their text stays behind
    w = F.min(F.when(F.col("label").isNotNull(), F.struct(F.col("model"), F.col("explanation"), *[F.col(c) for c in text_cols]))).alias("w")
    per_label = votes.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), w)
    decided = _decide(per_label, keys, "label", ["w"])
    return decided.select(*keys, *[F.col(f"top.w.{c}").alias(c) for c in text_cols],
                          F.col("top.lbl").alias("label"), F.col("top.w.explanation").alias("explanation"),
                          F.col("top.c").alias("confidence"))


def winning_votes(votes: DataFrame, decided: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The votes for their study's consensus label, with the decision; the
    label is a join key, so other votes never leave the join."""
    d = decided.select(*keys, F.col("consensus_label").alias("label"), "consensus_label", "consensus_confidence")
    return votes.join(d, [*keys, "label"])


def rank_labels(stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``row_number`` of labels per study by count desc (tie-break: mean
    confidence desc, then label) — the reference leaves ties arbitrary."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("label_count"), F.desc_nulls_last("avg_conf"),
                                          F.asc_nulls_last("label"))
    return stats.withColumn("rank", F.row_number().over(w))


def pick_winner(rows: DataFrame, keys: list[str] = KEYS, order: str = "model") -> DataFrame:
    """The first row per study by ``order`` (ties broken by the other columns).

    A ``min(struct(order, ...))`` aggregation rather than a ``row_number``
    window: partial aggregation keeps one row per study per task, so a study
    holding a third of all rows never lands in one task."""
    others = [c for c in rows.columns if c not in keys and c != order]
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in others])).alias("_w")
    out = rows.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in [order, *others]]).select(*rows.columns)


def majority_join(stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """J1 + J2: majority and minority of the two-label studies side by side, where
    the majority has more votes and the higher mean.  Both are picked by one
    aggregation; a tie in the counts, the only case where the pick would need
    a further order, fails the condition."""
    packed = F.struct(F.col("label_count").alias("n"), F.col("avg_conf").alias("c"), F.col("label").alias("lbl"))
    per_key = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max(packed).alias("top"), F.min(packed).alias("bot"))
    return (per_key.where("k = 2 AND top.n > bot.n AND top.c > bot.c")
            .select(*keys, F.col("top.lbl").alias("consensus_label"), F.col("top.n").alias("majority_count"),
                    F.col("top.c").alias("majority_conf"), F.col("bot.n").alias("minority_count"),
                    F.col("bot.c").alias("minority_conf")))


# ---------------------------------------------------------------- sentence level

SENTENCE_KEYS = ["parquet_file", "row_index", "sentence_index"]


def align_passes(votes: DataFrame, keys: list[str] = SENTENCE_KEYS, pass_col: str = "pass",
                 n_passes: int = 3) -> DataFrame:
    """One row per sentence key with the per-pass votes side by side.

    Votes are matched by key, never by position: a missing pass is a NULL
    slot.  Built as one conditional aggregation (partial agg before the
    shuffle), which is the full-outer join of the pass tables on the key.
    """
    aggs = []
    for p in range(1, n_passes + 1):
        this = F.col(pass_col) == p
        aggs += [
            F.max(F.when(this, F.col("Result"))).alias(f"result_{p}"),
            F.max(F.when(this, F.col("confidence"))).alias(f"confidence_{p}"),
            F.count(F.when(this, F.lit(1))).alias(f"n_{p}"),
        ]
    return votes.groupBy(*keys).agg(*aggs)


def _sentence_decisions(votes: DataFrame, keys: list[str], pass_col: str, n_passes: int,
                        label: str, score: str) -> DataFrame:
    """Per sentence key: number of labels, top/bottom (count, mean), the top
    label, and whether every pass voted exactly once.  Two partial+final
    aggregations; the pass set travels as a bit mask, so no extra join."""
    mask = F.bit_or(F.expr(f"shiftleft(1, cast(`{pass_col}` AS int))")).alias("m")
    full_mask = sum(1 << p for p in range(1, n_passes + 1))
    v = votes.select(*keys, label, score, pass_col)
    per_label = v.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("c"), mask)
    packed = F.struct(F.col("n"), F.col("c"), F.col(label).alias("lbl"))
    per_key = per_label.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.max(packed).alias("top"), F.min(packed).alias("bot"),
        F.sum("n").alias("votes"), F.bit_or("m").alias("mask"))
    flat = per_key.select(*keys, "k", F.col("top.n").alias("top_n"), F.col("bot.n").alias("bot_n"),
                          F.col("top.c").alias("top_c"), F.col("bot.c").alias("bot_c"), "votes", "mask",
                          F.col("top.lbl").alias("top_lbl"))
    return flat.withColumn("complete", (F.col("mask") == full_mask) & (F.col("votes") == n_passes))


def sentence_consensus(votes: DataFrame, keys: list[str] = SENTENCE_KEYS, pass_col: str = "pass",
                       n_passes: int = 3, label: str = "Result", score: str = "confidence") -> DataFrame:
    """Per sentence, all passes agree → keep with the mean score; exactly
    two labels → keep the strict count majority iff its mean score is
    strictly higher; all different / no winner → drop.

    Votes are aligned by key, never by position (J4): only sentences with
    exactly one vote in every pass take part (the reference requires equal
    vote lists); ``alignment_audit`` lists the others.
    """
    d = _sentence_decisions(votes, keys, pass_col, n_passes, label, score)
    keep = F.col("complete") & F.col("top_lbl").isNotNull() & (
        (F.col("k") == 1)
        | ((F.col("k") == 2) & (F.col("top_n") > F.col("bot_n")) & (F.col("top_c") > F.col("bot_c"))))
    return d.where(keep).select(*keys, F.col("top_lbl").alias(label), F.col("top_c").alias(score))


def alignment_audit(votes: DataFrame, keys: list[str] = SENTENCE_KEYS, pass_col: str = "pass",
                    n_passes: int = 3) -> DataFrame:
    """Keys whose vote count is not exactly one in every pass."""
    per_key = votes.groupBy(*keys).agg(
        *[F.count(F.when(F.col(pass_col) == p, 1)).alias(f"n_{p}") for p in range(1, n_passes + 1)])
    bad = reduce(lambda a, b: a | b, [F.col(f"n_{p}") != 1 for p in range(1, n_passes + 1)])
    return per_key.where(bad)


def check_alignment(votes: DataFrame, keys: list[str] = SENTENCE_KEYS, pass_col: str = "pass",
                    n_passes: int = 3) -> None:
    """C3 (strict form): raise when the per-pass vote sets are not aligned —
    the reference refuses to merge vote lists of different lengths.  Runs one
    aggregation job; only the count and three example keys reach the driver."""
    bad = alignment_audit(votes, keys, pass_col, n_passes)
    examples = bad.limit(3).collect()
    if examples:
        n = bad.count()
        raise ValueError(f"{n} sentence keys do not have exactly one vote per pass, e.g. "
                         f"{[tuple(r[k] for k in keys) for r in examples]}")


def consensus_audit(votes: DataFrame, keys: list[str] = SENTENCE_KEYS, pass_col: str = "pass",
                    n_passes: int = 3, label: str = "Result", score: str = "confidence") -> DataFrame:
    """A5: one row of counters over the aligned sentences: total, disagree,
    all_different, majority_resolved, unresolved, usable (unresolved =
    disagree - all_different - majority_resolved)."""
    d = _sentence_decisions(votes, keys, pass_col, n_passes, label, score).where("complete")
    resolved = (F.col("k") == 2) & (F.col("top_n") > F.col("bot_n")) & (F.col("top_c") > F.col("bot_c"))
    return d.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("k") > 1).alias("disagree"),
        F.count_if(F.col("k") >= 3).alias("all_different"),
        F.count_if(resolved).alias("majority_resolved"),
        F.count_if((F.col("k") == 2) & ~F.coalesce(resolved, F.lit(False))).alias("unresolved"),
        F.count_if((F.col("k") == 1) | F.coalesce(resolved, F.lit(False))).alias("usable"),
    )


def with_provenance(df: DataFrame) -> DataFrame:
    """C4: unify the two provenance forms (``text_file`` or ``parquet_file`` +
    ``row_index``) into nullable columns plus one ``source`` string."""
    cols = set(df.columns)
    tf: Column = F.col("text_file") if "text_file" in cols else F.lit(None).cast("string")
    pf: Column = F.col("parquet_file") if "parquet_file" in cols else F.lit(None).cast("string")
    ri: Column = F.col("row_index") if "row_index" in cols else F.lit(None).cast("long")
    return (df.withColumn("text_file", tf).withColumn("parquet_file", pf).withColumn("row_index", ri)
              .withColumn("source", F.coalesce(F.col("text_file"),
                                               F.concat_ws("#", F.col("parquet_file"), F.col("row_index").cast("string")))))
