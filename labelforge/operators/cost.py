"""Call, token and dollar planning.

Everything is one or two aggregations over the sentence table; token counts
are JVM expressions by default, or a pluggable Arrow batch counter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import SENTENCE_SYSTEM, SENTENCE_TEMPLATE, flatten_newlines, sentence_prompt


def _word_count(text: str) -> int:
    return len(text.split())


def _template_is_whitespace_bounded() -> bool:
    head, tail = SENTENCE_TEMPLATE.split("{sentence}")
    return (not head or head[-1].isspace()) and (not tail or tail[0].isspace())

# ---------------------------------------------------------------- fixed values
# Configured numbers of the reference cost plan.
NUM_PASSES = 3
CHAT_COST_PER_M = 0.050      # dollars per 1,000,000 chat input tokens
EMB_COST_PER_K = 0.00013     # dollars per 1,000 embedding input tokens
EXPLANATION_TOKENS_EST = 40  # tokens per explanation (estimate)
CHAT_CALLS_PER_PASS = 1
EMBEDDING_CALLS_PER_PASS = 2
# ------------------------------------------------------------ end fixed values


def word_tokens(x: Column | str) -> Column:
    """K2 built-in counter: whitespace-separated pieces (0 for NULL)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.size(F.filter(F.split(x, r"\s+"), lambda t: t != "")), F.lit(0))


def char_tokens(x: Column | str) -> Column:
    """K2 built-in counter: ceil(chars / 4)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.ceil(F.length(x) / 4), F.lit(0)).cast("long")


def batch_counter(counter_factory: Callable[[], Callable[[str], int]]):
    """K2 pluggable counter (e.g. a BPE tokenizer) as an Arrow ``pandas_udf``,
    opened once per batch iterator."""

    @F.pandas_udf("long")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = counter_factory()
        for s in it:
            yield s.map(lambda t: 0 if t is None else enc(t)).astype("int64")

    return count


def call_plan(df: DataFrame, n_sentences: str | None = None) -> DataFrame:
    """K1: chat 3·S, embedding 6·S, total 9·S in one aggregation.

    ``df`` is either one row per sentence, or one row per report with its
    sentence count in ``n_sentences`` (then ``total_reports`` is reported too)."""
    s = F.sum(n_sentences) if n_sentences else F.count(F.lit(1))
    per_pass = CHAT_CALLS_PER_PASS + EMBEDDING_CALLS_PER_PASS
    aggs = [F.count(F.lit(1)).alias("total_reports")] if n_sentences else []
    return df.agg(
        *aggs,
        s.alias("total_sentences"),
        (s * NUM_PASSES * CHAT_CALLS_PER_PASS).alias("chat_calls"),
        (s * NUM_PASSES * EMBEDDING_CALLS_PER_PASS).alias("embedding_calls"),
        (s * NUM_PASSES * per_pass).alias("total_requests"),
    )


def token_plan(sentences: DataFrame, sentence: str = "sentence",
               counter: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """K4: exact token totals over all sentences and passes (one aggregation).

    chat = passes·Σ(system + prompt); embedding = passes·Σ context + passes·S·40."""
    if counter is word_tokens and _template_is_whitespace_bounded():
        # whitespace words are additive across the fixed template (it meets the
        # sentence at whitespace) and unchanged by newline flattening: one split
        # per sentence instead of three
        fixed = _word_count(SENTENCE_SYSTEM) + sum(_word_count(p) for p in SENTENCE_TEMPLATE.split("{sentence}"))
        w = counter(sentence)
        chat, emb = w + F.lit(fixed), w
    else:
        chat = counter(F.lit(SENTENCE_SYSTEM)) + counter(sentence_prompt(sentence))
        emb = counter(flatten_newlines(sentence))
    g = sentences.agg(F.count(F.lit(1)).alias("S"), F.sum(chat).alias("chat_once"), F.sum(emb).alias("ctx_once"))
    return g.select(
        F.col("S").alias("total_sentences"),
        (F.col("S") * NUM_PASSES * CHAT_CALLS_PER_PASS).alias("chat_calls"),
        (F.col("S") * NUM_PASSES * EMBEDDING_CALLS_PER_PASS).alias("embedding_calls"),
        (F.coalesce("chat_once", F.lit(0)) * NUM_PASSES).alias("chat_tokens"),
        (F.coalesce("ctx_once", F.lit(0)) * NUM_PASSES).alias("emb_context_tokens"),
        (F.col("S") * NUM_PASSES * EXPLANATION_TOKENS_EST).alias("emb_explanation_tokens"),
    ).withColumn("emb_tokens", F.col("emb_context_tokens") + F.col("emb_explanation_tokens"))


def cost_report(plan: DataFrame) -> DataFrame:
    """K5: dollars from a token plan (K4)."""
    chat_cost = F.col("chat_tokens") / 1_000_000 * CHAT_COST_PER_M
    emb_cost = F.col("emb_tokens") / 1_000 * EMB_COST_PER_K
    return plan.select("*", chat_cost.alias("chat_cost"), emb_cost.alias("emb_cost"),
                       (chat_cost + emb_cost).alias("total_cost"))


def sample_reports(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """Reproducible sample of ``n`` rows: order by md5(seed ‖ key), key.

    A top-``n`` (TakeOrdered keeps ``n`` rows per task), the sampling feature itself."""
    h = F.md5(F.concat(F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


def sampled_token_estimate(sample_sentences: DataFrame, total_sentences: DataFrame, sentence: str = "sentence",
                           counter: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """K3: mean tokens per call on a sample × total sentences (3 passes; the
    embedding side counts context + explanation, estimated as 2× context)."""
    chat = counter(F.lit(SENTENCE_SYSTEM)) + counter(sentence_prompt(sentence))
    emb = counter(sentence)
    m = sample_sentences.agg(F.avg(chat).alias("chat_tokens_per_call"), F.avg(emb).alias("embed_tokens_per_sentence"))
    per = m.select("*", (F.col("chat_tokens_per_call") * NUM_PASSES).alias("chat_tokens_per_sentence_all_passes"),
                   (F.col("embed_tokens_per_sentence") * 2 * NUM_PASSES).alias("embed_tokens_per_sentence_all_passes"))
    total = total_sentences.agg(F.count(F.lit(1))).scalar()  # scalar subquery
    out = per.withColumn("total_sentences", total)
    return out.select("*", (F.col("chat_tokens_per_sentence_all_passes") * F.col("total_sentences")).alias("total_chat_tokens"),
                      (F.col("embed_tokens_per_sentence_all_passes") * F.col("total_sentences")).alias("total_embed_tokens"))


def corpus_totals(reports: DataFrame, sentences: Column) -> DataFrame:
    """Reports, sentences (``sentences`` counts those of a report) and sentences per report, in one aggregation."""
    return reports.select(sentences.alias("n")).agg(F.count(F.lit(1)).alias("total_reports"), F.sum("n").alias("total_sentences"),
                                                    F.avg("n").alias("mean_sentences_per_report"))
