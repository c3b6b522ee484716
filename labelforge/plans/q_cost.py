"""Cost family (K1–K5, O5) and ordering / limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import text as T
from labelforge.operators import cost as K
from labelforge.operators import sentences as S
from labelforge.plans.q_text import _PERIOD_LIST, lit, strip_sql
from labelforge.plans import settings as ST
from labelforge.plans.registry import register
from labelforge.plans.sqltext import oracle
from labelforge.sources.fixtures import view

KEYS = ["subject_id", "study_id"]
_HEAD, _TAIL = T.SENTENCE_TEMPLATE.split("{sentence}")


def words_sql(x: str) -> str:
    return f"coalesce(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')), 0)"


def _count_text():
    """The cost notebook's first text: findings + ' ' (if present) + impression (if present)."""
    return F.concat(F.coalesce(F.concat(F.col("findings"), F.lit(" ")), F.lit("")), F.coalesce("impression", F.lit("")))


_COUNT_TEXT_SQL = "coalesce(findings || ' ', '') || coalesce(impression, '')"
_PUNCT_LIST = (f"list_filter(list_transform(regexp_split_to_array({_COUNT_TEXT_SQL}, '[.!?]'), "
               f"lambda x: {strip_sql('x')}), lambda x: x <> '')")


def period_sentences(spark, sf_dir):
    r = view(spark, sf_dir, "reports").select(*KEYS, T.context_period("findings", "impression").alias("text"))
    return S.split_sentences(r, "text", "period")


_PERIOD_CTE = f"""
l AS (SELECT subject_id, study_id, {_PERIOD_LIST} AS s FROM reports),
se AS (SELECT subject_id, study_id, unnest(range(0, len(s))) AS sentence_index, unnest(s) AS sentence FROM l)"""


@register("k1_call_plan", oracle(["reports"], f"""
c AS (SELECT len({_PUNCT_LIST}) AS n FROM reports)
SELECT count(*) AS total_reports, sum(n) AS total_sentences, 3 * sum(n) AS chat_calls, 6 * sum(n) AS embedding_calls,
       9 * sum(n) AS total_requests FROM c
"""))
def k1_call_plan(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    per = r.select(S.count_sentences(_count_text(), "punct").alias("n"))
    return K.call_plan(per, "n")


@register("k2_token_count", oracle(["reports"], _PERIOD_CTE + f"""
SELECT subject_id, study_id, sentence_index, {words_sql('sentence')} AS word_tokens,
       cast(ceil(length(sentence) / 4) AS BIGINT) AS char_tokens FROM se
"""))
def k2_token_count(spark, sf_dir):
    s = period_sentences(spark, sf_dir)
    return s.select(*KEYS, "sentence_index", K.word_tokens("sentence").alias("word_tokens"),
                    K.char_tokens("sentence").alias("char_tokens"))


_PLAN_SQL = _PERIOD_CTE + f""",
tk AS (SELECT {words_sql(lit(T.SENTENCE_SYSTEM))} + {words_sql(lit(_HEAD) + " || sentence || " + lit(_TAIL))} AS chat,
              {words_sql("replace(sentence, chr(10), ' ')")} AS emb FROM se),
pl AS (SELECT count(*) AS total_sentences, 3 * count(*) AS chat_calls, 6 * count(*) AS embedding_calls,
              3 * coalesce(sum(chat), 0) AS chat_tokens, 3 * coalesce(sum(emb), 0) AS emb_context_tokens,
              3 * count(*) * 40 AS emb_explanation_tokens FROM tk)"""


@register("k4_full_token_plan", oracle(["reports"], _PLAN_SQL + """
SELECT *, emb_context_tokens + emb_explanation_tokens AS emb_tokens FROM pl
"""))
def k4_full_token_plan(spark, sf_dir):
    return K.token_plan(period_sentences(spark, sf_dir))


@register("k5_cost_report", oracle(["reports"], _PLAN_SQL + """,
p2 AS (SELECT *, emb_context_tokens + emb_explanation_tokens AS emb_tokens FROM pl)
SELECT *, chat_tokens / 1000000 * CAST(0.05 AS DOUBLE) AS chat_cost, emb_tokens / 1000 * CAST(0.00013 AS DOUBLE) AS emb_cost,
       chat_tokens / 1000000 * CAST(0.05 AS DOUBLE) + emb_tokens / 1000 * CAST(0.00013 AS DOUBLE) AS total_cost FROM p2
"""))
def k5_cost_report(spark, sf_dir):
    return K.cost_report(K.token_plan(period_sentences(spark, sf_dir)))


_SAMPLE_SQL = f"""
sm AS (SELECT *, md5('42' || study_id) AS h FROM reports ORDER BY h, study_id LIMIT 200),
sl AS (SELECT h, study_id, {_PUNCT_LIST} AS s FROM sm),
ss AS (SELECT h, study_id, unnest(range(0, len(s))) AS i, unnest(s) AS sentence FROM sl),
first200 AS (SELECT * FROM ss ORDER BY h, study_id, i LIMIT 200)"""


@register("o5_sample_reports", oracle(["reports"], """
SELECT subject_id, study_id FROM reports ORDER BY md5('42' || study_id), study_id LIMIT 200
"""))
def o5_sample_reports(spark, sf_dir):
    return K.sample_reports(view(spark, sf_dir, "reports"), ST.COST_SAMPLE_SIZE, ST.COST_SAMPLE_SEED, ["study_id"]).select(*KEYS)


@register("k3_sampled_token_estimate", oracle(["reports"], _SAMPLE_SQL + f""",
m AS (SELECT avg({words_sql(lit(T.SENTENCE_SYSTEM))} + {words_sql(lit(_HEAD) + " || sentence || " + lit(_TAIL))}) AS chat_tokens_per_call,
             avg({words_sql('sentence')}) AS embed_tokens_per_sentence FROM first200),
tot AS (SELECT sum(len({_PUNCT_LIST})) AS total_sentences FROM reports)
SELECT chat_tokens_per_call, embed_tokens_per_sentence, chat_tokens_per_call * 3 AS chat_tokens_per_sentence_all_passes,
       embed_tokens_per_sentence * 2 * 3 AS embed_tokens_per_sentence_all_passes, total_sentences,
       chat_tokens_per_call * 3 * total_sentences AS total_chat_tokens,
       embed_tokens_per_sentence * 2 * 3 * total_sentences AS total_embed_tokens
FROM m CROSS JOIN tot
"""))
def k3_sampled_token_estimate(spark, sf_dir):
    r = view(spark, sf_dir, "reports")
    h = F.md5(F.concat(F.lit("42"), F.col("study_id")))
    sample = r.withColumn("h", h).orderBy("h", "study_id").limit(200)
    sents = sample.select("h", "study_id", F.posexplode(S.sentence_array(_count_text(), "punct")).alias("i", "sentence"))
    first200 = sents.orderBy("h", "study_id", "i").limit(200)
    all_sents = r.select(F.explode(S.sentence_array(_count_text(), "punct")).alias("sentence"))
    return K.sampled_token_estimate(first200, all_sents)


# ---------------------------------------------------------------- ordering

@register("o1_order_reports", oracle(["reports"], """
SELECT subject_id, study_id, findings, impression FROM reports ORDER BY subject_id, study_id
"""))
def o1_order_reports(spark, sf_dir):
    return S.order_reports(view(spark, sf_dir, "reports").select(*KEYS, "findings", "impression"), KEYS)


@register("o2_test_slice", oracle(["reports"], f"""
SELECT subject_id, study_id, findings, impression FROM reports ORDER BY subject_id, study_id LIMIT {ST.TEST_SLICE_ROWS}
"""))
def o2_test_slice(spark, sf_dir):
    # the reference's test split: first 5,217 reports of the sorted partition
    r = view(spark, sf_dir, "reports").select(*KEYS, "findings", "impression")
    return S.first_rows(r, KEYS, ST.TEST_SLICE_ROWS)


@register("o3_preview", oracle(["votes"], """
SELECT subject_id, study_id, model, label FROM votes ORDER BY subject_id, study_id, model LIMIT 10
"""))
def o3_preview(spark, sf_dir):
    v = view(spark, sf_dir, "votes").select(*KEYS, "model", "label")
    return S.preview(v, [*KEYS, "model"], 10)


@register("o4_prefix_subset", oracle(["reports"], f"""
SELECT study_id, findings FROM reports ORDER BY subject_id, study_id LIMIT {ST.PREFIX_SUBSET_ROWS}
"""))
def o4_prefix_subset(spark, sf_dir):
    # the same first 2,000 rows for every model: explicit key order
    r = view(spark, sf_dir, "reports").select(*KEYS, "findings")
    return S.first_rows(r, KEYS, ST.PREFIX_SUBSET_ROWS).select("study_id", "findings")


@register("o6_cap_folders", oracle(["reports_raw"], rf"""
f AS (SELECT path, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS folder FROM reports_raw),
keep AS (SELECT DISTINCT folder FROM f ORDER BY folder LIMIT {ST.TEST_FOLDER_CAP})
SELECT path, folder FROM f WHERE folder IN (SELECT folder FROM keep)
"""))
def o6_cap_folders(spark, sf_dir):
    from labelforge.operators.incremental import cap_folders

    raw = view(spark, sf_dir, "reports_raw").select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
    # the reference caps a test-set run at 700 folders
    return cap_folders(raw, "folder", ST.TEST_FOLDER_CAP)


@register("a8_corpus_totals", oracle(["reports"], f"""
c AS (SELECT len({_PUNCT_LIST}) AS n FROM reports)
SELECT count(*) AS total_reports, sum(n) AS total_sentences, avg(n) AS mean_sentences_per_report FROM c
"""))
def a8_corpus_totals(spark, sf_dir):
    return K.corpus_totals(view(spark, sf_dir, "reports"), S.count_sentences(_count_text(), "punct"))
