"""Teacher family: T1–T7, W3 and the teacher-to-consensus chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import text as T
from labelforge.operators import consensus as C
from labelforge.operators import sentences as S
from labelforge.operators import calls as CA
from labelforge.operators import embedding_store as ES
from labelforge.operators import teacher as TE
from labelforge.plans.q_consensus import _CONSENSUS_CTES
from labelforge.plans.q_text import _PERIOD_LIST
from labelforge.plans import settings as ST
from labelforge.plans.registry import register
from labelforge.plans.sqltext import oracle
from labelforge.session import scratch_path
from labelforge.sources.fixtures import view
from labelforge.session import table

KEYS = ["subject_id", "study_id"]
SENT_KEYS = ["subject_id", "study_id", "sentence_index"]
DOC_TEACHERS = [("teacher_a", 0, 1), ("teacher_b", 1, 3), ("teacher_c", 2, 2)]  # (model, shift, gate)
# one sentence teacher per pass: (shift, gate)
PASS_TEACHERS = [(0, 1), (1, 3), (2, 2)]

_HEAD, _TAIL = T.SENTENCE_TEMPLATE.split("{sentence}")
_INSTR_LEN = len(T.DOC_INSTRUCTION) + len(T.DOC_IMPRESSION_JOIN)
_HEAD_TAIL_LEN = len(_HEAD) + len(_TAIL)


def _lab(idx: str, labels: list[str]) -> str:
    return f"CASE ({idx}) % 3 WHEN 0 THEN '{labels[0]}' WHEN 1 THEN '{labels[1]}' ELSE '{labels[2]}' END"


def doc_teachers(spark, sf_dir, reports=None):
    reports = reports if reports is not None else view(spark, sf_dir, "reports")
    return TE.label_documents_all(reports, {model: TE.rule_teacher(shift, gate=gate)
                                            for model, shift, gate in DOC_TEACHERS})


_T1_CTE = f"""
tt AS (SELECT 0 AS k, 1 AS gate, 'teacher_a' AS model UNION ALL SELECT 1, 3, 'teacher_b' UNION ALL SELECT 2, 2, 'teacher_c'),
rl AS (SELECT r.subject_id, r.study_id, r.findings, r.impression, t.k, t.gate, t.model,
              {_INSTR_LEN} + length(r.findings) + length(r.impression) AS n
       FROM reports r CROSS JOIN tt t),
rb AS (SELECT *, {_lab('n + CASE WHEN n % gate = 0 THEN k ELSE 0 END', TE.DOC_LABELS)} AS lab FROM rl),
ext AS (SELECT subject_id, study_id, findings, impression,
               CASE WHEN n IS NULL OR n % 11 = 0 THEN NULL ELSE lab END AS label,
               CASE WHEN n IS NULL OR n % 11 = 0 THEN NULL
                    ELSE lab || ' by rule ' || cast(k AS VARCHAR) || ': ' || cast(n AS VARCHAR) || ' characters' END AS explanation,
               CASE WHEN n IS NULL THEN NULL
                    WHEN n % 11 = 0 THEN '```json' || chr(10) || '{{"label": "' || lab || '", "explanation": "' || lab || ' by rule '
                         || cast(k AS VARCHAR) || ': ' || cast(n AS VARCHAR) || ' characters"}}' || chr(10) || '```'
                    ELSE '{{"label": "' || lab || '", "explanation": "' || lab || ' by rule ' || cast(k AS VARCHAR) || ': '
                         || cast(n AS VARCHAR) || ' characters"}}' END AS raw_ai_output,
               model
        FROM rb)""".replace("{{", "{").replace("}}", "}")


@register("t1_label_documents", oracle(["reports"], _T1_CTE + """
SELECT * FROM ext
"""))
def t1_label_documents(spark, sf_dir):
    return doc_teachers(spark, sf_dir)


_T5_BODY = r"""
base AS (SELECT subject_id, study_id, model, coalesce(findings, '') || ' ' || coalesce(impression, '') AS ctx, explanation,
                explanation IS NULL OR trim(explanation) = '' AS blank FROM {src}),
nb AS (SELECT * FROM base WHERE NOT blank),
ta AS (SELECT subject_id, study_id, model, tok, count(*) AS ca FROM
         (SELECT subject_id, study_id, model,
                 unnest(list_filter(regexp_split_to_array(lower(ctx), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS tok FROM nb)
       GROUP BY subject_id, study_id, model, tok),
tb AS (SELECT subject_id, study_id, model, tok, count(*) AS cb FROM
         (SELECT subject_id, study_id, model,
                 unnest(list_filter(regexp_split_to_array(lower(explanation), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS tok FROM nb)
       GROUP BY subject_id, study_id, model, tok),
jt AS (SELECT coalesce(ta.subject_id, tb.subject_id) AS subject_id, coalesce(ta.study_id, tb.study_id) AS study_id,
              coalesce(ta.model, tb.model) AS model, coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb
       FROM ta FULL JOIN tb ON ta.subject_id = tb.subject_id AND ta.study_id = tb.study_id AND ta.model = tb.model
                            AND ta.tok = tb.tok),
gt AS (SELECT subject_id, study_id, model, sum(ca * cb) AS dt, sum(ca * ca) AS na, sum(cb * cb) AS nbb
       FROM jt GROUP BY subject_id, study_id, model),
sc AS (SELECT base.subject_id, base.study_id, base.model,
              CASE WHEN base.blank THEN NULL WHEN coalesce(gt.na, 0) = 0 OR coalesce(gt.nbb, 0) = 0 THEN 0
                   ELSE gt.dt / (sqrt(gt.na) * sqrt(gt.nbb)) END AS confidence
       FROM base LEFT JOIN gt ON base.subject_id = gt.subject_id AND base.study_id = gt.study_id AND base.model = gt.model)"""


@register("t5_explanation_confidence", oracle(["votes"], _T5_BODY.replace("{src}", "votes") + """
SELECT subject_id, study_id, model, round(confidence, 9) AS confidence FROM sc
"""))
def t5_explanation_confidence(spark, sf_dir):
    v = view(spark, sf_dir, "votes").drop("confidence")
    s = TE.explanation_confidence(v, [*KEYS, "model"])
    return s.select(*KEYS, "model", F.round("confidence", 9).alias("confidence"))


@register("c1_consensus_from_teachers", oracle(["reports"], _T1_CTE + ",\n" + _T5_BODY.replace("{src}", "ext") + """,
tvotes AS (SELECT e.subject_id, e.study_id, e.findings, e.impression, e.label, e.explanation, sc.confidence, e.model
           FROM ext e JOIN sc ON e.subject_id = sc.subject_id AND e.study_id = sc.study_id AND e.model = sc.model),
""" + _CONSENSUS_CTES.replace("FROM votes", "FROM tvotes").replace("JOIN votes", "JOIN tvotes") + """
SELECT subject_id, study_id, findings, impression, cl AS label, explanation, round(cc, 9) AS confidence
FROM win WHERE rn = 1
"""))
def c1_consensus_from_teachers(spark, sf_dir):
    # teachers → confidence, written once (a sampling teacher must not be
    # called again when the consensus reads its votes) → consensus
    extract = doc_teachers(spark, sf_dir)
    scored = TE.materialize(TE.explanation_confidence(extract, [*KEYS, "model"]), "scored_votes")
    out = C.consensus(scored)
    return out.withColumn("confidence", F.round("confidence", 9))


# ------------------------------------------------------------ sentence level

def sentences(spark, sf_dir):
    r = view(spark, sf_dir, "reports").select(*KEYS, T.context_period("findings", "impression").alias("text"))
    return S.split_sentences(r, "text", "period")


_SENT_CTE = f"""
l AS (SELECT subject_id, study_id, {_PERIOD_LIST} AS s FROM reports),
se AS (SELECT subject_id, study_id, unnest(range(0, len(s))) AS sentence_index, unnest(s) AS sentence FROM l),
sn AS (SELECT *, {_HEAD_TAIL_LEN} + length(sentence) AS n FROM se)"""


@register("t2_label_sentences", oracle(["reports"], _SENT_CTE + f""",
pt AS (SELECT 1 AS pass, 0 AS shift, 1 AS gate UNION ALL SELECT 2, 1, 3 UNION ALL SELECT 3, 2, 2),
lb AS (SELECT sn.*, pt.pass, pt.shift,
              {_lab('n + CASE WHEN n % gate = 0 THEN shift ELSE 0 END', TE.SENTENCE_LABELS)} AS lab
       FROM sn CROSS JOIN pt)
SELECT subject_id, study_id, sentence_index, pass, lab AS Result,
       lab || ' by rule ' || cast(shift AS VARCHAR) || ': ' || cast(n AS VARCHAR) || ' characters' AS Explanation,
       sentence AS Context,
       '{{"Result": "' || lab || '", "Explanation": "' || lab || ' by rule ' || cast(shift AS VARCHAR) || ': '
         || cast(n AS VARCHAR) || ' characters"}}' AS raw_ai_output
FROM lb
""".replace("{{", "{").replace("}}", "}")))
def t2_label_sentences(spark, sf_dir):
    teachers = [TE.rule_teacher(shift, TE.SENTENCE_LABELS, "Result", "Explanation", fence_every=0, gate=gate)
                for shift, gate in PASS_TEACHERS]
    return TE.label_sentences(sentences(spark, sf_dir), teachers, SENT_KEYS, passes=3)


def _retry_results(spark, sf_dir):
    fan = TE.with_passes(sentences(spark, sf_dir), 3).select(
        *SENT_KEYS, "pass", T.sentence_prompt("sentence").alias("prompt"))
    teacher = TE.scripted_failures(TE.rule_teacher(0, TE.SENTENCE_LABELS, "Result", "Explanation", fence_every=0))
    res = TE.call_with_retry(fan, "prompt", teacher, [*SENT_KEYS, "pass"], SENT_KEYS, max_errors=ST.MAX_ERRORS_PER_SENTENCE,
                             validate=TE.strict_json_object)
    # calls are made once: the skip-rest step reads the results twice
    return TE.materialize(res.withColumn("Result", F.get_json_object("raw_ai_output", "$.Result")), "retry_results")


_RETRY_CTE = _SENT_CTE + f""",
fl AS (SELECT *, n % 13 = 0 AS failed, {_lab('n', TE.SENTENCE_LABELS)} AS lab FROM sn),
fb AS (SELECT subject_id, study_id, min(sentence_index) AS first_bad, count(*) * 3 AS failed_calls
       FROM fl WHERE failed GROUP BY subject_id, study_id),
ps AS (SELECT 1 AS pass UNION ALL SELECT 2 UNION ALL SELECT 3)"""


@register("t3_retry_skip_rest", oracle(["reports"], _RETRY_CTE + """
SELECT fl.subject_id, fl.study_id, fl.sentence_index, ps.pass, fl.lab AS Result
FROM fl CROSS JOIN ps LEFT JOIN fb ON fl.subject_id = fb.subject_id AND fl.study_id = fb.study_id
WHERE fb.first_bad IS NULL OR fl.sentence_index < fb.first_bad
"""))
def t3_retry_skip_rest(spark, sf_dir):
    kept = TE.skip_after_failure(_retry_results(spark, sf_dir), KEYS)
    return kept.select(*SENT_KEYS, "pass", "Result")


@register("t3_dead_letter", oracle(["reports"], _RETRY_CTE + """
SELECT subject_id, study_id, first_bad AS first_failed_sentence, failed_calls,
       'RuntimeError: permanent failure' AS error FROM fb
"""))
def t3_dead_letter(spark, sf_dir):
    return TE.dead_letter(_retry_results(spark, sf_dir), KEYS)


@register("t3_ordered_calls", oracle(["reports"], _RETRY_CTE + """
SELECT fl.subject_id, fl.study_id, fl.sentence_index, ps.pass, CASE WHEN NOT failed THEN fl.lab END AS Result,
       CASE WHEN failed THEN 'RuntimeError: permanent failure' END AS error
FROM fl CROSS JOIN ps LEFT JOIN fb ON fl.subject_id = fb.subject_id AND fl.study_id = fb.study_id
WHERE fb.first_bad IS NULL OR fl.sentence_index <= fb.first_bad
"""))
def t3_ordered_calls(spark, sf_dir):
    fan = TE.with_passes(sentences(spark, sf_dir), 3).select(
        *SENT_KEYS, "pass", T.sentence_prompt("sentence").alias("prompt"))
    teacher = TE.scripted_failures(TE.rule_teacher(0, TE.SENTENCE_LABELS, "Result", "Explanation", fence_every=0))
    made = CA.ordered_calls(fan, "prompt", teacher, [*SENT_KEYS, "pass"], KEYS, max_errors=ST.MAX_ERRORS_PER_SENTENCE,
                            validate=TE.strict_json_object)
    return made.select(*SENT_KEYS, "pass", F.get_json_object("raw_ai_output", "$.Result").alias("Result"), "error")


@register("t4_shared_budget", oracle(["reports"], _SENT_CTE + """,
n AS (SELECT count(*) * 3 AS records FROM se)
SELECT records * 3 // 2 AS budget, (records * 3 // 2) // 3 AS records, (records * 3 // 2) // 3 * 3 AS calls FROM n
"""))
def t4_shared_budget(spark, sf_dir):
    # half of the calls that all records would take, spent by tasks that run at the same time
    fan = TE.with_passes(sentences(spark, sf_dir), 3).select(
        *SENT_KEYS, "pass", T.sentence_prompt("sentence").alias("prompt"))
    budget = fan.count() * 3 // 2
    made = CA.ordered_calls(fan, "prompt", TE.rule_teacher(0, TE.SENTENCE_LABELS, "Result", "Explanation", fence_every=0),
                            [*SENT_KEYS, "pass"], KEYS, budget=budget)
    return made.agg(F.lit(budget).cast("bigint").alias("budget"), F.count_if(F.col("raw_ai_output").isNotNull()).alias("records"),
                    F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))


_PLAN_CTE = _SENT_CTE + """,
ps AS (SELECT 1 AS pass UNION ALL SELECT 2 UNION ALL SELECT 3),
pl AS (SELECT se.subject_id, se.study_id, se.sentence_index, ps.pass,
              sum(3) OVER (ORDER BY se.subject_id, se.study_id, se.sentence_index, ps.pass
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_calls
       FROM se CROSS JOIN ps)"""


def _plan(spark, sf_dir):
    return TE.call_plan_rows(sentences(spark, sf_dir).select(*SENT_KEYS), passes=3)


@register("w3_budget_running_total", oracle(["reports"], _PLAN_CTE + """
SELECT subject_id, study_id, sentence_index, pass, cum_calls FROM pl
"""))
def w3_budget_running_total(spark, sf_dir):
    cum = TE.running_total(_plan(spark, sf_dir), [*SENT_KEYS, "pass"], "calls", out="cum_calls")
    return cum.select(*SENT_KEYS, "pass", "cum_calls")


@register("t4_api_budget", oracle(["reports"], _PLAN_CTE + """
SELECT subject_id, study_id, sentence_index, pass, cum_calls FROM pl WHERE cum_calls <= {ST.SMALL_RUN_CALL_BUDGET}
""".format(ST=ST)))
def t4_api_budget(spark, sf_dir):
    # the reference's debugging budget: 5 calls → one complete pass-1 record
    kept = TE.api_budget(_plan(spark, sf_dir), [*SENT_KEYS, "pass"], budget=ST.SMALL_RUN_CALL_BUDGET)
    return kept.select(*SENT_KEYS, "pass", "cum_calls")


@register("t4_api_budget_per_pass", oracle(["reports"], _PLAN_CTE + """
SELECT ps.pass, count(pl.pass) AS records
FROM ps LEFT JOIN (SELECT * FROM pl WHERE cum_calls <= 30000) pl ON pl.pass = ps.pass GROUP BY ps.pass
"""))
def t4_api_budget_per_pass(spark, sf_dir):
    kept = TE.api_budget(_plan(spark, sf_dir), [*SENT_KEYS, "pass"], budget=30000)
    passes = spark.range(1, 4).select(F.col("id").cast("int").alias("pass"))
    counts = kept.groupBy("pass").agg(F.count(F.lit(1)).alias("records"))
    return passes.join(counts, "pass", "left").select("pass", F.coalesce("records", F.lit(0)).alias("records"))


@register("t6_embedding_confidence", oracle([], """
SELECT a.vec_id,
       round((list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2, 6) AS confidence
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""))
def t6_embedding_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.select("vec_id", "embedding").join(nxt, "vec_id", "inner")
    return j.select("vec_id", F.round(TE.embedding_confidence("embedding", "other"), 6).alias("confidence"))


def _emb_sql(text: str) -> str:
    """DuckDB restatement of ``bucket_encoder(64)`` over a text expression."""
    toks = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    idx = f"list_transform({toks}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"
    counts = f"list_transform(range(0, 64), lambda i: CAST(len(list_filter({idx}, lambda x: x = i)) AS DOUBLE))"
    return counts


def _unit_sql(counts: str) -> str:
    return (f"list_transform({counts}, lambda c: c / greatest(sqrt(list_reduce(list_transform({counts}, "
            f"lambda y: y * y), lambda a, b: a + b)), 1e-12))")


@register("t7_embed_text", oracle(["reports"], _SENT_CTE + f""",
ce AS (SELECT subject_id, study_id, sentence_index, {_emb_sql("replace(sentence, chr(10), ' ')")} AS counts FROM se)
SELECT subject_id, study_id, sentence_index, {_unit_sql("counts")} AS embedding FROM ce
"""))
def t7_embed_text(spark, sf_dir):
    s = sentences(spark, sf_dir)
    return TE.embed_text(s, "sentence", TE.jvm_bucket_encoder(), dedupe=False).select(*SENT_KEYS, "embedding")


_C2_CHAIN_SQL = _SENT_CTE + f""",
pt AS (SELECT 1 AS pass, 0 AS shift, 1 AS gate UNION ALL SELECT 2, 1, 3 UNION ALL SELECT 3, 2, 2),
lb AS (SELECT sn.*, pt.pass, pt.shift,
              {_lab('n + CASE WHEN n % gate = 0 THEN shift ELSE 0 END', TE.SENTENCE_LABELS)} AS lab
       FROM sn CROSS JOIN pt),
ex AS (SELECT subject_id, study_id, sentence_index, pass, lab,
              {_emb_sql("replace(sentence, chr(10), ' ')")} AS cc,
              {_emb_sql("replace(lab || ' by rule ' || cast(shift AS VARCHAR) || ': ' || cast(n AS VARCHAR) || ' characters', chr(10), ' ')")} AS ec
       FROM lb),
un AS (SELECT subject_id, study_id, sentence_index, pass, lab, {_unit_sql("cc")} AS cu, {_unit_sql("ec")} AS eu FROM ex),
sc AS (SELECT subject_id, study_id, sentence_index, pass, lab AS r,
              (list_reduce(list_transform(list_zip(cu, eu), lambda p: p[1] * p[2]), lambda a, b: a + b) + 1) / 2 AS s
       FROM un),
pv AS (SELECT a.subject_id, a.study_id, a.sentence_index, a.r AS r1, b.r AS r2, c.r AS r3, a.s AS s1, b.s AS s2, c.s AS s3
       FROM sc a JOIN sc b ON a.subject_id = b.subject_id AND a.study_id = b.study_id AND a.sentence_index = b.sentence_index
                 JOIN sc c ON a.subject_id = c.subject_id AND a.study_id = c.study_id AND a.sentence_index = c.sentence_index
       WHERE a.pass = 1 AND b.pass = 2 AND c.pass = 3),
dec AS (SELECT *,
          CASE WHEN r1 = r2 AND r2 = r3 THEN 'same'
               WHEN r1 <> r2 AND r1 <> r3 AND r2 <> r3 THEN 'alldiff' ELSE 'two' END AS kind,
          CASE WHEN r1 = r2 THEN r1 WHEN r1 = r3 THEN r1 ELSE r2 END AS maj_label,
          CASE WHEN r1 = r2 THEN (s1 + s2) / 2 WHEN r1 = r3 THEN (s1 + s3) / 2 ELSE (s2 + s3) / 2 END AS maj_score,
          CASE WHEN r1 = r2 THEN s3 WHEN r1 = r3 THEN s2 ELSE s1 END AS min_score
        FROM pv)
SELECT subject_id, study_id, sentence_index, r1 AS Result, round((s1 + s2 + s3) / 3, 9) AS confidence
FROM dec WHERE kind = 'same'
UNION ALL
SELECT subject_id, study_id, sentence_index, maj_label AS Result, round(maj_score, 9) AS confidence
FROM dec WHERE kind = 'two' AND maj_score > min_score
"""


@register("c2_consensus_from_teachers", oracle(["reports"], _C2_CHAIN_SQL))
def c2_consensus_from_teachers(spark, sf_dir):
    """T2 votes → T7 embeddings of context and explanation → T6 confidence → C2."""
    teachers = [TE.rule_teacher(shift, TE.SENTENCE_LABELS, "Result", "Explanation", fence_every=0, gate=gate)
                for shift, gate in PASS_TEACHERS]
    # written once, so that each prompt is sent once; one row per sentence: its context is the same in every pass
    votes = TE.materialize(TE.label_sentences(sentences(spark, sf_dir), teachers, SENT_KEYS, passes=3, together=True), "sentence_votes")
    # in place: a vector is far larger than its vote, and a vote needs both for one number only
    encoder = TE.bucket_encoder(sparse=True)
    ctx = TE.embed_text(votes, "Context", encoder, out="ctx_emb", dedupe=False)
    both = TE.embed_text(TE.spread_votes(ctx, SENT_KEYS, "ctx_emb"), "Explanation", encoder, out="exp_emb", dedupe=False)
    scored = TE.materialize(both.select(*SENT_KEYS, "pass", "Result",
                                        TE.embedding_confidence("ctx_emb", "exp_emb", sparse=True).alias("confidence")),
                            "sentence_votes_scored")
    out = C.sentence_consensus(scored, keys=SENT_KEYS)
    return out.withColumn("confidence", F.round("confidence", 9))


@register("t7_embedding_store", oracle(["reports"], _SENT_CTE + """,
fl AS (SELECT *, replace(sentence, chr(10), ' ') AS t FROM se),
early AS (SELECT DISTINCT t FROM fl WHERE sentence_index % 2 = 0)
SELECT subject_id, study_id, sentence_index, CASE WHEN early.t IS NULL THEN 'second' ELSE 'first' END AS embedded_in
FROM fl LEFT JOIN early ON early.t = fl.t
"""))
def t7_embedding_store(spark, sf_dir):
    # two runs: the second one meets the texts of the first again and embeds only the others
    # the digest is taken here: after the lookup the text itself is not needed any more
    s = sentences(spark, sf_dir).select(*SENT_KEYS, "sentence", ES.digest_key(ES.text_digest("sentence")).alias("digest"))
    store = ES.EmbeddingStore(spark, scratch_path(spark, "embedding_store"), "buckets")
    store.embed(s.where(F.col("sentence_index") % 2 == 0), "sentence", TE.bucket_encoder(), batch="first")
    both = store.embed(s, "sentence", TE.bucket_encoder(), batch="second").where(F.size("embedding") == 64)
    named = store.vectors().select(ES.digest_key("digest").alias("digest"), F.col("batch").alias("embedded_in"))
    return both.join(named, "digest").select(*SENT_KEYS, "embedded_in")
