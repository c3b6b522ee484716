"""Consensus family: C1–C4, A1, A2, A5, A9, W1, W2, J1–J4, U1, U2."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators import consensus as C
from labelforge.operators import consensus_state as CS
from labelforge.plans.registry import register
from labelforge.plans.sqltext import oracle
from labelforge.session import scratch_path
from labelforge.sources.fixtures import stored_view, view

TEACHERS = ["teacher_a", "teacher_b", "teacher_c"]

# Reference-shaped consensus in SQL: label stats, study stats, unanimous
# branch, majority ⋈ minority branch (strict count majority, rule D3),
# join back to the votes, first model by name.
_CONSENSUS_CTES = """
ls AS (SELECT subject_id, study_id, label, count(*) AS n, avg(confidence) AS c
       FROM votes GROUP BY subject_id, study_id, label),
ss AS (SELECT subject_id, study_id, count(*) AS k FROM ls GROUP BY subject_id, study_id),
j AS (SELECT ls.subject_id, ls.study_id, ls.label, ls.n, ls.c, ss.k FROM ls JOIN ss
      ON ls.subject_id = ss.subject_id AND ls.study_id = ss.study_id),
una AS (SELECT subject_id, study_id, label AS cl, c AS cc FROM j WHERE k = 1),
maj AS (SELECT a.subject_id, a.study_id, a.label AS cl, a.c AS cc FROM j a JOIN j b
        ON a.subject_id = b.subject_id AND a.study_id = b.study_id AND a.label IS DISTINCT FROM b.label
        WHERE a.k = 2 AND a.n > b.n AND a.c > b.c),
cons AS (SELECT * FROM una UNION ALL SELECT * FROM maj),
win AS (SELECT v.subject_id, v.study_id, v.findings, v.impression, cons.cl, v.explanation, cons.cc, v.model,
               row_number() OVER (PARTITION BY v.subject_id, v.study_id
                                  ORDER BY v.model, v.explanation, v.findings, v.impression) AS rn
        FROM cons JOIN votes v ON v.subject_id = cons.subject_id AND v.study_id = cons.study_id AND v.label = cons.cl)
"""


@register("c1_consensus", oracle(["votes"], _CONSENSUS_CTES + """
SELECT subject_id, study_id, findings, impression, cl AS label, explanation, cc AS confidence FROM win WHERE rn = 1
"""))
def c1_consensus(spark, sf_dir):
    # votes as a stored table: the operator scans it twice (narrow decision,
    # text join), each reading only the columns it needs
    return C.consensus(stored_view(spark, sf_dir, "votes"))


@register("c1_consensus_text_in_agg", oracle(["votes"], _CONSENSUS_CTES + """
SELECT subject_id, study_id, findings, impression, cl AS label, explanation, cc AS confidence FROM win WHERE rn = 1
"""))
def c1_consensus_text_in_agg(spark, sf_dir):
    return C.consensus_with_text(view(spark, sf_dir, "votes"))


@register("c1_consensus_ignore_failed", oracle(["votes"], _CONSENSUS_CTES.replace(
    "FROM votes GROUP BY subject_id, study_id, label", "FROM votes WHERE label IS NOT NULL GROUP BY subject_id, study_id, label") + """
SELECT subject_id, study_id, findings, impression, cl AS label, explanation, cc AS confidence FROM win WHERE rn = 1
"""))
def c1_consensus_ignore_failed(spark, sf_dir):
    return C.consensus(stored_view(spark, sf_dir, "votes"), ignore_failed_votes=True)


@register("a1_label_stats", oracle(["votes"], """
SELECT subject_id, study_id, label, count(*) AS label_count, avg(confidence) AS avg_conf
FROM votes GROUP BY subject_id, study_id, label
"""))
def a1_label_stats(spark, sf_dir):
    return C.label_stats(view(spark, sf_dir, "votes"))


@register("a2_study_stats", oracle(["votes"], """
SELECT subject_id, study_id, count(*) AS num_labels
FROM (SELECT DISTINCT subject_id, study_id, label FROM votes) t GROUP BY subject_id, study_id
"""))
def a2_study_stats(spark, sf_dir):
    return C.study_stats(C.label_stats(view(spark, sf_dir, "votes")))


@register("j1_stats_join", oracle(["votes"], """
ls AS (SELECT subject_id, study_id, label, count(*) AS label_count, avg(confidence) AS avg_conf
       FROM votes GROUP BY subject_id, study_id, label),
ss AS (SELECT subject_id, study_id, count(*) AS num_labels FROM ls GROUP BY subject_id, study_id)
SELECT ls.subject_id, ls.study_id, ls.label, ls.label_count, ls.avg_conf, ss.num_labels
FROM ls JOIN ss ON ls.subject_id = ss.subject_id AND ls.study_id = ss.study_id
"""))
def j1_stats_join(spark, sf_dir):
    return C.with_study_stats(C.label_stats(view(spark, sf_dir, "votes")))


@register("w1_rank_labels", oracle(["votes"], """
ls AS (SELECT subject_id, study_id, label, count(*) AS label_count, avg(confidence) AS avg_conf
       FROM votes GROUP BY subject_id, study_id, label)
SELECT subject_id, study_id, label, label_count, avg_conf,
       row_number() OVER (PARTITION BY subject_id, study_id
                          ORDER BY label_count DESC, avg_conf DESC NULLS LAST, label ASC NULLS LAST) AS rank
FROM ls
"""))
def w1_rank_labels(spark, sf_dir):
    return C.rank_labels(C.label_stats(view(spark, sf_dir, "votes")))


@register("j2_majority_minority", oracle(["votes"], """
ls AS (SELECT subject_id, study_id, label, count(*) AS label_count, avg(confidence) AS avg_conf
       FROM votes GROUP BY subject_id, study_id, label),
ss AS (SELECT subject_id, study_id, count(*) AS num_labels FROM ls GROUP BY subject_id, study_id),
r AS (SELECT ls.*, row_number() OVER (PARTITION BY ls.subject_id, ls.study_id
             ORDER BY label_count DESC, avg_conf DESC NULLS LAST, label ASC NULLS LAST) AS rank
      FROM ls JOIN ss ON ls.subject_id = ss.subject_id AND ls.study_id = ss.study_id WHERE ss.num_labels = 2)
SELECT a.subject_id, a.study_id, a.label AS consensus_label, a.label_count AS majority_count,
       a.avg_conf AS majority_conf, b.label_count AS minority_count, b.avg_conf AS minority_conf
FROM r a JOIN r b ON a.subject_id = b.subject_id AND a.study_id = b.study_id
WHERE a.rank = 1 AND b.rank = 2 AND a.label_count > b.label_count AND a.avg_conf > b.avg_conf
"""))
def j2_majority_minority(spark, sf_dir):
    return C.majority_join(C.label_stats(view(spark, sf_dir, "votes")))


@register("u1_union_teachers", oracle(["votes"], """
SELECT subject_id, study_id, findings, impression, label, explanation, confidence, model FROM votes
"""))
def u1_union_teachers(spark, sf_dir):
    votes = view(spark, sf_dir, "votes")
    per_teacher = [votes.where(F.col("model") == t).drop("model") for t in TEACHERS]
    return C.union_votes(per_teacher, TEACHERS)


@register("u2_union_decisions", oracle(["votes"], _CONSENSUS_CTES + """
SELECT subject_id, study_id, cl AS consensus_label, cc AS consensus_confidence FROM cons WHERE cl IS NOT NULL
"""))
def u2_union_decisions(spark, sf_dir):
    votes = view(spark, sf_dir, "votes")
    d = C.union_decisions([C.consensus_labels(votes, kind=kind) for kind in ("agreed", "majority")])
    return d.select(*C.KEYS, "consensus_label", "consensus_confidence")


@register("j3_join_back_winners", oracle(["votes"], _CONSENSUS_CTES + """
SELECT subject_id, study_id, model, explanation, cl AS consensus_label FROM win
"""))
def j3_join_back_winners(spark, sf_dir):
    votes = view(spark, sf_dir, "votes")
    d = C.consensus_labels(votes)
    return C.winning_votes(votes, d).select(*C.KEYS, "model", "explanation", "consensus_label")


@register("w2_pick_winner", oracle(["votes"], _CONSENSUS_CTES + """
SELECT subject_id, study_id, model, cl AS consensus_label FROM win WHERE rn = 1
"""))
def w2_pick_winner(spark, sf_dir):
    votes = view(spark, sf_dir, "votes")
    d = C.consensus_labels(votes)
    return C.pick_winner(C.winning_votes(votes, d).select(*C.KEYS, "model", "consensus_label"))


@register("a9_distinct_consensus", oracle(["votes"], _CONSENSUS_CTES + """
SELECT DISTINCT subject_id, study_id, cl AS label FROM win WHERE rn = 1
"""))
def a9_distinct_consensus(spark, sf_dir):
    return C.consensus(view(spark, sf_dir, "votes")).select(*C.KEYS, "label").distinct()


# ------------------------------------------------------------- sentence level

_SENTENCE_CTES = """
p1 AS (SELECT * FROM sentence_votes WHERE pass = 1),
p2 AS (SELECT * FROM sentence_votes WHERE pass = 2),
p3 AS (SELECT * FROM sentence_votes WHERE pass = 3),
z AS (SELECT coalesce(p1.parquet_file, p2.parquet_file, p3.parquet_file) AS parquet_file,
             coalesce(p1.row_index, p2.row_index, p3.row_index) AS row_index,
             coalesce(p1.sentence_index, p2.sentence_index, p3.sentence_index) AS sentence_index,
             p1.Result AS r1, p2.Result AS r2, p3.Result AS r3,
             p1.confidence AS s1, p2.confidence AS s2, p3.confidence AS s3
      FROM p1 FULL OUTER JOIN p2 ON p1.parquet_file = p2.parquet_file AND p1.row_index = p2.row_index
                                 AND p1.sentence_index = p2.sentence_index
              FULL OUTER JOIN p3 ON coalesce(p1.parquet_file, p2.parquet_file) = p3.parquet_file
                                 AND coalesce(p1.row_index, p2.row_index) = p3.row_index
                                 AND coalesce(p1.sentence_index, p2.sentence_index) = p3.sentence_index),
ok AS (SELECT * FROM z WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL),
dec AS (SELECT *,
          CASE WHEN r1 = r2 AND r2 = r3 THEN 'same'
               WHEN r1 <> r2 AND r1 <> r3 AND r2 <> r3 THEN 'alldiff' ELSE 'two' END AS kind,
          CASE WHEN r1 = r2 THEN r1 WHEN r1 = r3 THEN r1 ELSE r2 END AS maj_label,
          CASE WHEN r1 = r2 THEN (s1 + s2) / 2 WHEN r1 = r3 THEN (s1 + s3) / 2 ELSE (s2 + s3) / 2 END AS maj_score,
          CASE WHEN r1 = r2 THEN s3 WHEN r1 = r3 THEN s2 ELSE s1 END AS min_score
        FROM ok)
"""


@register("c2_sentence_consensus", oracle(["sentence_votes"], _SENTENCE_CTES + """
SELECT parquet_file, row_index, sentence_index, r1 AS Result, (s1 + s2 + s3) / 3 AS confidence FROM dec WHERE kind = 'same'
UNION ALL
SELECT parquet_file, row_index, sentence_index, maj_label AS Result, maj_score AS confidence
FROM dec WHERE kind = 'two' AND maj_score > min_score
"""))
def c2_sentence_consensus(spark, sf_dir):
    return C.sentence_consensus(view(spark, sf_dir, "sentence_votes"))


@register("j4_align_passes", oracle(["sentence_votes"], """
SELECT parquet_file, row_index, sentence_index,
       max(Result) FILTER (WHERE pass = 1) AS result_1, max(confidence) FILTER (WHERE pass = 1) AS confidence_1,
       max(Result) FILTER (WHERE pass = 2) AS result_2, max(confidence) FILTER (WHERE pass = 2) AS confidence_2,
       max(Result) FILTER (WHERE pass = 3) AS result_3, max(confidence) FILTER (WHERE pass = 3) AS confidence_3
FROM sentence_votes GROUP BY parquet_file, row_index, sentence_index
"""))
def j4_align_passes(spark, sf_dir):
    return (C.align_passes(view(spark, sf_dir, "sentence_votes"))
            .drop("n_1", "n_2", "n_3"))


@register("c3_alignment_check", oracle(["sentence_votes"], """
SELECT parquet_file, row_index, sentence_index,
       count(*) FILTER (WHERE pass = 1) AS n_1, count(*) FILTER (WHERE pass = 2) AS n_2,
       count(*) FILTER (WHERE pass = 3) AS n_3
FROM sentence_votes GROUP BY parquet_file, row_index, sentence_index
HAVING count(*) FILTER (WHERE pass = 1) <> 1 OR count(*) FILTER (WHERE pass = 2) <> 1
    OR count(*) FILTER (WHERE pass = 3) <> 1
"""))
def c3_alignment_check(spark, sf_dir):
    return C.alignment_audit(view(spark, sf_dir, "sentence_votes"))


@register("a5_consensus_audit", oracle(["sentence_votes"], _SENTENCE_CTES + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE kind <> 'same') AS disagree,
       count(*) FILTER (WHERE kind = 'alldiff') AS all_different,
       count(*) FILTER (WHERE kind = 'two' AND maj_score > min_score) AS majority_resolved,
       count(*) FILTER (WHERE kind = 'two' AND NOT (maj_score > min_score)) AS unresolved,
       count(*) FILTER (WHERE kind = 'same' OR (kind = 'two' AND maj_score > min_score)) AS usable
FROM dec
"""))
def a5_consensus_audit(spark, sf_dir):
    return C.consensus_audit(view(spark, sf_dir, "sentence_votes"))


@register("c4_provenance", oracle(["sentence_votes"], _SENTENCE_CTES + """
SELECT CAST(NULL AS VARCHAR) AS text_file, parquet_file, row_index, sentence_index, r1 AS Result,
       parquet_file || '#' || CAST(row_index AS VARCHAR) AS source
FROM dec WHERE kind = 'same'
UNION ALL
SELECT CAST(NULL AS VARCHAR), parquet_file, row_index, sentence_index, maj_label,
       parquet_file || '#' || CAST(row_index AS VARCHAR)
FROM dec WHERE kind = 'two' AND maj_score > min_score
"""))
def c4_provenance(spark, sf_dir):
    out = C.sentence_consensus(view(spark, sf_dir, "sentence_votes"))
    return C.with_provenance(out).select("text_file", "parquet_file", "row_index", "sentence_index",
                                         "Result", "source")


@register("u3_concat_vote_lists", oracle(["sentence_votes"], """
SELECT parquet_file, row_index, sentence_index, pass, Result, confidence FROM sentence_votes
"""))
def u3_concat_vote_lists(spark, sf_dir):
    # the three per-pass vote lists stacked by column name (any number of lists)
    sv = view(spark, sf_dir, "sentence_votes")
    lists = [sv.where(F.col("pass") == p) for p in (1, 2, 3)]
    return C.union_votes(lists)


_KEPT_VOTES = """
kept AS (SELECT * FROM votes WHERE NOT (model = 'teacher_b' AND right(study_id, 1) IN ('3', '7'))),
lab AS (SELECT subject_id, study_id, label, count(*) AS n, avg(confidence) AS c, min(model) AS m, count(*) OVER (PARTITION BY subject_id, study_id) AS k
        FROM kept GROUP BY subject_id, study_id, label)
SELECT a.subject_id, a.study_id, a.label AS consensus_label, a.c AS consensus_confidence, a.m AS winner_model
FROM lab a LEFT JOIN lab b ON a.subject_id = b.subject_id AND a.study_id = b.study_id AND a.label IS DISTINCT FROM b.label
WHERE a.label IS NOT NULL AND (a.k = 1 OR (a.k = 2 AND a.n > b.n AND a.c > b.c))
"""


@register("c1_kept_up_to_date", oracle(["votes"], _KEPT_VOTES))
def c1_kept_up_to_date(spark, sf_dir):
    # a batch per teacher, one of them twice; then a teacher takes back some of its votes
    votes = view(spark, sf_dir, "votes")
    store = CS.ConsensusStore(spark, scratch_path(spark, "consensus_store"))
    for m in TEACHERS:
        store.apply(m, votes.where(F.col("model") == m))
    store.compact()
    store.apply(TEACHERS[0], votes.where(F.col("model") == TEACHERS[0]))
    store.apply("taken back", retracted=votes.where((F.col("model") == "teacher_b") & F.expr("right(study_id, 1) IN ('3', '7')")))
    return store.decisions()


@register("c1_duplicate_votes", oracle(["votes"], """
d AS (SELECT * FROM votes UNION ALL SELECT * FROM votes WHERE right(study_id, 1) = '5')
SELECT subject_id, study_id, model, count(*) AS vote_rows, count(DISTINCT coalesce('=' || label, '')) AS labels
FROM d GROUP BY ALL HAVING count(*) > 1
"""))
def c1_duplicate_votes(spark, sf_dir):
    votes = view(spark, sf_dir, "votes")
    return CS.duplicate_votes(votes.unionByName(votes.where(F.expr("right(study_id, 1) = '5'"))))
