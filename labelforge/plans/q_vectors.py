"""Vector and ML family: V1–V7, V9–V13, J6."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators import metrics as M
from labelforge.operators import ml as ML
from labelforge.operators import neighbours as NB
from labelforge.operators import train as TR
from labelforge.operators import vectors as V
from labelforge.plans import settings as ST
from labelforge.plans.registry import register
from labelforge.plans.sqltext import oracle
from labelforge.sources.fixtures import view
from labelforge.session import table

DIM = 64  # embeddings in the driver tables are 64-d


def r6(c):
    return F.transform(c, lambda x: F.round(x, 6))


@register("v1_token_budget", oracle([], r"""
t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS toks FROM documents)
SELECT doc_id, list_resize(list_slice(toks, 1, 120), 120, '[PAD]') AS tokens,
       list_resize(list_transform(list_slice(toks, 1, 120), lambda x: 1), 120, 0) AS mask,
       len(toks) AS n_tokens, len(toks) > 120 AS truncated
FROM t
"""))
def v1_token_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ML.token_budget("text", ST.MAX_TOKENS).alias("b")).select("doc_id", "b.*")


@register("v1_truncation_report", oracle([], r"""
t AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT texts, truncated, truncated / texts AS truncated_share
FROM (SELECT count(*) AS texts, count(*) FILTER (WHERE n > 120) AS truncated FROM t)
"""))
def v1_truncation_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(ML.token_budget("text", ST.MAX_TOKENS).alias("b"))
    g = d.agg(F.count(F.lit(1)).alias("texts"), F.count_if("b.truncated").alias("truncated"))
    return g.select("texts", "truncated", (F.col("truncated") / F.col("texts")).alias("truncated_share"))


_POOL_UNNEST = """u AS (SELECT seq_id, pos, mask, unnest(range(0, 64)) AS i, unnest(CAST(vec AS DOUBLE[])) AS v FROM tokens)"""


@register("v2_mean_pool", oracle(["tokens"], _POOL_UNNEST + """,
g AS (SELECT seq_id, i, avg(v) AS a FROM u GROUP BY seq_id, i)
SELECT seq_id, list(round(a, 6) ORDER BY i) AS pooled FROM g GROUP BY seq_id
"""))
def v2_mean_pool(spark, sf_dir):
    p = V.mean_pool(view(spark, sf_dir, "tokens"), "seq_id", "vec", DIM)
    return p.select("seq_id", r6("pooled").alias("pooled"))


@register("v3_masked_mean_pool", oracle(["tokens"], _POOL_UNNEST + """,
g AS (SELECT seq_id, i, sum(v * mask) / greatest(sum(mask), 1) AS a FROM u GROUP BY seq_id, i)
SELECT seq_id, list(round(a, 6) ORDER BY i) AS pooled FROM g GROUP BY seq_id
"""))
def v3_masked_mean_pool(spark, sf_dir):
    p = V.masked_mean_pool(view(spark, sf_dir, "tokens"), "seq_id", "vec", "mask", DIM)
    return p.select("seq_id", r6("pooled").alias("pooled"))


@register("v4_first_token", oracle(["tokens"], """
SELECT seq_id, vec AS pooled FROM tokens WHERE pos = 0
"""))
def v4_first_token(spark, sf_dir):
    return V.first_token(view(spark, sf_dir, "tokens"), "seq_id", "vec", "pos")


@register("v5_l2_normalize", oracle([], """
s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 5 + 1)) AS e FROM embeddings)
SELECT vec_id, list_transform(e, lambda x: round(x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12), 6))
       AS unit FROM s
"""))
def v5_l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5 + 1))
    return e.select("vec_id", r6(V.l2_normalize(scaled)).alias("unit"))


_NZ = """
b AS (SELECT batch_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM batches),
nz AS (SELECT batch_id, vec_id, label,
              list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) AS z
       FROM b)"""


@register("j6_gram_matrix", oracle(["batches"], _NZ + """,
pr AS (SELECT a.batch_id, a.vec_id AS i, c.vec_id AS j, list_dot_product(a.e, c.e) AS d
       FROM b a JOIN b c ON a.batch_id = c.batch_id)
SELECT batch_id, i AS vec_id, list(j ORDER BY j) AS partners, list(round(d, 6) ORDER BY j) AS sims
FROM pr GROUP BY batch_id, i
"""))
def j6_gram_matrix(spark, sf_dir):
    g = V.gram_rows(view(spark, sf_dir, "batches"), "batch_id", "vec_id", "embedding")
    return g.select("batch_id", "vec_id", "partners", r6("sims").alias("sims"))


_SUPCON = """,
pr AS (SELECT a.batch_id, a.vec_id AS i, c.vec_id AS j, {pos} AS same, list_dot_product(a.z, c.z) / 0.07 AS s
       FROM nz a JOIN nz c ON a.batch_id = c.batch_id),
mx AS (SELECT batch_id, i, max(s) AS m FROM pr GROUP BY batch_id, i),
gg AS (SELECT pr.batch_id, pr.i, pr.j, pr.same, pr.s - mx.m AS g FROM pr JOIN mx ON pr.batch_id = mx.batch_id AND pr.i = mx.i),
per AS (SELECT batch_id, i, ln(sum(exp(g)) FILTER (WHERE i <> j) + 1e-12) AS lse,
               sum(g) FILTER (WHERE same AND i <> j) AS sp, count(*) FILTER (WHERE same AND i <> j) AS np
        FROM gg GROUP BY batch_id, i),
li AS (SELECT batch_id, i, CASE WHEN np = 0 THEN 0 ELSE -(sp / np - lse) END AS l FROM per {anchor})
SELECT batch_id, round(avg(l), 6) AS loss, count(*) AS anchors FROM li GROUP BY batch_id
"""


@register("v9_supcon_loss", oracle(["batches"], _NZ + _SUPCON.format(pos="a.label = c.label", anchor="")))
def v9_supcon_loss(spark, sf_dir):
    s = V.supcon_loss(view(spark, sf_dir, "batches"), "batch_id", "embedding", label="label")
    return s.select("batch_id", F.round("loss", 6).alias("loss"), "anchors")


@register("v9_supcon_unsupervised_one", oracle(["batches"], _NZ + _SUPCON.format(
    pos="a.vec_id // 2 = c.vec_id // 2", anchor="WHERE i % 2 = 0")))
def v9_supcon_unsupervised_one(spark, sf_dir):
    # two views per sample (consecutive rows), anchors = first views only
    b = view(spark, sf_dir, "batches").select(
        "batch_id", "embedding", (F.col("vec_id") / 2).cast("long").alias("sample"),
        (F.col("vec_id") % 2).alias("view"))
    s = V.supcon_loss(b, "batch_id", "embedding", label=None, sample="sample", view="view", mode="one")
    return s.select("batch_id", F.round("loss", 6).alias("loss"), "anchors")


@register("v9_supcon_user_mask", oracle(["batches"], _NZ + """,
pr AS (SELECT a.batch_id, a.vec_id AS i, c.vec_id AS j, c.label = (a.label + 1) % 10 AS same,
              list_dot_product(a.z, c.z) / 0.07 AS s
       FROM nz a JOIN nz c ON a.batch_id = c.batch_id),
mx AS (SELECT batch_id, i, max(s) AS m FROM pr GROUP BY batch_id, i),
gg AS (SELECT pr.batch_id, pr.i, pr.j, pr.same, pr.s - mx.m AS g FROM pr JOIN mx ON pr.batch_id = mx.batch_id AND pr.i = mx.i),
per AS (SELECT batch_id, i, ln(sum(exp(g)) FILTER (WHERE i <> j) + 1e-12) AS lse,
               sum(g) FILTER (WHERE same AND i <> j) AS sp, count(*) FILTER (WHERE same AND i <> j) AS np
        FROM gg GROUP BY batch_id, i),
li AS (SELECT batch_id, i, CASE WHEN np = 0 THEN 0 ELSE -(sp / np - lse) END AS l FROM per)
SELECT batch_id, round(avg(l), 6) AS loss, count(*) AS anchors FROM li GROUP BY batch_id
"""))
def v9_supcon_user_mask(spark, sf_dir):
    # an asymmetric mask: j is a positive of i when label_j = (label_i + 1) mod 10.
    # The pairs come from an equi-join inside each mini-batch on that key, so
    # only the mask's own pairs are produced.
    b = view(spark, sf_dir, "batches")
    anchors = b.select("batch_id", F.col("vec_id").alias("anchor"), ((F.col("label") + 1) % 10).alias("want"))
    cands = view(spark, sf_dir, "batches").select("batch_id", F.col("vec_id").alias("positive"),
                                                  F.col("label").alias("want"))
    pairs = anchors.join(cands, ["batch_id", "want"]).select("batch_id", "anchor", "positive")
    s = V.supcon_loss_masked(b, pairs, "batch_id", "vec_id", "embedding")
    return s.select("batch_id", F.round("loss", 6).alias("loss"), "anchors")


@register("v10_ntxent_loss", oracle(["batches"], _NZ + """,
r AS (SELECT a.batch_id, a.vec_id AS i, c.vec_id AS k, list_dot_product(a.z, c.z) / 0.1 AS r
      FROM nz a JOIN nz c ON a.batch_id = c.batch_id),
rn AS (SELECT batch_id, i, greatest(sqrt(sum(r * r)), 1e-12) AS nr FROM r GROUP BY batch_id, i),
cs AS (SELECT x.batch_id, x.i, y.i AS j, sum(x.r * y.r) AS d FROM r x JOIN r y ON x.batch_id = y.batch_id AND x.k = y.k
       GROUP BY x.batch_id, x.i, y.i),
sim AS (SELECT cs.batch_id, cs.i, cs.j, cs.d / (ni.nr * nj.nr) / 0.07 AS s
        FROM cs JOIN rn ni ON ni.batch_id = cs.batch_id AND ni.i = cs.i JOIN rn nj ON nj.batch_id = cs.batch_id AND nj.i = cs.j),
sl AS (SELECT sim.*, la.label = lb.label AS same
       FROM sim JOIN nz la ON la.batch_id = sim.batch_id AND la.vec_id = sim.i
                JOIN nz lb ON lb.batch_id = sim.batch_id AND lb.vec_id = sim.j),
ng AS (SELECT batch_id, i, coalesce(sum(exp(s)) FILTER (WHERE NOT same), 0) AS ns FROM sl GROUP BY batch_id, i),
pl AS (SELECT sl.batch_id, -ln(exp(sl.s) / (exp(sl.s) + ng.ns)) AS l
       FROM sl JOIN ng ON ng.batch_id = sl.batch_id AND ng.i = sl.i WHERE sl.same AND sl.i <> sl.j),
bb AS (SELECT DISTINCT batch_id FROM nz)
SELECT bb.batch_id, round(avg(pl.l), 6) AS loss, count(pl.l) AS pairs FROM bb LEFT JOIN pl ON pl.batch_id = bb.batch_id
GROUP BY bb.batch_id
"""))
def v10_ntxent_loss(spark, sf_dir):
    s = V.ntxent_loss(view(spark, sf_dir, "batches"), "batch_id", "embedding", "label")
    return s.select("batch_id", F.round("loss", 6).alias("loss"), "pairs")


@register("v11_assign_batches", oracle([], """
SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch_id FROM embeddings
"""))
def v11_assign_batches(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return V.assign_batches(e, ST.BATCH_SIZE, ["vec_id"], "ordered")


@register("v11_assign_batches_shuffled", oracle([], """
SELECT vec_id, (row_number() OVER (ORDER BY md5('42' || CAST(vec_id AS VARCHAR)), vec_id) - 1) // 32 AS batch_id
FROM embeddings
"""))
def v11_assign_batches_shuffled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return V.assign_batches(e, ST.BATCH_SIZE, ["vec_id"], "shuffled", seed=ST.COST_SAMPLE_SEED)


# --------------------------------------------------------------------- ML

def _doc_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("Context"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("Result"))
    j = d.join(lab, "doc_id", "inner")
    return j.where(F.col("doc_id") % 4 != 0), j.where(F.col("doc_id") % 4 == 0)


@register("v6_train_text_classifier")
def v6_train_text_classifier(spark, sf_dir):
    train, test = _doc_split(spark, sf_dir)
    model = ML.train_text_classifier(train, "Context", "Result", num_features=1 << 16, max_iter=20)
    preds = ML.score_model(model, test, ["doc_id"], label="Result")
    return M.split_metrics(preds, [], "label", "prediction")


@register("v12_score_model")
def v12_score_model(spark, sf_dir):
    train, test = _doc_split(spark, sf_dir)
    model = ML.train_text_classifier(train, "Context", "Result", num_features=1 << 16, max_iter=20)
    return ML.score_model(model, test, ["doc_id"], label="Result")


@register("v7_train_linear_head")
def v7_train_linear_head(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    train, test = e.where(F.col("vec_id") % 4 != 0), e.where(F.col("vec_id") % 4 == 0)
    model = ML.train_linear_head(train, "embedding", "label", max_iter=50)
    preds = ML.score_model(model, ML.with_features(test, "embedding"), ["vec_id"], label="label")
    return preds.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double"))
                     .alias("accuracy"))


@register("v13_project_embeddings")
def v13_project_embeddings(spark, sf_dir):
    return ML.project_embeddings(table(spark, sf_dir, "embeddings"), "embedding", 3, keep=["vec_id", "label"])


@register("v9_supcon_gradient", oracle(["batches"], _NZ + """,
pr AS (SELECT a.batch_id, a.vec_id AS i, c.vec_id AS j, a.label = c.label AND a.vec_id <> c.vec_id AS pos,
              CASE WHEN a.vec_id <> c.vec_id THEN exp((list_dot_product(a.z, c.z) - 1) / 0.07) ELSE 0 END AS e
       FROM nz a JOIN nz c ON a.batch_id = c.batch_id),
tot AS (SELECT batch_id, i, sum(e) + 1e-12 AS t, count(*) FILTER (WHERE pos) AS p, count(*) AS n FROM pr GROUP BY batch_id, i),
dg AS (SELECT pr.batch_id, i, j, CASE WHEN p = 0 THEN 0 ELSE (e / t - pos::INT / p) / n / 0.07 END AS d FROM pr JOIN tot USING (batch_id, i)),
twice AS (SELECT batch_id, i, j, d FROM dg UNION ALL SELECT batch_id, j, i, d FROM dg),
dim AS (SELECT vec_id, unnest(z) AS x, unnest(range(0, len(z))) AS k FROM nz),
du AS (SELECT twice.i, k, sum(d * x) AS d FROM twice JOIN dim ON twice.j = dim.vec_id GROUP BY twice.i, k),
away AS (SELECT du.i, sum(du.d * dim.x) AS r FROM du JOIN dim ON dim.vec_id = du.i AND dim.k = du.k GROUP BY du.i),
raw AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v))) AS norm FROM embeddings)
SELECT b.batch_id, du.i AS vec_id, round(sqrt(sum(((du.d - r * dim.x) / norm) ** 2)), 6) AS grad_norm
FROM du JOIN dim ON dim.vec_id = du.i AND dim.k = du.k JOIN away ON away.i = du.i JOIN raw ON raw.vec_id = du.i JOIN batches b ON b.vec_id = du.i
GROUP BY ALL
"""))
def v9_supcon_gradient(spark, sf_dir):
    g = V.supcon_gradients(view(spark, sf_dir, "batches"), "batch_id", "vec_id", "embedding", "label")
    return g.select("batch_id", "vec_id", F.round("grad_norm", 6).alias("grad_norm"))


BATCHES, EPOCHS, RATE = 4, 2, 0.5


def _trained_sql() -> str:
    """The training written out: one CTE per step, from zero weights.  With two
    classes their weights are opposite, so one list of weights is enough."""
    parts = ["""x AS (SELECT vec_id, list_append(list_transform(embedding, lambda v: v::DOUBLE), 1.0::DOUBLE) AS x, label % 2 AS y, vec_id % 4 = 0 AS test FROM embeddings),
size AS (SELECT ceil(count(*) / 4)::BIGINT AS size FROM x WHERE NOT test),
w0 AS (SELECT list_transform(range(0, 65), lambda i: 0.0::DOUBLE) AS w)"""]
    logs = []
    for step in range(1, BATCHES * EPOCHS + 1):
        epoch, k = (step - 1) // BATCHES + 1, (step - 1) % BATCHES
        parts.append(f"""b{step} AS (SELECT x, y, 1 / (1 + exp(-2 * list_dot_product(w, x))) AS p FROM w{step - 1},
  (SELECT x, y, (row_number() OVER (ORDER BY md5(concat('{epoch}', vec_id)), vec_id) - 1) // size AS batch FROM x, size WHERE NOT test) WHERE batch = {k}),
g{step} AS (SELECT list(d ORDER BY i) AS g FROM (SELECT i, avg((p - y) * v) AS d FROM (SELECT p, y, unnest(x) AS v, unnest(range(0, 65)) AS i FROM b{step}) GROUP BY i)),
w{step} AS (SELECT list_transform(list_zip(w, g), lambda z: z[1] - {RATE} * z[2]) AS w FROM w{step - 1}, g{step}),
l{step} AS (SELECT {epoch} AS epoch, {step} AS step, (SELECT count(*) FROM b{step}) AS rows,
  (SELECT avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) FROM b{step}) AS loss, (SELECT sqrt(2 * list_dot_product(g, g)) FROM g{step}) AS grad_norm)""")
        logs.append(f"SELECT * FROM l{step}")
    return "WITH " + ",\n".join(parts) + ",\nlog AS (" + " UNION ALL ".join(logs) + ")"


def _trained(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("y"))
    train = rows.where(F.col("vec_id") % 4 != 0)
    return rows, TR.train_softmax(train, "embedding", "y", ["vec_id"], 2, -(-train.count() // BATCHES), EPOCHS, TR.Sgd(RATE))


@register("v6_step_log", _trained_sql() + """
SELECT epoch, step, rows, round(loss, 9) AS loss, round(grad_norm, 9) AS grad_norm FROM log
""")
def v6_step_log(spark, sf_dir):
    log = _trained(spark, sf_dir)[1][1]
    return log.select("epoch", "step", "rows", F.round("loss", 9).alias("loss"), F.round("grad_norm", 9).alias("grad_norm"))


@register("a7_trained_epochs", _trained_sql() + """
SELECT 'softmax' AS model_name, epoch, round(avg(loss), 9) AS train_loss, count(*) AS steps, round(avg(grad_norm), 9) AS grad_norm_mean FROM log GROUP BY epoch
""")
def a7_trained_epochs(spark, sf_dir):
    rolled = M.epoch_rollup(_trained(spark, sf_dir)[1][1])
    return rolled.select("model_name", "epoch", F.round("train_loss", 9).alias("train_loss"), "steps", F.round("grad_norm_mean", 9).alias("grad_norm_mean"))


@register("e5_trained_splits", _trained_sql() + f""",
cf AS (SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, y, (list_dot_product(w, x) > 0)::INT AS p FROM x, w{BATCHES * EPOCHS}),
n AS (SELECT split, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp FROM cf GROUP BY split)
SELECT split, tn, fp, fn, tp, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM n
""")
def e5_trained_splits(spark, sf_dir):
    rows, (weights, _) = _trained(spark, sf_dir)
    split = F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train").alias("split")
    scored = TR.predict_softmax(rows.select("vec_id", "embedding", "y", split), "embedding", weights, ["split", "y"])
    return M.split_metrics(scored, ["split"], "y", "prediction")


@register("v13_neighbour_layout")
def v13_neighbour_layout(spark, sf_dir):
    # no SQL: the graph is approximate and the layout sampled; tests hold the graph against brute force
    y = NB.neighbour_layout(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, rounds=8)
    return y.select(F.col("key").alias("vec_id"), *[F.col("position")[i].alias(c) for i, c in enumerate("xyz")])
