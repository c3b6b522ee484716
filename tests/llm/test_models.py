"""Language ID, quality, toxicity, mixing and rollups against brute force and held-out labels."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM
from labelforge.llm import common, crf_langid, mixing, pu_quality, token_rollup, toxicity
from labelforge.llm.queries import QUERIES
from llm.small import SCHEMA, awkward, frame


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    lengths, k = [3, 1, 4], 3
    e, t = rng.normal(size=(8, k)), rng.normal(size=(k, k))
    post, moves, total = crf_langid.forward_backward(e, t, crf_langid.Chains(lengths), pairs=True)
    want, wmoves, wtotal, at = [], np.zeros((k, k)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=n))
        w = np.exp([sum(e[at + i, p[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths])
        wtotal += np.log(w.sum())
        for i in range(n):
            want.append([w[[p[i] == j for p in paths]].sum() / w.sum() for j in range(k)])
        for i in range(n - 1):
            for p, x in zip(paths, w):
                wmoves[p[i], p[i + 1]] += x / w.sum()
        at += n
    assert np.allclose(post, want) and np.allclose(moves, wmoves) and np.isclose(total, wtotal)


def test_language_id(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = crf_langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    rows = crf_langid.identify(spark, frame(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5) or r.doc_id is None and r.score == 0) for r in rows)
    assert crf_langid.identify(spark, frame(spark, [])).collect() == []


def test_quality(spark):
    docs, known = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = pu_quality.score_documents(spark, docs, known).join(known, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95
    odd = pu_quality.score_documents(spark, frame(spark, awkward()), labels(spark, [(1, 1, 0), (2, None, None), (None, 1, 1), (2, 0, 1)]))
    assert odd.count() == len(awkward()) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert pu_quality.score_documents(spark, frame(spark, []), labels(spark, [])).collect() == []


def plain_features(text):
    """The shape features one character and one word at a time."""
    kinds = [pu_quality._char_class(c) if ord(c) < 0x3000 else 2 for c in text or ""]
    n = max(len(kinds), 1)
    single, double = [0.0] * 8, [0.0] * 64
    for i, k in enumerate(kinds):
        single[k] += 1 / n
        if i:
            double[kinds[i - 1] * 8 + k] += 1 / n
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x]
    w, kinds_of = max(len(words), 1), set(words)
    odd = sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:!?'\"()")
    rest = [np.log1p(len(text or "")), len(text or "") / w, len(kinds_of) / w, max((words.count(x) for x in kinds_of), default=0) / w, odd / w,
            1 - len(set(lines)) / max(len(lines), 1), w / max(len(lines), 1) / 100, min(len(kinds_of) / np.sqrt(w), 50.0)]
    return np.array([x**0.5 for x in single + double] + rest, np.float32)


def test_quality_query_against_brute_force(spark):
    """The whole query by one process: the fold, both samples (all rows here), the prior, the fit and the scores."""
    known = [(i, int(i % 3 > 0), 0) for i in range(1, 12)] + [(1, 0, 0), (None, 1, 1)]
    rows = [r for r in awkward() if r[0] != 6]
    got = pu_quality.score_documents(spark, frame(spark, rows), labels(spark, known))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    good = {i for i, q, _ in known if i is not None and q == 1}
    train = sorted({(r[0], r[1]) for r in rows if r[0] is not None and not held(r[0])}, key=str)
    vectors = lambda texts: np.array(sorted((plain_features(t) for t in texts), key=lambda x: x.tobytes()), np.float64)
    p, u = vectors([t for i, t in train if i in good]), vectors([t for _, t in train])
    assert 1 <= len(p) < len(u)
    model = pu_quality.fit_nnpu(p, u, min(max(pu_quality.estimate_prior(p, u), 0.01), 0.99))
    want = sorted((str(r[0]), held(r[0]), round(float(model.score(plain_features(r[1]))), 5)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 5)) for r in got.collect()) == want
    assert got.where("predicted <> int(score >= 0.5)").count() == 0


def test_prior_is_found_without_negatives():
    rng = np.random.default_rng(6)
    for share in (0.15, 0.5, 0.85):
        n = int(4_000 * share)
        u = np.concatenate([rng.normal(2, 1, (n, 3)), rng.normal(-2, 1, (4_000 - n, 3))])
        assert pu_quality.estimate_prior(rng.normal(2, 1, (3_000, 3)), u) == pytest.approx(share, abs=0.04)
    one = np.ones((1, 3))
    assert pu_quality.estimate_prior(one[:0], one) == pu_quality.estimate_prior(one, one[:0]) == 0
    assert 0 < pu_quality.estimate_prior(one, one) <= 1


def test_no_negative_label_is_read(spark):
    rows = [(i, f"text number {i} " * (1 + i % 5), "en", "a", 1) for i in range(60)]
    both = [(i, i % 2, 0) for i in range(60)]
    scores = [sorted((r.doc_id, r.score) for r in pu_quality.score_documents(spark, frame(spark, rows), labels(spark, known)).collect())
              for known in (both, [x for x in both if x[1] == 1])]
    assert scores[0] == scores[1]


def test_samples_are_bounded_and_never_empty(spark):
    for total in (10**4, 10**10, 10**13, 10**18):
        assert common.sample_bound(4_000, total) / 2**63 == pytest.approx(4_000 / total)
    plain = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    assert 350 < common.hash_sample(plain, 400, 3).count() < 450
    hot = plain.unionByName(spark.range(10_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("h"), "id").alias("text")))
    copies = plain.limit(100).unionByName(spark.range(10_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same").alias("text")))
    for seed in range(6):  # whichever ids the hash picks
        assert 320 < common.hash_sample(hot, 400, seed).count() < 480
        assert common.hash_sample(copies, 400, seed).count() == 101
    known = labels(spark, [(i, i % 2, 0) for i in range(300)])
    sample, total, share = common.label_sample(spark, hot, known, "quality", F.lit(True), 400)
    assert (total, share) == (300, 0.5) and 320 < sample.count() < 480


def test_nnpu_risk_ignores_positives_among_unlabelled():
    rng = np.random.default_rng(2)
    p, n = rng.normal(3, 1, (400, 1)), rng.normal(-3, 1, (300, 1))
    model = pu_quality.fit_nnpu(p, np.concatenate([rng.normal(3, 1, (700, 1)), n]), 0.7)
    assert (model.score(p) > 0.5).mean() > 0.95 and (model.score(n) < 0.5).mean() > 0.95


def test_toxicity(spark):
    docs, known = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = toxicity.score_documents(spark, docs, known).join(known, "doc_id")
    assert got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double"))).first()[0] > 0.93
    odd = toxicity.score_documents(spark, frame(spark, awkward()), labels(spark, [(1, 1, 0), (2, None, None)]))
    assert odd.count() == len(awkward()) and odd.where("score is null").count() == 0
    assert toxicity.score_documents(spark, frame(spark, []), labels(spark, [])).collect() == []


def test_rare_toxic_words_enter_the_lexicon(spark):
    """A word of few toxic documents counts beside one that is twenty times as common."""
    rows = [(f"some plain words {i} vile", 1) for i in range(1000)] + [(f"some plain words {i} crass", 1) for i in range(49)]
    rows += [(f"some plain words {i}", 0) for i in range(2000)] + [("some plain words odd", 1)] * 2
    lexicon = toxicity.learn_lexicon(spark, spark.createDataFrame(rows, "text string, label int"))
    assert {"crass", toxicity.fold_text("vile")} <= set(lexicon) and not any(w.startswith(("odd", "some", "plai")) for w in lexicon)


def test_toxic_matching():
    match = toxicity.Matcher({"idiot": 2.0, "ciown": 1.0, "mor*": 1.5, "moron": 3.0}, toxicity.EXCEPTIONS)
    hits = lambda t: sorted(h[2] for h in match.hits(toxicity.fold_text(t)))
    assert hits("An IDI0T, 1d1ot and ïdıоt") == ["idiot"] * 3
    assert hits("idiotic clowns") == [] and hits("class clown") == [] and hits("a clown") == ["ciown"]
    assert hits("morons moron") == ["mor*", "moron"] and match.measures(None) == (0.0, 0.0)


def test_rake_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(4)}", f"l{rng.randrange(3)}", f"t{rng.randrange(2)}", rng.randrange(0, 900)) for _ in range(40)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n bigint").groupBy("source", "lang", "topic").agg(F.sum("n").alias("n")).cache()
    goals = {d: mixing.tempered(cells, d) for d in mixing.DIMENSIONS}
    here = {tuple(r[:3]): r.weight for r in mixing.rake(spark, cells, goals).select("source", "lang", "topic", "weight").collect()}
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    there = {tuple(r[:3]): r.weight for r in mixing.rake(spark, cells, goals).select("source", "lang", "topic", "weight").collect()}
    assert here.keys() == there.keys() and all(here[k] == pytest.approx(there[k], rel=1e-6) for k in here)


def test_raking_goes_on_until_it_converges(spark, monkeypatch):
    """Sources nearly tied to languages need far more than 30 rounds."""
    rows = [("a", "x", "t", 10**6), ("a", "y", "t", 10**3), ("b", "x", "t", 10**3), ("b", "y", "t", 10**6)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n bigint")
    share = lambda p, q: spark.createDataFrame([(p, 0.5), (q, 0.5)], "value string, share double")
    skew = spark.createDataFrame([("x", 0.52), ("y", 0.48)], "value string, share double")
    goals = {"source": share("a", "b"), "lang": skew}
    with pytest.raises(RuntimeError):
        mixing.rake(spark, cells, goals, max_rounds=30)
    weight = {tuple(r[:2]): r.weight for r in mixing.rake(spark, cells, goals).collect()}
    assert weight["a", "x"] + weight["b", "x"] == pytest.approx(0.52 * 0.5 * sum(r[3] for r in rows), rel=1e-2)
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    with pytest.raises(RuntimeError):
        mixing.rake(spark, cells, goals, max_rounds=2)


def test_mix(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = mixing.mix(spark, docs).toPandas()
    assert len(rows) == docs.count() and rows.probability.between(0, 1).all()
    spent = (rows.probability * rows.n_tokens)
    for d in ("source", "lang"):
        share = rows.groupby(d).n_tokens.sum() ** 0.5
        got = spent.groupby(rows[d]).sum() / spent.sum()
        assert np.abs(got - share / share.sum()).max() < 0.02
    odd = mixing.mix(spark, frame(spark, awkward())).collect()
    assert len(odd) == len(awkward()) and all(r.probability == 0 and not r.kept for r in odd if r.n_tokens == 0)
    assert mixing.mix(spark, frame(spark, [])).collect() == []


def test_rollup_commits(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path))
    assert store.totals().collect() == []
    docs = spark.createDataFrame([(1, "one two", "en", "a", 1), (2, "three", "en", "a", 1), (3, None, None, None, None), (4, "vier", "de", "b", 1)], SCHEMA)
    counts = token_rollup.token_counts(spark, docs, "v1")
    one = {r.doc_id: r.tokens for r in counts.collect()}
    assert store.insert("b1", counts) and not store.insert("b1", counts)
    assert store.delete("b2", spark.createDataFrame([(2,), (2,), (99,), (None,)], "doc_id bigint")) and not store.delete("b2", docs.select("doc_id"))
    assert store.revise("b3", counts.where("doc_id = 1").withColumn("tokens", F.lit(7).cast("bigint")))
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in store.totals().collect()}
    assert got == {("a", "en", "v1"): (1, 7), (None, None, "v1"): (1, 0), ("b", "de", "v1"): (1, one[4])}
    counts.write.mode("overwrite").parquet(f"{tmp_path}/deltas/b4")  # a batch without its commit is not seen
    assert {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in store.totals().collect()} == got


def test_compaction_keeps_totals_and_commits(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path))
    row = lambda i, n, v="v1": (i, "a", "en", v, 1, n, 10 * n)
    counts = lambda *rows: spark.createDataFrame(list(rows), store.LEDGER)
    total = lambda: {(r.version, r.documents, r.tokens) for r in store.totals().collect()}
    assert store.compact("c0") and total() == set()
    store.insert("b1", counts(row(1, 5), row(2, 6), row(1, 7, "v2")))
    store.revise("b2", counts(row(1, 9), row(1, 1), row(None, 100), (3, "a", "en", None, 1, 1, 1)))
    want = {("v1", 3, 16), ("v2", 1, 7)}
    assert total() == want and store.compact("c1") and total() == want
    assert store.live() == ["c1"] and not store.insert("b1", counts(row(9, 9))) and not store.compact("c1")
    assert store.ledger().count() == 3
    store.delete("b3", counts(row(2, 0)))
    assert total() == {("v1", 2, 10), ("v2", 1, 7)} and store.compact("c2") and store.live() == ["c2"] and total() == {("v1", 2, 10), ("v2", 1, 7)}
    store.spark.createDataFrame([("c2",)], "replaces string").write.parquet(f"{tmp_path}/commits/c3/_temporary")  # not finished
    assert store.live() == ["c2"]


@pytest.mark.parametrize("rows", [awkward() + [(20, " two  words\n", "en", "a", 1), (20, "two words", "en", "b", 1), (21, "two words", "en", "a", 1)], []])
def test_rollup_query_against_brute_force(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens, r.chars) for r in QUERIES["op6_token_rollup"](spark, str(tmp_path)).collect()}
    flat = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "").strip(" ")
    changed = {r[0] for r in rows if r[0] is not None and flat(r[1]) != (r[1] or "")}
    last = {}
    for r in rows:
        last[flat(r[1])] = max(last.get(flat(r[1]), -1), -1 if r[0] is None else r[0])
    stays = set(last.values())
    want = {}
    for version, path in (("byte_bpe_50k", token_rollup.TOKENIZER), ("byte_bpe_multi_50k", token_rollup.MULTILINGUAL)):
        count = token_rollup._encoder(path)
        for i, text, lang, source, _ in rows:
            if i is None or i in stays:
                text = flat(text) if i in changed else text or ""
                old = want.get((source, lang, version), (0, 0, 0))
                want[source, lang, version] = (old[0] + 1, old[1] + count(text), old[2] + len(text))
    assert got == want
