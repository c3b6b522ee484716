"""The whole corpus pipeline against brute force, and awkward inputs of it."""

import random
from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from labelforge.llm import common, crf_langid, decontaminate, mixing, pu_quality
from llm.small import SCHEMA, awkward, words
from llm.test_dedup import brute_components, brute_simhash

NAMES = ("row", "__row", "__labelforge_row", "__quality", "quality_score", "score", "kept", "label")


def corpus():
    rng = random.Random(6)
    rows = awkward()
    for i in range(100, 190):
        text = " ".join(words(rng.randrange(20, 60), rng.randrange(400), rng.choice((1, 3, 5))).split())
        rows.append((i, text.capitalize() + ".", rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), 1))
    for i in range(190, 230):
        rows.append((i, "click here $$$ !!! " * rng.randrange(1, 9), "en", "a", 1))
    rows += [(i + 300, t, g, s, n) for i, t, g, s, n in rows[20:50]] + [rows[30]] * 3
    rows += [(900 + i, f"{words(30, i)} {words(40, 11)} {words(9, i + 3)}", "en", "b", 1) for i in range(4)]
    # near copies that the quality stage accepts
    rows += [(950 + i, f"{words(400, 3, 5).capitalize()}{' end' * i}.", "en", "a", 1) for i in range(2)]
    return rows


def write(spark, folder, rows, labels, items):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in NAMES:
        df = df.withColumn(name, F.lit(7))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def shingles(text):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def similar(text, item):
    have, want = shingles(text), shingles(item)
    if not want:
        return False
    q = Counter(want)
    windows = [have[s:s + len(want)] for s in range(max(1, len(have) - len(want) + 1))]
    return any((common := sum((Counter(w) & q).values())) / (len(w) + len(want) - common) >= 0.8 for w in windows if w)


def brute_mix(spark, rows):
    known = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + SCHEMA)
    u = {r.k: r.u for r in known.select("k", (F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)).alias("u")).collect()}
    cell = [(s or "\0", g or "\0", mixing.topic_of(t)) for _, t, g, s, _ in rows]
    size = [len((t or "").split()) for _, t, *_ in rows]
    n = defaultdict(int)
    for c, k in zip(cell, size):
        n[c] += k
    weight, total = {c: k * mixing.KEEP for c, k in n.items()}, sum(n.values())
    goals = []
    for d in range(3):
        have = Counter()
        for c, k in n.items():
            have[c[d]] += k
        power = {v: k**mixing.TEMPERATURE for v, k in have.items()}
        goals.append({v: p / sum(power.values()) * mixing.KEEP * total for v, p in power.items()})
    change = 1
    while change > mixing.TOLERANCE:
        before = dict(weight)
        for d in range(3):
            have = Counter()
            for c, w in weight.items():
                have[c[d]] += w
            weight = {c: min(w * goals[d][c[d]] / have[c[d]] if have[c[d]] else 0, n[c]) for c, w in weight.items()}
        change = max(abs(weight[c] - before[c]) / max(before[c], 1e-12) for c in weight if n[c])
    return [r for k, r in enumerate(rows) if size[k] and u[k] < weight[cell[k]] / n[cell[k]]]


def brute(spark, docs, rows, labels, items):
    label_frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = pu_quality.train(spark, docs, label_frame, F.col("doc_id").isNotNull() & ~pu_quality.fold(3, 1))
    rows = [r for r in rows if model.score(np.stack([pu_quality.features(r[1])]))[0] >= 0.5]
    stages = [len(rows)]
    best = {}
    for r in rows:
        if r[1] or "" not in best or (r[0] is not None and (best[r[1] or ""][0] is None or r[0] > best[r[1] or ""][0])):
            best.setdefault(r[1] or "", r)
            if r[0] is not None and (best[r[1] or ""][0] is None or r[0] > best[r[1] or ""][0]):
                best[r[1] or ""] = r
    rows = list(best.values())
    stages.append(len(rows))
    roots = brute_components([brute_simhash(r[1]) for r in rows], 3)
    rows = [min((rows[k] for k in range(len(rows)) if roots[k] == root), key=lambda r: (r[0] is None, r[0] or 0)) for root in sorted(set(roots))]
    stages.append(len(rows))
    rows = [r for r in rows if not any(similar(r[1], t) for _, t in items)]
    stages.append(len(rows))
    rows = brute_mix(spark, rows)
    return rows, [*stages, len(rows)]


def test_run_against_brute_force(spark, tmp_path):
    common.remove(spark, common.written(spark))  # of tests that are over: what this run leaves is counted
    rows, items = corpus(), [(1, words(40, 11)), (2, None), (3, "too short")]
    labels = [(i, int(i < 190), 0) for i in range(100, 230, 2)] + [(None, 1, 0), (101, None, 0)]
    docs = write(spark, tmp_path, rows, labels, items)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == docs.columns
    want, stages = brute(spark, docs, rows, labels, items)
    found = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got.collect()]
    assert len(set(stages)) == 5, stages  # every stage removes something
    assert sorted((i, t) for i, t, *_ in found) == sorted((i, t) for i, t, *_ in want)
    assert all(r[n] == 7 for r in got.collect() for n in NAMES)
    assert sum("llm-" in f for f in common.written(spark)) < 30


def test_exact_dedup_beside_reserved_names(spark, tmp_path):
    """No column of the input is taken for the operators' own."""
    docs = write(spark, tmp_path, corpus(), [(1, 1, 0)], [(1, "x")])
    kept = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len({r[1] or "" for r in corpus()})


def test_empty_tables(spark, tmp_path):
    docs = write(spark, tmp_path, [], [], [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_stage_removes_only_what_its_input_does_not_read(spark, tmp_path):
    docs = write(spark, tmp_path, corpus(), [(1, 1, 0)], [(1, "x")])
    before = set(common.written(spark))
    first = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    mine = set(common.written(spark)) - before
    second = corpus_pipeline.near_dedup(spark, first, str(tmp_path))  # its input still reads the first stage's tables
    assert second.count() > 0
    first.write.parquet(f"{tmp_path}/first")
    corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/first"), str(tmp_path))
    left = set(common.written(spark))
    assert mine and not mine & left or mine - left


def test_decontamination_with_repeated_shingles(spark):
    """A repeated phrase inside a passage: similarity 0.8 to 0.85 by counts is found."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, items, want = [], [], set()
    for n in range(40):
        size = rng.choice((100, 168, 335))
        item = [rng.choice(vocabulary) for _ in range(size)]
        at, run = rng.randrange(10, size - 45), int(0.108 * (size - 4)) - 4
        text = item[:at] + ["same"] * run + item[at + run:]  # nearly a tenth of the shingles changes, most into one repeated shingle
        items.append((n, " ".join(item)))
        rows.append((n, " ".join(text), "en", "s", 1))
        if similar(rows[-1][1], items[-1][1]):
            want.add((n, n))
        items.append((100 + n, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(spark, spark.createDataFrame(rows, SCHEMA), bench).collect()}
    want |= {(n, 100 + n) for n in range(40)}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60


def test_features_number_the_occurrences(spark):
    df = spark.createDataFrame([([5, 3, 5, 5, 3, 9],), ([],)], "hs array<bigint>")
    got = [r.f for r in df.select(F.expr(decontaminate._features("hs")).alias("f")).collect()]
    want = [r.h for r in spark.createDataFrame([(3, 0), (3, 1), (5, 0), (5, 1), (5, 2), (9, 0)], "x bigint, k bigint").select(F.xxhash64("x", "k").alias("h")).collect()]
    assert len(got[0]) == 6 and len(set(got[0])) == 6 and got[1] == []
    assert {got[0][0], got[0][2], got[0][5]} == {want[0], want[2], want[5]}
    assert set(got[0]) >= {want[0], want[2], want[5]}


def test_numerals_are_no_letters():
    assert crf_langid.words_of("² ½ Ⅷ ① 12 _ é文字x ªb") == ["é文字x", "ªb"]
