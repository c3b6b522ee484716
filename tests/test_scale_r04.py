"""c2_consensus_from_teachers at size: what is done once a sentence, and how vectors travel."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelforge.functions import encode as E
from labelforge.functions import text as T
from labelforge.operators import teacher as TE

LABELS = TE.SENTENCE_LABELS


def test_votes_stay_together(spark):
    """one row per sentence (repeated and NULL keys and texts too), the same votes when they are taken apart."""
    rows = [("a", 0, "no effusion"), ("a", 0, "no effusion"), (None, 1, "Ünïcode ligne\nzwei"), ("b", None, None)]
    s = spark.createDataFrame(rows, "rep string, sentence_index int, sentence string")
    teachers = [TE.rule_teacher(k, LABELS, "Result", "Explanation", fence_every=7 * (k == 1)) for k in range(3)]
    keys = ["rep", "sentence_index"]
    votes = TE.label_sentences(s, teachers, keys, together=True)
    assert votes.count() == 4
    got = sorted(map(str, TE.spread_votes(votes, keys, "Context").collect()))
    assert got == sorted(map(str, TE.label_sentences(s, teachers, keys).collect())) and len(got) == 12
    want = []
    for rep, i, text in rows:
        prompt = None if text is None else T.SENTENCE_TEMPLATE.replace("{sentence}", text)
        for k, teacher in enumerate(teachers):
            reply = None if prompt is None else teacher()(pd.Series([prompt]))[0]
            fields = json.loads(reply) if reply and reply[0] == "{" else {}
            want.append((rep, i, k + 1, fields.get("Result"), fields.get("Explanation"), text, reply))
    found = [tuple(r) for r in TE.spread_votes(votes, keys, "Context").collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_sentence_prompts_in_the_worker():
    texts = ["a.\"{sentence}\"", None, "", "Ünïcode \U0001f600"]
    want = [None if t is None else T.SENTENCE_TEMPLATE.replace("{sentence}", t) for t in texts]
    assert T.sentence_prompts(pa.array(texts, pa.string())).to_pylist() == want


def test_sparse_vectors_give_the_same_confidence(spark):
    """vectors travel as their places that are not zero; not one bit of the products differs."""
    words = [f"w{i}" for i in range(90)]
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice(words, int(rng.integers(0, 60))))
    rows = [(i, text(), text()) for i in range(400)] + [(400, None, "a"), (401, "", "a"), (402, "a b", "a b"), (403, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    found = {}
    for sparse in (False, True):
        encoder = TE.bucket_encoder(sparse=sparse)
        both = TE.embed_text(TE.embed_text(df, "a", encoder, "x", dedupe=False), "b", encoder, "y", dedupe=False)
        found[sparse] = {r.i: r.c for r in both.select("i", TE.embedding_confidence("x", "y", sparse=sparse).alias("c")).collect()}
    assert found[True] == found[False] and found[True][400] == 0.5 and found[True][403] == 0.5 and len(found[True]) == 404
    packed = TE.embed_text(df, "a", TE.bucket_encoder(sparse=True), "x", dedupe=False)
    assert packed.select(F.max(F.octet_length("x"))).first()[0] <= 64 * TE.PLACE.itemsize
    with pytest.raises(ValueError):
        TE.embedding_confidence("x", "y", normalize=True, sparse=True)


def test_sparse_dot_of_slices_and_nulls():
    places = lambda *p: np.array(list(p), dtype=TE.PLACE).tobytes()
    a = pa.array([places((9, 9.0)), places((0, 1.5), (3, 2.0)), None, b"", places((7, 1.0))], pa.binary())[1:]
    b = pa.array([places((3, 4.0), (5, 1.0)), places((0, 1.0)), places((1, 1.0)), places((1 << 30, 1.0), )], pa.binary())
    assert TE._sparse_dot(a, b).to_pylist() == [8.0, None, 0.0, 0.0]
    assert TE._sparse_dot(b, a).to_pylist() == [8.0, None, 0.0, 0.0]
    none = pa.nulls(2, pa.binary())
    assert TE._sparse_dot(none, a[:2]).to_pylist() == [None, None] and len(TE._sparse_dot(a[:0], b[:0])) == 0


def test_json_of_arrays(spark):
    """P18 of each text of an array, as one by one; NULL and empty arrays, too."""
    texts = ['{"label": "x", "explanation": {"a": [1]}}', '{"label": 1} 2', None, "[]", "{'label': 1}", '{"explanation": null}']
    df = spark.createDataFrame([(0, texts), (1, []), (2, None), (3, texts[:1])], "i int, t array<string>").coalesce(1)
    each = {r.i: r.p for r in df.select("i", E.parse_json_strict_each("t").alias("p")).collect()}
    one = df.where("i = 0").select(F.explode("t").alias("t")).select(E.parse_json_strict("t").alias("p")).collect()
    want = [(r.p.ok, r.p.value.label if r.p.ok else None, r.p.value.explanation if r.p.ok else None) for r in one]
    assert list(map(tuple, each[0])) == want == [(True, "x", '{"a":[1]}')] + [(False, None, None)] * 4 + [(True, None, None)]
    assert not each[1] and not each[2] and list(map(tuple, each[3])) == want[:1]


def test_strip_takes_all_of_pythons_spaces(spark):
    """A trim of both ends, no pattern over the whole text."""
    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    rows = [(i, f"{c}\n{c}a{c}b {c}") for i, c in enumerate(spaces)] + [(-1, "".join(spaces)), (-2, ""), (-3, "​x﻿")]
    df = spark.createDataFrame(rows, "i int, t string")
    assert {r.i: r.s for r in df.select("i", T.strip("t").alias("s")).collect()} == {i: t.strip() for i, t in rows}
    assert "regexp" not in df.select(T.strip("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_without_python(spark):
    """The JVM's vectors are those of the Arrow batches, bit by bit."""
    rows = [(0, "A b, Ünï-code 12 b"), (1, None), (2, ""), (3, " .,"), (4, ",x y\nz x"), (5, "İstanbul ΣΑΣ 语言 ²")]
    df = spark.createDataFrame(rows, "i int, t string")
    found = [{r.i: r.x for r in TE.embed_text(df, "t", encoder, "x", dedupe=False).collect()}
             for encoder in (TE.bucket_encoder(), TE.jvm_bucket_encoder(), TE.bucket_encoder(7), TE.jvm_bucket_encoder(7))]
    assert found[0] == found[1] and found[2] == found[3] and len(found[0][1]) == 64 and sum(found[0][3]) == 0
