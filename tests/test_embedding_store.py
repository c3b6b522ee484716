"""Embeddings by content: each text is embedded once over all runs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from labelforge.operators import embedding_store as ES
from labelforge.operators import teacher as TE


def logged(log, fail_on="(never)"):
    def make():
        def encode(texts):
            with open(f"{log}/{os.getpid()}", "a") as f:
                for t in texts:
                    if t == fail_on:
                        raise RuntimeError("encoder failed")
                    f.write(f"{t}\n")
            return [[float(len(t or "")), 1.0] for t in texts]

        return encode

    return TE.batch_encoder(make)


def asked(log):
    return sorted(line.rstrip("\n") for f in os.listdir(log) for line in open(f"{log}/{f}"))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("digest", F.lit("x"))


def test_a_second_run_embeds_only_new_texts(spark, tmp_path):
    log = tempfile.mkdtemp(prefix="lf-embed-")
    store = ES.EmbeddingStore(spark, str(tmp_path), "m")
    assert store.embed(frame(spark, []), "t", logged(log)).collect() == [] and asked(log) == []
    first = store.embed(frame(spark, ["one", "two", "one", None, "a\nb", ""]), "t", logged(log))
    assert {r.k: r.embedding for r in first.collect()} == {0: [3, 1], 1: [3, 1], 2: [3, 1], 3: [0, 1], 4: [3, 1], 5: [0, 1]}
    assert first.columns == ["k", "t", "digest", "embedding"]
    assert asked(log) == sorted(["one", "two", "None", "a b", ""])
    second = store.embed(frame(spark, ["two", "three", None, "a b", "three"]), "t", logged(log))
    assert {r.k: r.embedding for r in second.collect()} == {0: [3, 1], 1: [5, 1], 2: [0, 1], 3: [3, 1], 4: [5, 1]}
    assert asked(log) == sorted(["one", "two", "None", "a b", "", "three"])
    assert store.vectors().count() == 6 and ES.EmbeddingStore(spark, str(tmp_path), "other").vectors().count() == 0


def test_a_failed_run_adds_nothing(spark, tmp_path):
    log = tempfile.mkdtemp(prefix="lf-embed-")
    store = ES.EmbeddingStore(spark, str(tmp_path), "m")
    store.embed(frame(spark, ["one"]), "t", logged(log))
    with pytest.raises(Exception, match="encoder failed"):
        store.embed(frame(spark, ["one", "two", "bad"]), "t", logged(log, "bad"))
    assert store.vectors().count() == 1
    again = store.embed(frame(spark, ["one", "two", "bad"]), "t", logged(log))
    assert again.where("embedding IS NULL").count() == 0 and store.vectors().count() == 3


@pytest.mark.parametrize("most", [1 << 27, 1 << 6])
def test_the_filter_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(ES, "FILTER_BITS", (1 << 6, most))
    stored = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    run = stored.where("id % 100 = 0").select("digest")
    words, bits = ES.digest_filter(run, 50)
    kept = {r.id for r in ES.may_hold(stored, words, bits).collect()}
    assert kept >= set(range(0, 5000, 100))
    assert bits == min(most, 1024) and (most == 1 << 6 or len(kept) < 300)
