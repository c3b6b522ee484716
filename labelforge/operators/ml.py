"""Features, training and scoring with Spark ML.

The GPU fine-tuning of the reference is re-aimed at Spark ML estimators that
fit with distributed (tree-aggregated) gradients; scoring is a pipeline
``transform`` that keeps the row keys, so predictions never need to be zipped
back by position.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = "[PAD]"


def token_budget(text: Column | str, max_len: int = 120, pad: str = PAD) -> Column:
    """V1: struct of fixed-length ``tokens`` (truncated / padded), ``mask``,
    ``n_tokens`` (before truncation) and ``truncated`` — whitespace tokens."""
    t = F.col(text) if isinstance(text, str) else text
    toks = F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda x: x != "")
    kept = F.slice(toks, 1, max_len)
    fill = F.greatest(F.lit(max_len) - F.size(kept), F.lit(0))
    return F.struct(
        F.concat(kept, F.array_repeat(F.lit(pad), fill)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), fill)).alias("mask"),
        F.size(toks).alias("n_tokens"),
        (F.size(toks) > max_len).alias("truncated"),
    )


def text_classifier(text: str = "Context", label: str = "Result", num_features: int = 1 << 18,
                    max_iter: int = 50, reg: float = 0.0) -> Pipeline:
    """V6: RegexTokenizer → HashingTF → IDF → LogisticRegression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg),
    ])


def train_text_classifier(train: DataFrame, text: str = "Context", label: str = "Result", **kw) -> PipelineModel:
    """V6: fit the text pipeline (label cast to double).

    The stages are fitted one by one so the hashed term frequencies are
    computed once and persisted (memory, spilling to disk) for both the IDF
    pass and the iterative logistic regression, then released; the result
    is the same ``PipelineModel`` a ``Pipeline.fit`` returns."""
    from pyspark import StorageLevel

    tok, tf, idf, lr = text_classifier(text, label, **kw).getStages()
    feats = tf.transform(tok.transform(train.withColumn(label, F.col(label).cast("double"))))
    feats = feats.select(label, "_tf").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        idf_model = idf.fit(feats)
        lr_model = lr.fit(idf_model.transform(feats))
    finally:
        feats.unpersist()
    return PipelineModel(stages=[tok, tf, idf_model, lr_model])


def with_features(df: DataFrame, vec: str, out: str = "_features") -> DataFrame:
    """array<float|double> column → ML vector column (JVM-side)."""
    return df.withColumn(out, array_to_vector(F.transform(vec, lambda x: x.cast("double"))))


def train_linear_head(train: DataFrame, vec: str, label: str, max_iter: int = 100, reg: float = 0.0) -> PipelineModel:
    """V7: frozen features + one linear layer + cross-entropy = multinomial
    logistic regression on the vectors (2 or more classes).  Score with
    ``score_model(model, with_features(df, vec), ...)``."""
    lr = LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", maxIter=max_iter,
                            regParam=reg)
    return Pipeline(stages=[lr]).fit(with_features(train, vec).withColumn(label, F.col(label).cast("double")))


def score_model(model: PipelineModel, df: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """Batch inference keeping the keys: ``keys, prediction, logits``
    (class scores before softmax), ``label`` if given."""
    out = model.transform(df)
    cols = [*keys, F.col("prediction").cast("int").alias("prediction"),
            vector_to_array("rawPrediction").alias("logits")]
    if label:
        cols.append(F.col(label).cast("int").alias("label"))
    return out.select(*cols)


def project_embeddings(df: DataFrame, vec: str, k: int = 3, keep: list[str] | None = None) -> DataFrame:
    """K-D linear projection (PCA) of the vectors, for plotting."""
    v = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    p = model.transform(v).withColumn("_arr", vector_to_array("_p"))
    names = ["x", "y", "z"][:k] if k <= 3 else [f"c{i}" for i in range(k)]
    return p.select(*(keep or []), *[F.col("_arr")[i].alias(n) for i, n in enumerate(names)])
