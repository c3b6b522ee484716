"""Mini-batch training with a step log: a softmax head on vectors (V6, V7) and a
projection trained by the contrastive loss (V9, V10).

The weights are small and live on the driver; the rows never do.  A step sends
the weights to the tasks that hold its mini-batch; each returns one row, its
sums of loss and gradient, and the rows are added up by lanes before the last
few reach the driver.  A step reads only its own mini-batch: an epoch's rows are
written once, partitioned by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators.vectors import assign_batches, ntxent_gradient, supcon_gradient
from labelforge.session import scratch_path

#: Partial sums that reach the driver in one step, at most.
LANES = 16
LOG = "model_name string, epoch int, step long, rows long, loss double, grad_norm double, learning_rate double"
_PART = "rows long, loss double, gradient binary"


@dataclass
class Sgd:
    """Plain gradient steps."""

    learning_rate: float

    def update(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return weights - self.learning_rate * gradient


@dataclass
class AdamW:
    """Adam with decoupled weight decay."""

    learning_rate: float
    decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    steps: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def update(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = self.betas[0] * self.first + (1 - self.betas[0]) * gradient
        self.second = self.betas[1] * self.second + (1 - self.betas[1]) * gradient**2
        m, v = self.first / (1 - self.betas[0]**self.steps), self.second / (1 - self.betas[1]**self.steps)
        return weights * (1 - self.learning_rate * self.decay) - self.learning_rate * m / (np.sqrt(v) + self.eps)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def softmax_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of the rows and its gradient; the last row of the weights is the bias."""
    z = x @ weights[:-1] + weights[-1]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    p = e / e.sum(axis=1, keepdims=True)
    at = (np.arange(len(y)), y)
    loss = float(-np.log(p[at]).sum())
    p[at] -= 1.0
    return loss, np.concatenate([x.T @ p, p.sum(axis=0, keepdims=True)])


def _added(rows: pa.Table) -> tuple[int, float, np.ndarray]:
    return (sum(rows.column("rows").to_pylist()), sum(rows.column("loss").to_pylist()),
            np.sum([np.frombuffer(g) for g in rows.column("gradient").to_pylist()], axis=0))


def _part(rows: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"rows": rows, "loss": loss, "gradient": gradient.tobytes()}],
                                      schema=pa.schema([("rows", pa.int64()), ("loss", pa.float64()), ("gradient", pa.binary())]))


def step_sums(batch: DataFrame, vec: str, label: str, weights: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Rows, summed loss and summed gradient of one mini-batch, added up in the tasks, then by lanes."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, loss, gradient = 0, 0.0, np.zeros_like(weights)
        for b in batches:
            if b.num_rows:
                one, more = softmax_sums(_matrix(b.column(vec)), b.column(label).to_numpy(zero_copy_only=False).astype(np.int64), weights)
                rows, loss, gradient = rows + b.num_rows, loss + one, gradient + more
        if rows:
            yield _part(rows, loss, gradient)

    sums = (batch.select(vec, label).mapInArrow(partial, _PART).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
            .groupBy("lane").applyInArrow(lambda t: pa.Table.from_batches([_part(*_added(t))]), _PART).toArrow())
    rows, loss, gradient = _added(sums) if sums.num_rows else (0, 0.0, np.zeros(weights.size))
    return rows, loss, np.asarray(gradient).reshape(weights.shape)


def epoch_batches(spark: SparkSession, train: DataFrame, key: list[str], size: int, seed: int) -> tuple[str, int]:
    """The rows in a seeded order, cut into batches of ``size`` and written by
    batch: the folder and the number of batches."""
    path = scratch_path(spark, "epoch")
    assign_batches(train, size, key, "shuffled", seed=seed, out="_batch").write.partitionBy("_batch").parquet(path)
    return path, -(-spark.read.parquet(path).count() // size)


def train_softmax(train: DataFrame, vec: str, label: str, key: list[str], classes: int, batch_size: int, epochs: int,
                  optimizer: Sgd | AdamW, seed: int = 0, model_name: str = "softmax", weights: np.ndarray | None = None) -> tuple[np.ndarray, DataFrame]:
    """V6/V7: cross-entropy training of one linear layer on a vector column by
    mini-batches: the weights (``dimensions + 1`` by ``classes``) and the step
    log (``LOG``) that A7 and E5 read.

    Epoch e (from 1) takes the rows in the order of md5(seed + e, key); its last
    batch may be smaller.  A row of the log has the batch's mean loss before the
    step and the norm of its mean gradient.  Rows with a NULL vector or label are
    left out; an empty table gives weights of zero size and an empty log."""
    spark = train.sparkSession
    rows = train.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(*key, vec, label)
    head = rows.select(F.size(vec).alias("d")).first()
    if head is None:
        return np.zeros((0, classes)), spark.createDataFrame([], LOG)
    weights = np.zeros((head.d + 1, classes)) if weights is None else weights.copy()
    log, step = [], 0
    for epoch in range(1, epochs + 1):
        path, batches = epoch_batches(spark, rows, key, batch_size, seed + epoch)
        for k in range(batches):
            n, loss, gradient = step_sums(spark.read.parquet(path).where(F.col("_batch") == k), vec, label, weights)
            step += 1
            log.append((model_name, epoch, step, n, loss / n, float(np.linalg.norm(gradient / n)), optimizer.learning_rate))
            weights = optimizer.update(weights, gradient / n)
    return weights, spark.createDataFrame(log, LOG)


def predict_softmax(df: DataFrame, vec: str, weights: np.ndarray, keep: list[str], out: str = "prediction") -> DataFrame:
    """``keep`` plus the class with the largest score (the smaller one at a tie)."""

    @F.pandas_udf("int")
    def predict(x: pd.Series) -> pd.Series:
        return pd.Series((np.vstack(x.to_numpy()) @ weights[:-1] + weights[-1]).argmax(axis=1).astype(np.int32)) if len(x) else pd.Series([], dtype=np.int32)

    return df.select(*keep, predict(F.col(vec)).alias(out))


def train_projection(df: DataFrame, batch: str, vec: str, label: str, dimensions: int, epochs: int, optimizer: Sgd | AdamW, together: int = 8,
                     loss: str = "supcon", seed: int = 0, model_name: str = "projection", **options) -> tuple[np.ndarray, DataFrame]:
    """A linear projection of the vectors trained by the contrastive loss
    of its mini-batches (column ``batch``, see ``assign_batches``): the matrix and
    the step log.

    A pair loss needs its whole mini-batch, which is one task's; a step takes
    ``together`` mini-batches at a time, each in a task of its own, and descends
    along the mean of their gradients.  ``loss`` is ``supcon`` (V9) or
    ``ntxent`` (V10); ``options`` go to its gradient (temperature and the like).
    The start is a seeded random matrix."""
    gradient_of: Callable = {"supcon": supcon_gradient, "ntxent": ntxent_gradient}[loss]
    spark = df.sparkSession
    rows = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(batch, vec, label)
    head = rows.select(F.size(vec).alias("d")).first()
    if head is None:
        return np.zeros((0, dimensions)), spark.createDataFrame([], LOG)
    weights = np.random.default_rng(seed).normal(size=(head.d, dimensions)) / np.sqrt(head.d)
    path = scratch_path(spark, "projection-batches")
    rows.withColumn("_step", F.floor(F.col(batch) / together)).write.partitionBy("_step").parquet(path)
    stored = spark.read.parquet(path)
    steps = stored.agg(F.max("_step")).first()[0] + 1
    log, step = [], 0
    for epoch in range(1, epochs + 1):
        for k in range(steps):
            now = weights

            def partial(t: pa.Table) -> pa.Table:
                x = _matrix(t.column(vec))
                value, dz = gradient_of(x @ now, t.column(label).to_numpy(), **options)
                return pa.Table.from_batches([_part(len(x), value, x.T @ dz)])

            parts = stored.where(F.col("_step") == k).select(batch, vec, label).groupBy(batch).applyInArrow(partial, _PART)
            lanes = (parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).withColumn("one", F.lit(1)).groupBy("lane")
                     .applyInArrow(lambda t: pa.Table.from_batches([_part(t.num_rows, *_added(t)[1:])]), _PART).toArrow())
            if lanes.num_rows:
                groups, value, gradient = _added(lanes)
                gradient = gradient.reshape(weights.shape) / groups
                step += 1
                log.append((model_name, epoch, step, groups, value / groups, float(np.linalg.norm(gradient)), optimizer.learning_rate))
                weights = optimizer.update(weights, gradient)
    return weights, spark.createDataFrame(log, LOG)
