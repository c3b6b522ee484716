"""Vector operators.

Pooling is one vector aggregate per sequence, whatever the dimension (partial
before the shuffle; no explode, no collected lists).  The contrastive losses
need every pair of a mini-batch; instead of emitting those pairs as rows they
run as one ``applyInPandas`` task per mini-batch that walks the B×B product in
blocks of ``BLOCK_ROWS`` rows, so memory is block × B and a batch of any size
is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.operators.teacher import running_total

BLOCK_ROWS = 512


def _blocks(n: int) -> Iterator[np.ndarray]:
    """Consecutive row numbers of an n-row matrix, a block at a time."""
    for start in range(0, n, BLOCK_ROWS):
        yield np.arange(start, min(start + BLOCK_ROWS, n))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    """V5: ``v / max(||v||, eps)`` element-wise (JVM higher-order functions).

    The sum of squares is one ``aggregate`` whose finish function divides, so
    the norm is computed once per row, not once per element."""
    v = _c(v)
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"),
                       lambda ss: F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(ss), F.lit(eps))))


def vector_dim(df: DataFrame, vec: str) -> int:
    """Dimension of a fixed-width vector column (reads one row)."""
    return int(df.select(F.size(vec)).first()[0])


def _vector_sum(v: Column, dim: int) -> Column:
    """Element-wise sum of vectors as one aggregate; a NULL vector adds nothing."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return vector_to_array(Summarizer.sum(array_to_vector(F.coalesce(v, zero))))


def mean_pool(tokens: DataFrame, seq: str, vec: str, dim: int) -> DataFrame:
    """V2: unmasked mean over all positions of a sequence (padding counted;
    NULL vectors are left out, a sequence of NULL vectors only gives NULL)."""
    g = tokens.groupBy(seq).agg(_vector_sum(F.col(vec).cast("array<double>"), dim).alias("_sum"), F.count(vec).alias("_n"))
    return g.select(seq, F.when(F.col("_n") > 0, F.transform("_sum", lambda x: x / F.col("_n"))).alias("pooled"))


def masked_mean_pool(tokens: DataFrame, seq: str, vec: str, mask: str, dim: int) -> DataFrame:
    """V3: ``sum(v * m) / max(sum(m), 1)`` per sequence (an all-masked sequence
    gives the zero vector)."""
    m = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    masked = F.transform(F.col(vec), lambda x: x.cast("double") * m)
    g = tokens.groupBy(seq).agg(_vector_sum(masked, dim).alias("_sum"), F.greatest(F.sum(m), F.lit(1.0)).alias("_n"))
    return g.select(seq, F.transform("_sum", lambda x: x / F.col("_n")).alias("pooled"))


def first_token(tokens: DataFrame, seq: str, vec: str, pos: str) -> DataFrame:
    """V4: vector at the lowest position (the CLS fallback of the pooler)."""
    return tokens.groupBy(seq).agg(F.min_by(vec, pos).alias("pooled"))


def assign_batches(df: DataFrame, size: int, key: list[str], mode: str = "ordered", seed: int = 42,
                   out: str = "batch_id") -> DataFrame:
    """Mini-batches of ``size`` rows.

    * ``ordered``  — consecutive rows in key order (batch = rank // size);
    * ``shuffled`` — the same over a seeded md5 order of the key (exact sizes);
    * ``hashed``   — ``pmod(hash(seed, key), ceil(n/size))``: no sort at all,
      sizes approximate.
    Ranks come from the distributed running total (no one-partition window).
    """
    if mode == "hashed":
        n = df.count()
        buckets = max(1, -(-n // size))
        return df.withColumn(out, F.pmod(F.hash(F.lit(seed), *key), F.lit(buckets)).cast("long"))
    if mode == "ordered":
        order = key
        src = df
    elif mode == "shuffled":
        src = df.withColumn("_shuffle", F.md5(F.concat(F.lit(str(seed)), *[F.col(k).cast("string") for k in key])))
        order = ["_shuffle", *key]
    else:
        raise ValueError(mode)
    ranked = running_total(src, order, F.lit(1), out="_rank")
    res = ranked.withColumn(out, ((F.col("_rank") - 1) / size).cast("long")).drop("_rank")
    return res.drop("_shuffle") if mode == "shuffled" else res


def _unit_rows(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(n, eps)


def supcon_batch(z: np.ndarray, labels: np.ndarray | None, sample: np.ndarray | None, temperature: float,
                 base_temperature: float, anchors: np.ndarray) -> np.ndarray:
    """Per-anchor supervised contrastive loss of one mini-batch (rows = views).

    Positives: same label (or, without labels, same sample); self excluded.
    Anchors without a positive score 0."""
    key = labels if labels is not None else sample
    loss = _anchor_losses(z, lambda rows: key[rows, None] == key[None, :], temperature, base_temperature)
    return loss[anchors]


def _anchor_losses(z: np.ndarray, positives: Callable[[np.ndarray], np.ndarray], temperature: float,
                   base_temperature: float) -> np.ndarray:
    """Loss of every row as anchor; ``positives(rows)`` is the block of the mask for those anchors."""
    z = _unit_rows(z)
    loss = np.zeros(len(z))
    for rows in _blocks(len(z)):
        g = (z[rows] @ z.T) / temperature
        g -= g.max(axis=1, keepdims=True)
        own = (np.arange(len(rows)), rows)
        pos = positives(rows)
        pos[own] = False
        e = np.exp(g)
        e[own] = 0.0
        p = pos.sum(axis=1)
        mean_pos = (g * pos).sum(axis=1) / np.maximum(p, 1) - np.log(e.sum(axis=1) + 1e-12)
        loss[rows] = np.where(p > 0, -(temperature / base_temperature) * mean_pos, 0.0)
    return loss


def supcon_loss(df: DataFrame, batch: str, vec: str, label: str | None = "label", sample: str | None = None,
                view: str | None = None, temperature: float = 0.07, base_temperature: float = 0.07,
                mode: str = "all") -> DataFrame:
    """V9: SupCon loss per mini-batch → ``(batch, loss, anchors)``.

    Each row is one view of one sample.  ``label=None`` gives the
    unsupervised (SimCLR) loss with the other views of the same ``sample`` as
    positives; ``mode='one'`` uses only view 0 as anchors."""
    if label is None and sample is None:
        raise ValueError("unsupervised loss needs a sample column (views of one sample are positives)")
    if mode not in ("all", "one"):
        raise ValueError(f"mode must be 'all' or 'one', got {mode!r}")
    cols = [batch, vec] + [c for c in (label, sample, view) if c]

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.vstack(pdf[vec].to_numpy()).astype(np.float64)
        labs = pdf[label].to_numpy() if label else None
        smp = pdf[sample].to_numpy() if sample else None
        anchors = (pdf[view].to_numpy() == 0) if (mode == "one" and view) else np.ones(len(pdf), dtype=bool)
        loss = supcon_batch(z, labs, smp, temperature, base_temperature, anchors)
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "loss": [float(loss.mean())],
                             "anchors": [int(anchors.sum())]})

    schema = f"{batch} long, loss double, anchors long"
    return df.select(*cols).groupBy(batch).applyInPandas(per_batch, schema)


def supcon_loss_masked(df: DataFrame, pairs: DataFrame, batch: str, key: str, vec: str,
                       temperature: float = 0.07, base_temperature: float = 0.07) -> DataFrame:
    """V9 with a user mask: ``pairs`` holds ``(batch, anchor, positive)`` key
    pairs (may be asymmetric; self pairs are ignored) instead of labels.

    Rows and mask pairs of one mini-batch meet in one co-grouped
    ``applyInPandas`` call; the pairs stay a list, spread over one block of
    anchors at a time."""
    if "label" in pairs.columns:
        raise ValueError("positives come from labels or from a mask, not from both")

    def per_batch(rows: pd.DataFrame, mask: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({batch: [], "loss": [], "anchors": []})
        ids = pd.Index(rows[key])
        n = len(ids)
        a, p = ids.get_indexer(mask["anchor"]), ids.get_indexer(mask["positive"])
        known = (a >= 0) & (p >= 0)
        a, p = a[known], p[known]
        order = np.argsort(a, kind="stable")
        a, p = a[order], p[order]

        def positives(block: np.ndarray) -> np.ndarray:
            lo, hi = np.searchsorted(a, [block[0], block[-1] + 1])
            m = np.zeros((len(block), n), dtype=bool)
            m[a[lo:hi] - block[0], p[lo:hi]] = True
            return m

        z = np.vstack(rows[vec].to_numpy()).astype(np.float64)
        loss = _anchor_losses(z, positives, temperature, base_temperature)
        return pd.DataFrame({batch: [rows[batch].iloc[0]], "loss": [float(loss.mean())], "anchors": [n]})

    # fresh aliases: the mask is usually derived from the same rows, and
    # co-grouping two plans that share attributes would be ambiguous
    left = df.select(*[F.col(c).alias(c) for c in (batch, key, vec)]).groupBy(batch)
    right = pairs.select(*[F.col(c).alias(c) for c in (batch, "anchor", "positive")]).groupBy(batch)
    return left.cogroup(right).applyInPandas(per_batch, f"{batch} long, loss double, anchors long")


def gram_rows(df: DataFrame, batch: str, key: str, vec: str, scale: float = 1.0,
              normalize: bool = False) -> DataFrame:
    """The Gram matrix of each mini-batch as one row per anchor:
    ``(batch, key, partners, sims)`` with ``sims[j] = z_key · z_partners[j] / scale``
    (partners in key order).  The matrix is the output, so a task holds B×B
    numbers; the losses below do not need it."""

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        z = np.vstack(pdf[vec].to_numpy()).astype(np.float64)
        if normalize:
            z = _unit_rows(z)
        g = (z @ z.T) / scale
        ids = pdf[key].to_numpy()
        return pd.DataFrame({batch: pdf[batch].to_numpy(), key: ids, "partners": [ids.tolist()] * len(ids),
                             "sims": list(g)})

    schema = f"{batch} long, {key} long, partners array<long>, sims array<double>"
    return df.select(batch, key, vec).groupBy(batch).applyInPandas(per_batch, schema)


def ntxent_batch(z: np.ndarray, labels: np.ndarray, scale: float = 0.1, temperature: float = 0.07) -> float | None:
    """NT-Xent with labels over the rows of ``z·zᵀ/scale`` (z unit rows):
    mean over ordered positive pairs of ``-ln(e^{s_ap/τ} / (e^{s_ap/τ} + Σ_neg e^{s_an/τ}))``
    with ``s`` the cosine similarity of the feature rows.

    The inner product of two feature rows is ``z_a (zᵀz) z_bᵀ / scale²``, so the
    feature matrix itself is never built."""
    z = _unit_rows(z)
    h = z @ (z.T @ z)
    norm = np.maximum(np.sqrt(np.maximum((h * z).sum(axis=1), 0.0)) / scale, 1e-12) * scale
    total, pairs = 0.0, 0
    for rows in _blocks(len(z)):
        s = (h[rows] @ z.T) / (norm[rows, None] * norm[None, :] * temperature)
        pos = labels[rows, None] == labels[None, :]
        e = np.exp(s - s.max(axis=1, keepdims=True))
        neg_sum = (e * ~pos).sum(axis=1)
        pos[np.arange(len(rows)), rows] = False
        a, p = np.nonzero(pos)
        total -= float(np.log(e[a, p] / (e[a, p] + neg_sum[a])).sum())
        pairs += len(a)
    return total / pairs if pairs else None


def ntxent_loss(df: DataFrame, batch: str, vec: str, label: str, scale: float = 0.1,
                temperature: float = 0.07) -> DataFrame:
    """Archived NT-Xent variant per mini-batch → ``(batch, loss, pairs)``."""

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.vstack(pdf[vec].to_numpy()).astype(np.float64)
        labs = pdf[label].to_numpy()
        loss = ntxent_batch(z, labs, scale, temperature)
        sizes = pd.Series(labs).value_counts().to_numpy()
        pairs = int((sizes * (sizes - 1)).sum())
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "loss": [loss], "pairs": [pairs]})

    return df.select(batch, vec, label).groupBy(batch).applyInPandas(per_batch, f"{batch} long, loss double, pairs long")


# ---------------------------------------------------------------- gradients

def _through_norm(z: np.ndarray, du: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Gradient of the rows from the gradient of their unit vectors."""
    n = np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), eps)
    u = z / n
    return (du - (du * u).sum(axis=1, keepdims=True) * u) / n


def supcon_gradient(z: np.ndarray, labels: np.ndarray, temperature: float = 0.07, base_temperature: float = 0.07) -> tuple[float, np.ndarray]:
    """V9 backward: the mean loss over all rows as anchors and its gradient by the
    rows, block by block (a block of anchors times all rows is held at a time)."""
    u = _unit_rows(z)
    value, du = 0.0, np.zeros_like(u)
    for rows in _blocks(len(z)):
        g = (u[rows] @ u.T) / temperature
        g -= g.max(axis=1, keepdims=True)
        own = (np.arange(len(rows)), rows)
        pos = labels[rows, None] == labels[None, :]
        pos[own] = False
        e = np.exp(g)
        e[own] = 0.0
        p, total = pos.sum(axis=1), e.sum(axis=1) + 1e-12
        has = p > 0
        value -= (((g * pos).sum(axis=1) / np.maximum(p, 1) - np.log(total)) * has).sum()
        dg = (e / total[:, None] - pos / np.maximum(p, 1)[:, None]) * has[:, None]
        du[rows] += dg @ u
        du += dg.T @ u[rows]
    factor = temperature / base_temperature / max(len(z), 1)
    return float(value * factor), _through_norm(z, du * factor / temperature)


def ntxent_gradient(z: np.ndarray, labels: np.ndarray, temperature: float = 0.07) -> tuple[float, np.ndarray]:
    """V10 backward: the mean loss over ordered positive pairs (0 without any) and
    its gradient by the rows.  The similarity of two rows is the cosine of their
    rows of the Gram matrix, ``u_a (u'u) u_b`` over the norms, so neither the Gram
    matrix nor the similarities are held whole."""
    u = _unit_rows(z)
    c = u.T @ u
    h = u @ c
    square = np.maximum((h * u).sum(axis=1), 1e-24)
    norm = np.sqrt(square)
    value, pairs = 0.0, 0
    du, dc, dsquare = np.zeros_like(u), np.zeros_like(c), np.zeros(len(u))
    for rows in _blocks(len(z)):
        s = (h[rows] @ u.T) / (norm[rows, None] * norm[None, :])
        pos = labels[rows, None] == labels[None, :]
        e = np.exp((s - s.max(axis=1, keepdims=True)) / temperature)
        negative = ~pos
        pos[np.arange(len(rows)), rows] = False
        rest = (e * negative).sum(axis=1, keepdims=True)
        q = np.where(pos, e / (e + rest), 0.0)
        value -= float(np.log(q[pos]).sum())
        pairs += int(pos.sum())
        ds = np.where(pos, q - 1.0, 0.0) + negative * e * np.where(pos, 1.0 / (e + rest), 0.0).sum(axis=1, keepdims=True)
        dm = ds / (norm[rows, None] * norm[None, :])
        dsquare[rows] -= (ds * s).sum(axis=1) / (2 * square[rows])
        dsquare -= (ds * s).sum(axis=0) / (2 * square)
        du[rows] += dm @ h
        du += dm.T @ h[rows]
        dc += u[rows].T @ (dm @ u)
    if not pairs:
        return 0.0, np.zeros_like(z)
    du += 2 * dsquare[:, None] * h
    dc += (u * dsquare[:, None]).T @ u
    du += u @ (dc + dc.T)
    return value / pairs, _through_norm(z, du / (temperature * pairs))


def supcon_gradients(df: DataFrame, batch: str, key: str, vec: str, label: str, temperature: float = 0.07,
                     base_temperature: float = 0.07) -> DataFrame:
    """V9 backward per mini-batch: ``batch, key, loss, gradient, grad_norm`` of every row."""

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        loss, dz = supcon_gradient(np.vstack(pdf[vec].to_numpy()).astype(np.float64), pdf[label].to_numpy(), temperature, base_temperature)
        return pd.DataFrame({batch: pdf[batch].to_numpy(), key: pdf[key].to_numpy(), "loss": loss, "gradient": list(dz),
                             "grad_norm": np.sqrt((dz * dz).sum(axis=1))})

    schema = f"{batch} long, {key} long, loss double, gradient array<double>, grad_norm double"
    return df.select(batch, key, vec, label).groupBy(batch).applyInPandas(per_batch, schema)
