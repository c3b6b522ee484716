"""Language ID by a linear-chain conditional random field over words.

Each word's potentials come from hashed character n-grams with word boundaries
(affixes among them) and from a lexicon of the training words; learned
transitions tie neighbouring words.  Forward-backward gives every word its
posterior over languages, also in code-switched text; a document's language
has the largest share of posterior mass by letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import column_or_null, documents, fold, hash_sample, ship, small_batches

#: Bounds of the training sample: documents, and words in the run taken from each.
TRAIN_ROWS = 4_000
RUN_WORDS = 60
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Words whose potentials a task keeps.
CACHE_WORDS = 1 << 18
STEPS = 60
_WORDS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, lower-cased; NULL has none."""
    return _WORDS.findall(text.lower()) if text else []


def hashed_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every character n-gram of every bounded word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.cumsum(codes == 2) - 1
    buckets, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + codes[j:len(codes) - n + 1 + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        whole = of[:len(codes) - n + 1] == of[n - 1:]
        if n == 1:
            whole &= codes > 3
        buckets.append((h >> np.uint64(48)).astype(np.int64)[whole] % BUCKETS)
        owners.append(of[:len(codes) - n + 1][whole])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Chains:
    """Sequences laid out by time step, longest first, so that each step of the
    recursions is one array operation over the sequences still running."""

    order: np.ndarray = field(init=False)  # token in its sequence's order -> place by step
    offsets: np.ndarray = field(init=False)
    lengths: list[int]

    def __post_init__(self) -> None:
        lengths = np.asarray(self.lengths, np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[by_length]
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = np.repeat(starts[by_length], sizes) + step
        self.order = token[np.argsort(step, kind="stable")]
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(step))]).astype(np.int64) if len(step) else np.zeros(1, np.int64)


def forward_backward(potentials: np.ndarray, transitions: np.ndarray, chains: Chains, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of every token, expected transitions and log partition sum."""
    k = potentials.shape[1]
    if not len(potentials):
        return potentials, np.zeros((k, k)), 0.0
    top = potentials.max(axis=1, keepdims=True)
    psi = np.exp(potentials - top)[chains.order]
    move = np.exp(transitions - transitions.max())
    at = chains.offsets
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    scale = np.empty(len(psi))
    steps = len(at) - 1
    for t in range(steps):
        s, e = at[t], at[t + 1]
        a = psi[s:e] if t == 0 else (alpha[at[t - 1]:at[t - 1] + e - s] @ move) * psi[s:e]
        total = a.sum(axis=1)
        alpha[s:e] = a / total[:, None]
        scale[s:e] = total
    for t in range(steps - 2, -1, -1):
        s, n = at[t], at[t + 2] - at[t + 1]
        b = (psi[at[t + 1]:at[t + 2]] * beta[at[t + 1]:at[t + 2]]) @ move.T
        beta[s:s + n] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    expected = np.zeros((k, k))
    if pairs:
        for t in range(1, steps):
            s, e = at[t], at[t + 1]
            joint = alpha[at[t - 1]:at[t - 1] + e - s, :, None] * move[None] * (psi[s:e] * beta[s:e])[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    out = np.empty_like(post)
    out[chains.order] = post
    moved = len(psi) - (at[1] if steps else 0)
    return out, expected, float(np.log(scale).sum() + top.sum() + moved * transitions.max())


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # bucket x language
    lexicon: dict[str, int]
    rates: np.ndarray  # lexicon word x language: log share of the word's uses; last row: no entry
    lexicon_weights: np.ndarray  # language x language
    bias: np.ndarray
    transitions: np.ndarray

    def potentials(self, words: list[str]) -> np.ndarray:
        k = len(self.languages)
        if not words:
            return np.zeros((0, k))
        bucket, of = hashed_grams(words)
        norm = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=len(words)), 1))
        out = np.stack([np.bincount(of, self.grams[bucket, j], minlength=len(words)) for j in range(k)], axis=1) * norm[:, None]
        entry = np.array([self.lexicon.get(w, len(self.lexicon)) for w in words])
        return out + self.rates[entry] @ self.lexicon_weights + self.bias


def fit(runs: list[tuple[str, list[str]]], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Model:
    """Maximum conditional likelihood (Adam) on sequences spliced from runs of
    words of differently labelled documents, so that switches are seen."""
    languages = sorted({lang for lang, words in runs if words})
    k, place = len(languages), {lang: i for i, lang in enumerate(languages)}
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    runs = [runs[i] for i in rng.permutation(len(runs)) if runs[i][1]]
    lengths, tokens, gold = [0], [], []
    for lang, words in runs:
        if lengths[-1] >= 3 * RUN_WORDS:
            lengths.append(0)
        lengths[-1] += len(words)
        tokens += words
        gold += [place[lang]] * len(words)
    gold_ = np.array(gold)
    uses = Counter(zip(tokens, gold, strict=True))
    totals = Counter(tokens)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in totals.items() if n >= 5))}
    rates = np.zeros((len(lexicon) + 1, k))
    for w, i in lexicon.items():
        share = np.array([uses[w, j] + 0.5 for j in range(k)])
        rates[i] = np.log(share / share.sum() * k)
    unique = sorted(totals)
    number = {w: i for i, w in enumerate(unique)}
    token = np.array([number[w] for w in tokens])
    bucket, of = hashed_grams(unique)
    value = (1 / np.sqrt(np.maximum(np.bincount(of, minlength=len(unique)), 1)))[of]
    entry = np.array([lexicon.get(w, len(lexicon)) for w in unique])
    chains = Chains(lengths)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(token), bool)
    inner[starts] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold_[np.flatnonzero(inner) - 1], gold_[inner]), 1)
    theta = [np.zeros((BUCKETS, k)), np.eye(k) * 0.1, np.zeros(k), np.zeros((k, k))]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    n = len(token)
    for t in range(1, steps + 1):
        emit = np.stack([np.bincount(of, theta[0][bucket, j] * value, minlength=len(unique)) for j in range(k)], axis=1) + rates[entry] @ theta[1] + theta[2]
        post, moves, _ = forward_backward(emit[token], theta[3], chains, pairs=True)
        post[np.arange(n), gold_] -= 1
        by_word = np.stack([np.bincount(token, post[:, j], minlength=len(unique)) for j in range(k)], axis=1) / n
        grads = [np.stack([np.bincount(bucket, by_word[of, j] * value, minlength=BUCKETS) for j in range(k)], axis=1) + decay / n * theta[0],
                 rates[entry].T @ by_word, by_word.sum(axis=0), (moves - seen) / n]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-6)
    return Model(languages, theta[0].astype(np.float32), lexicon, rates, theta[1], theta[2], theta[3])


def train(spark: SparkSession, docs: DataFrame, train_fold: Column, rows: int = TRAIN_ROWS, run_words: int = RUN_WORDS) -> Model:
    """Fit on one run of ``run_words`` words from each of about ``rows`` documents
    with a language, at a place that a hash of the text picks."""
    ship(spark)
    known = (docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"), column_or_null(docs, "lang", "string").alias("lang"))
             .where(F.col("lang").isNotNull() & train_fold))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                words = words_of(text)
                start = at % max(1, len(words) - run_words + 1)
                found.append(words[start:start + run_words])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.list_(pa.string()))], names=["lang", "words"])

    sample = hash_sample(known, rows, 3).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("at")).mapInArrow(runs, "lang string, words array<string>").toArrow()
    return fit(sorted(zip(sample.column("lang").to_pylist(), sample.column("words").to_pylist(), strict=True)))


def label_words(texts: list[list[str]], model: Model, cache: dict[str, int], table: list[np.ndarray]) -> list[np.ndarray]:
    """Posterior of every word of every text; ``cache`` and ``table`` hold the
    potentials of the words met so far."""
    flat = [w for words in texts for w in words]
    fresh = [w for w in dict.fromkeys(flat) if w not in cache]
    if len(cache) + len(fresh) > CACHE_WORDS:
        cache.clear()
        table.clear()
        fresh = list(dict.fromkeys(flat))
    if fresh:
        base = sum(map(len, table))
        cache.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        table.append(model.potentials(fresh))
        table[:] = [np.concatenate(table)]
    lengths = [len(w) for w in texts]
    which = np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat))
    emit = table[0][which] if len(flat) else np.zeros((0, len(model.languages)))
    post, _, _ = forward_backward(emit, model.transitions, Chains([n for n in lengths if n]))
    return np.split(post, np.cumsum(lengths)[:-1]) if lengths else []


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``row, doc_id, lang_pred, score, spans`` for every row of ``docs``.

    ``spans`` lists the runs of words of one language as (first word, end word,
    language).  NULL text and text without a letter give ``und``, score 0 and no
    span; ties go to the first language by name; repeated rows are treated
    alike; without any labelled document everything is ``und``."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, table = shared.value, {}, []
        for batch in small_batches(batches, max_bytes=4 << 20):
            texts = [words_of(t) if model.languages else [] for t in batch.column("text").to_pylist()]
            langs, scores, spans = [], [], []
            for words, post in zip(texts, label_words(texts, model, cache, table), strict=True):
                if not words:
                    langs.append(UNDETERMINED), scores.append(0.0), spans.append([])
                    continue
                weight = np.array([len(w) for w in words], float)
                share = weight @ post / weight.sum()
                langs.append(model.languages[int(share.argmax())]), scores.append(float(min(share.max(), 1.0)))
                best = post.argmax(axis=1)
                turn = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
                spans.append([{"first": int(a), "end": int(b), "lang": model.languages[best[a]]} for a, b in zip(turn, turn[1:], strict=False)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))],
                names=["row", "doc_id", "lang_pred", "score", "spans"])

    return documents(docs, "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, lang_pred string, score double, spans array<struct<first: int, end: int, lang: string>>")


def identify(spark: SparkSession, docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Train outside the held-out fold of crc32(doc_id as text) and predict every
    row: ``row, doc_id, held_out, lang_pred, score, spans``."""
    model = train(spark, docs, F.col("doc_id").isNotNull() & ~fold(modulus, remainder))
    return predict(spark, docs, model).withColumn("held_out", fold(modulus, remainder))
