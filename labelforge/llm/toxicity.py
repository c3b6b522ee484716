"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: accents, homoglyphs, digit substitutions and invisible
characters.  Lexicon entries (words and word beginnings) are learned from labelled
documents and weighted by their log rate ratio; hits inside an exception phrase do not count; the weight of the hits
is normalised by the length and calibrated to a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, fold, label_sample, ship, small_batches, stored

#: Bounds: labelled rows of the training sample, entries of the lexicon.
TRAIN_ROWS = 10_000
MAX_LEXICON = 1_000
#: Least z-score, log rate ratio and toxic documents of an entry.
MIN_Z = 5.0
MIN_WEIGHT = 1.0
MIN_DOCUMENTS = 3
MAX_WEIGHT = 8.0
#: Lengths of the word beginnings that may become entries.
PREFIX = (4, 8)

#: Look-alike letters of other scripts, digits for letters, and invisible characters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "i", "ʏ": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "p",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("class clown", "clown fish", "circus clown", "trash can", "trash bin", "trash bag")


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if base != chr(c):
            table[c] = base
    for k, v in HOMOGLYPHS.items():
        table[ord(k)] = v
        if len(k.upper()) == 1:
            table[ord(k.upper())] = v
    table |= {c: None for c in [*map(ord, INVISIBLE), *range(0x300, 0x370)]}
    return table


_FOLD = _fold_table()
#: l, 1 and | all look like i.
_DIGIT = str.maketrans(DIGITS | {"l": "i", "|": "i"})
_INNER = re.compile(r"(?<=[a-z])[@$](?=[a-z])")
_WORD = re.compile(r"[^\W_]+")


def fold_text(text: str | None) -> str:
    """Lower case without accents, homoglyphs, invisible characters or digit substitutions."""
    text = text or ""
    if not text.isascii():
        text = text.translate(_FOLD)
    text = text.lower()
    if "@" in text or "$" in text:
        text = _INNER.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.translate(_DIGIT)


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    weights: tuple[float, float, float]

    def matcher(self) -> Matcher:
        return Matcher(self.lexicon, self.exceptions)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.weights[:2]) + self.weights[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Matcher:
    """All lexicon entries and exception phrases in one pass over a folded text."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            folded = " ".join(fold_text(phrase).split())
            self.automaton.add_word(folded, (len(folded), 0.0, None))
        for entry, weight in lexicon.items():
            stem = entry.rstrip("*")
            if self.automaton.get(stem, (0, 0.0, ""))[1] < weight:
                self.automaton.add_word(stem, (len(stem), weight, entry))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(first, end, entry, weight) of the hits at word starts (and ends, unless
        the entry is a beginning) outside exception phrases, by place in the folded text."""
        if not len(self.automaton):
            return []
        found, spared = [], []
        for last, (n, weight, word) in self.automaton.iter(folded):
            first, end = last - n + 1, last + 1
            if first and folded[first - 1].isalnum() or end < len(folded) and folded[end].isalnum() and not (word or "").endswith("*"):
                continue
            (found if word is not None else spared).append((first, end, word, weight))
        best: dict[int, tuple[int, int, str, float]] = {}
        for h in found:  # the weightiest entry at each word
            if (h[0] not in best or best[h[0]][3] < h[3]) and not any(a <= h[0] and h[1] <= b for a, b, _, _ in spared):
                best[h[0]] = h
        return list(best.values())

    def measures(self, text: str | None) -> tuple[float, float]:
        """Log weight of the hits, and log weight for each hundred words."""
        folded = fold_text(text)
        total = sum(h[3] for h in self.hits(folded))
        return (np.log1p(total), np.log1p(100 * total / max(folded.count(" ") + folded.count("\n") + 1, 1))) if total else (0.0, 0.0)


def learn_lexicon(spark: SparkSession, sample: DataFrame, size: int = MAX_LEXICON, min_z: float = MIN_Z, min_weight: float = MIN_WEIGHT, min_documents: int = MIN_DOCUMENTS) -> dict[str, float]:
    """At most ``size`` entries: folded words, or beginnings of words marked by a
    ``*``, weighted by the log ratio of their rates in toxic and other texts.

    An entry's toxic documents must exceed their expectation by ``min_z`` (the
    signed root of the likelihood ratio) and number at least ``min_documents``,
    however common other entries are.  A shorter beginning enters beside a longer
    one only if it brings further toxic documents."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            documents_, words_ = (Counter(), Counter()), (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own: Counter[str] = Counter()
                for word, k in Counter(_WORD.findall(fold_text(text))).items():
                    own[""] += k  # the empty entry counts the documents and their words
                    own[word] += k
                    for n in range(PREFIX[0], min(PREFIX[1] + 1, len(word))):
                        own[word[:n] + "*"] += k
                documents_[bool(label)].update(own.keys())
                words_[bool(label)].update(own)
            for at in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(documents_[at]), pa.string()), pa.array(list(documents_[at].values()), pa.int64()),
                     pa.array([words_[at][e] for e in documents_[at]], pa.int64()), pa.array([at] * len(documents_[at]), pa.int32())], names=["entry", "d", "t", "label"])

    counted = (sample.mapInArrow(entries, "entry string, d bigint, t bigint, label int").groupBy("entry")
               .agg(*(F.sum(F.when(F.col("label") == at, F.col(x)).otherwise(0)).alias(name) for name, x, at in (("a", "d", 1), ("b", "d", 0), ("ta", "t", 1), ("tb", "t", 0)))))
    counts = stored(spark, counted.where((F.col("a") >= min_documents) | (F.col("entry") == "")), "lexicon-counts")
    total = counts.where("entry = ''").first()
    if not total or not total.a or not total.b:
        return {}

    def part(seen: Column, of: int, row: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * (total.a + total.b) / (row * of))).otherwise(0.0)

    have = F.col("a") + F.col("b")
    lack = F.lit(total.a + total.b) - have
    ratio = 2 * (part(F.col("a"), total.a, have) + part(F.col("b"), total.b, have) + part(total.a - F.col("a"), total.a, lack) + part(total.b - F.col("b"), total.b, lack))
    weight = F.log((F.col("ta") + 0.5) / total.ta) - F.log((F.col("tb") + 0.5) / total.tb)
    ranked = (counts.where("entry <> ''").withColumn("g", ratio).withColumn("weight", weight)
              .where((F.col("g") >= min_z**2) & (F.col("weight") >= min_weight)).orderBy(F.desc(F.round("g", 6)), F.desc(F.length("entry")), "entry").limit(size).collect())
    lexicon: dict[str, float] = {}
    documents_of: dict[str, int] = {}
    for r in ranked:
        stem = r.entry.rstrip("*")
        if not any(x.startswith(stem) and r.a <= 1.05 * n for x, n in documents_of.items()):
            lexicon[r.entry] = min(r.weight, MAX_WEIGHT)
            documents_of[stem] = r.a
    return lexicon


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_fold: Column, rows: int = TRAIN_ROWS,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon and calibration from at most about ``rows`` labelled training rows."""
    ship(spark)
    sample = stored(spark, label_sample(spark, docs, labels, "toxic", train_fold, rows)[0].select("text", "label"), "toxic-sample")
    lexicon = learn_lexicon(spark, sample)
    matcher_of = Model(lexicon, exceptions, (0.0, 0.0, 0.0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of.matcher()
        for batch in batches:
            x = np.array([matcher.measures(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("label")], names=["x0", "x1", "label"])

    rows_ = sample.mapInArrow(measured, "x0 double, x1 double, label int").toArrow()
    x = np.stack([rows_.column("x0").to_numpy(), rows_.column("x1").to_numpy()], axis=1)
    y = rows_.column("label").to_numpy().astype(float)
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    return Model(lexicon, exceptions, calibrate(x[order], y[order]))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Two slopes (not negative) and an intercept of a ridge logistic fit by
    Newton's method; without both classes, the labels' share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0, float(np.log(share / (1 - share)))
    use = np.array([True, True, True])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(2):
        theta = np.zeros(3)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            grad = design.T @ (p - y) + ridge * theta
            hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(3)
            step = np.zeros(3)
            step[use] = np.linalg.solve(hess[np.ix_(use, use)], grad[use])
            theta -= step
            if np.abs(step).max() < 1e-9:
                break
        if (theta[:2] >= 0).all():
            break
        use[:2] &= theta[:2] >= 0
        theta[~use] = 0
    return float(max(theta[0], 0)), float(max(theta[1], 0)), float(theta[2])


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, cut: float = 0.3) -> DataFrame:
    """``row, doc_id, held_out, score, predicted, hits`` for every row of ``docs``.

    ``hits`` lists the folded lexicon words found.  Labels are learned only
    from rows outside the held-out fold; a NULL id is in neither.  NULL and
    empty texts have no hit; repeated rows score alike; an empty table gives an
    empty result."""
    model = train(spark, docs, labels, F.col("doc_id").isNotNull() & ~fold(modulus, remainder))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([matcher.measures(t) for t in texts], float).reshape(-1, 2)
            hits = [sorted({h[2] for h in matcher.hits(fold_text(t))}) if a else [] for t, a in zip(texts, x[:, 0], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(model.score(x)), pa.array(hits, pa.list_(pa.string()))],
                                             names=["row", "doc_id", "score", "hits"])

    return (documents(docs, "doc_id", "text").mapInArrow(score, "row bigint, doc_id bigint, score double, hits array<string>")
            .select("row", "doc_id", fold(modulus, remainder).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "hits"))
