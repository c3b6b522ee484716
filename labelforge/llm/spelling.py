"""Spelling variants of the words of a corpus by reduced-alphabet generation.

Letters are hashed to a few symbols, so that a word becomes a reduced word.  Two
words that differ by one edit have reduced words that are equal or differ by
one edit.  Every word generates the full one-edit neighbourhood of its reduced
word over the small alphabet; the neighbours that are reduced words of the
vocabulary meet its words in an equality join, and the original strings decide.

Neighbours are made as 64-bit hashes from prefix hashes, a few array operations
for many words at a time, and pass a Bloom filter of the reduced vocabulary
before they are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import bloom
from labelforge.llm.common import documents, ship, small_batches, stored, utf8

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
#: A run is altered where this divides its hash.
NOISE = 31
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Neighbour hashes that a task makes at a time.
HELD_HASHES = 1 << 21

_LETTERS = "a-zÀ-ÿ"  # after A-Z are lowered
_BASE = 0x9E3779B97F4A7C15


def symbol_table(symbols: int) -> np.ndarray:
    """The symbol of each code point up to U+00FF."""
    return np.array([zlib.crc32(chr(c).encode()) % symbols for c in range(256)], np.uint64)


def observed_words(docs: DataFrame, min_letters: int = MIN_LETTERS, noise: int = NOISE) -> DataFrame:
    """``word, n`` per task: maximal letter runs of every whole text, A-Z lowered; of
    a run whose crc32 with the document's id is divisible by ``noise``, one letter
    is left out.  NULL text has none; a NULL id is written as ''."""
    shortest = re.compile(f"[{_LETTERS}]{{{min_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, max_bytes=8 << 20):
            total = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch), strict=True):
                runs = shortest.findall(text.lower().decode(errors="replace"))  # bytes.lower changes A-Z only
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = Counter(runs)
                for w in list(found):
                    h = zlib.crc32(w.encode(), seed)
                    if h % noise == 0:
                        n, at = found.pop(w), h % len(w)
                        if len(w) > min_letters:
                            total[w[:at] + w[at + 1:]] += n
                total.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return documents(docs, "doc_id", "text").select("doc_id", "text").mapInArrow(run, "word string, n bigint")


def vocabulary(spark: SparkSession, words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that occur ``min_count`` times or more, stored."""
    return stored(spark, words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "vocabulary")


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    """Spreads a polynomial hash of ``length`` symbols over all 64 bits."""
    h = h + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


class Reduced:
    """Words of one length as a matrix of symbols (from 1), with the hashes of all prefixes."""

    def __init__(self, words: list[bytes], table: np.ndarray):
        self.m = len(words[0])
        self.symbols = (table + np.uint64(1))[np.frombuffer(b"".join(words), np.uint8).reshape(-1, self.m)]
        base = np.uint64(_BASE)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.m + 1, base)]), dtype=np.uint64)
        self.prefix = np.zeros((len(words), self.m + 1), np.uint64)
        for i in range(self.m):
            self.prefix[:, i + 1] = self.prefix[:, i] * base + self.symbols[:, i]

    def keys(self) -> np.ndarray:
        return _mixed(self.prefix[:, -1], self.m)

    def neighbours(self, start: int, stop: int, symbols: int) -> Iterator[np.ndarray]:
        """Hashes of the words with one deletion, replacement (the word itself among
        them) or insertion at the places ``start`` to ``stop`` (not included)."""
        whole, m = self.prefix[:, -1:], self.m
        every = np.arange(1, symbols + 1, dtype=np.uint64)
        at = np.arange(start, min(stop, m))
        if len(at):
            before, letter = self.prefix[:, at], self.symbols[:, at]
            after = whole - self.prefix[:, at + 1] * self.power[m - 1 - at]
            yield _mixed(before * self.power[m - 1 - at] + after, m - 1)
            change = (every - letter[:, :, None]) * self.power[m - 1 - at][:, None]
            yield _mixed(whole[:, :, None] + change, m).reshape(len(whole), -1)
        at = np.arange(start, min(stop, m + 1))
        before = self.prefix[:, at]
        after = whole - before * self.power[m - at]
        put = (before * self.power[m - at + 1] + after)[:, :, None] + every * self.power[m - at][:, None]
        yield _mixed(put, m + 1).reshape(len(whole), -1)


def _by_length(words: list[str], symbols: int) -> Iterator[np.ndarray]:
    """Places of words of equal length, few enough for ``HELD_HASHES`` (one at least)."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(same):
            step = max(1, HELD_HASHES // int(2 * symbols * (sizes[same[0]] + 1)))
            for k in range(0, len(same), step):
                yield same[k:k + step]


def reduced_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``key, word, n``: the hash of each word's reduced word."""
    table = symbol_table(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "word"):
            words = batch.column("word").to_pylist()
            keys = np.zeros(len(words), np.uint64)
            for same in _by_length(words, symbols):
                keys[same] = Reduced([words[i].encode("latin-1") for i in same], table).keys()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], names=["key", "word", "n"])

    return vocab.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


def neighbourhoods(vocab: DataFrame, held, symbols: int = SYMBOLS) -> DataFrame:
    """``key, word, n``: the distinct neighbours of each word's reduced word that the filter lets through."""
    table = symbol_table(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "word"):
            words = batch.column("word").to_pylist()
            rows, keys = [], []
            for same in _by_length(words, symbols):
                reduced = Reduced([words[i].encode("latin-1") for i in same], table)
                step = max(1, HELD_HASHES // (2 * symbols * len(same)))
                mine = []
                for start in range(0, reduced.m + 1, step):
                    for made in reduced.neighbours(start, start + step, symbols):
                        row, column = np.nonzero(bloom.contains(held.value, made.reshape(-1)).reshape(made.shape))
                        mine.append(np.stack([same[row].astype(np.uint64), made[row, column]]))
                both = np.concatenate(mine, axis=1)
                both = both[:, np.lexsort(both)]
                both = both[:, np.concatenate([[True], (np.diff(both, axis=1) != 0).any(axis=0)])]
                rows.append(both[0].astype(np.int64))
                keys.append(both[1])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column("word").take(at), batch.column("n").take(at)],
                                             names=["key", "word", "n"])

    return vocab.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


def near_words(spark: SparkSession, vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, other, other_n``: every ordered pair of words that differ by exactly
    one inserted, deleted or replaced code point, once."""
    reduced = stored(spark, reduced_words(vocab, symbols), "reduced-words")
    held = spark.sparkContext.broadcast(bloom.build(reduced, "key", max(1, reduced.count())))
    around = neighbourhoods(vocab, held, symbols)
    return (around.join(reduced.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key")
            .where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """``word, root`` for the ``word, form`` rows: forms followed to the last one.  A
    form's count is ``RATIO`` times the word's or more, so chains are short and end;
    each round doubles the steps taken."""
    now = stored(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(spark, now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").limit(1).count() == 0:
            return now


def variants(spark: SparkSession, words: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the counted words (``word, n``,
    repeats are added up) that occur ``min_count`` times or more.

    A word's form is its near word with the largest count (ties: the smallest in
    code-point order), if that is ``ratio`` times its own or more; the root
    follows the forms to the last.  Words hold code points up to U+00FF.  NULL
    words are left out; no words give no rows; other columns are left behind."""
    ship(spark)
    vocab = vocabulary(spark, words.where(F.col("word").isNotNull()), min_count)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = stored(spark, near_words(spark, vocab, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near-words")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.other"))
    found = stored(spark, vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    last = roots(spark, found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
