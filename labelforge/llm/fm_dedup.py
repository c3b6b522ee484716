"""Substring deduplication with a compressed FM-index per shard.

Equal windows of ``min_words`` words share their minimizer, the least hashed
word gram inside the window.  Runs of windows with one minimizer are cut out of
the documents as segments and sent to a shard by that minimizer, so every
window meets all its equals in one shard.  Segments whose minimizer occurs in
a single document cannot repeat and stay behind.  A shard keeps the distinct segments with the smallest
document of each, builds an FM-index over them (wavelet matrix over the
Burrows-Wheeler transform) and streams the segments against it: backward search
gives each window's match interval, and the interval's smallest document is the
window's owner.  A window is a repeat where its owner is smaller than the
document it stands in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, numbered, ship, small_batches, stored, utf8

MIN_WORDS = 13
GRAM_WORDS = 4
#: Words that one shard's index holds, about.
SHARD_WORDS = 1 << 18
#: Documents, and windows in all of them, of one minimizer above which its
#: segments are routed as single windows, each by its own words.
HOT_DOCUMENTS = 2048
HOT_WINDOWS = 1 << 14
#: Distinct segments that a task holds before it passes them on.
HELD_SEGMENTS = 1 << 16
#: Bits of the filter of shared minimizers: 16 for each, within these bounds.  A
#: fuller filter only lets more segments through.
FILTER_BITS = (1 << 16, 1 << 27)
NO_OWNER = np.iinfo(np.int64).max
#: Bytes of words that are hashed at a time.
HASHED_BYTES = 1 << 18
HASH_BASE = 0x9E3779B97F4A7C15
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


class Words(NamedTuple):
    """Words of some texts in a row, each followed by one space."""

    data: bytes
    #: First byte of each word, and the number of bytes.
    bounds: np.ndarray
    #: Number of words before each text, and of all.
    first: np.ndarray

    def pieces(self, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """Words ``start`` to ``stop`` (not included), joined by one space."""
        return [self.data[a:b] for a, b in zip(self.bounds[start].tolist(), (self.bounds[stop] - 1).tolist(), strict=True)]


def spaced(text: bytes) -> bytes:
    """The words of a text, each followed by one space."""
    text = text.translate(BLANKS).strip(b" ")
    if b"  " in text:
        text = b" ".join(text.split())
    return text + b" " if text else text


def words_of(rows: list[bytes]) -> Words:
    """Words of texts from ``spaced``."""
    data = b"".join(rows)
    bounds = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == ord(" ")) + 1)
    return Words(data, bounds, np.searchsorted(bounds, np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, at least, of the hash base and of its inverse modulo 2^64."""
    if n > len(_POWERS[0]):
        for k, base in enumerate((HASH_BASE, pow(HASH_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))
    return _POWERS


def word_hashes(words: Words) -> np.ndarray:
    """A polynomial hash of each word modulo 2^64: equal words have equal hashes."""
    data, bounds = np.frombuffer(words.data, np.uint8), words.bounds
    out, i = np.empty(len(bounds) - 1, np.uint64), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + HASHED_BYTES, side="right")) - 1)
        begin, end = int(bounds[i]), int(bounds[j])
        up, down = _powers(end - begin)
        at = bounds[i:j] - begin
        out[i:j] = np.add.reduceat(data[begin:end] * up[:end - begin], at) * down[at]
        i = j
    return out


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each window of ``width`` values."""
    least, span = values, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    offset = np.zeros(len(least), np.int32)
    for k in range(width - 1, -1, -1):
        np.copyto(offset, k, where=values[k:k + len(least)] == least)
    return offset + np.arange(len(least))


class WaveletMatrix:
    """Rank over a sequence of symbols: one bit plane per symbol bit, each packed
    in 64-bit words with running counts."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[:len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.planes.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(len(bits) - int(bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.first = np.zeros(size, np.int64)
        self.first = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.planes[k][word] & below)
            i = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self._descend(symbol, i) - self.first[symbol]


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols; the suffixes are
    sorted by that many symbols, which is all that such searches look at."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n, rank, span = len(text), text.astype(np.int64), 1
        while span < depth:
            after = np.zeros(n, np.int64)
            after[:n - span] = rank[span:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].reshape(-1)
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.bwt = WaveletMatrix(text[self.suffixes - 1], size)

    def intervals(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) that match ``length`` symbols of ``text``, the
        indexed one, from each start.  Where a window's last symbols occur once, its
        only match is its own place, and the search ends there."""
        last = text[starts + length - 1]
        low, high = self.before[last], self.before[last + 1]
        live = np.flatnonzero(high - low > 1)
        for j in range(length - 2, -1, -1):
            symbol = text[starts[live] + j]
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
            live = live[high[live] - low[live] > 1]
        place = np.empty(len(self.suffixes), np.int64)
        place[self.suffixes] = np.arange(len(place))
        alone = high - low == 1
        low[alone] = place[starts[alone]]
        high[alone] = low[alone] + 1
        return low, high


def window_owners(segments: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest owner of a segment that contains it for each window of ``length`` words,
    segment by segment; number of windows of each segment)."""
    words = words_of([s + b" " for s in segments])
    n = len(words.bounds) - 1
    names = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(words.bounds), pa.py_buffer(words.data)]).dictionary_encode()
    sizes = np.diff(words.first)
    place = np.arange(len(segments))
    text = np.zeros(n + len(segments), np.int64)  # 0 ends a segment
    text[np.arange(n) + np.repeat(place, sizes)] = names.indices.to_numpy() + 1
    counts = sizes - length + 1
    windows = np.arange(counts.sum()) + np.repeat(words.first[:-1] + place - np.cumsum(counts) + counts, counts)
    index = FMIndex(text, len(names.dictionary) + 1, length)
    holder = np.repeat(place, sizes + 1)
    low, high = index.intervals(text, windows, length)
    at, which = np.unique(low, return_inverse=True)
    upto = np.zeros(len(at), np.int64)
    upto[which] = high
    own = np.append(owners[holder[index.suffixes]], NO_OWNER)
    least = np.minimum.reduceat(own, np.stack([at, upto], axis=1).reshape(-1))[::2]
    return least[which.reshape(-1)], counts


def segments_of(texts: list[bytes], min_words: int, gram_words: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, and the segments' text number, first word, number of windows and minimizer."""
    words = words_of([spaced(t) for t in texts])
    sizes = np.diff(words.first)
    n, none = len(words.bounds) - 1, np.zeros(0, np.int64)
    if n < min_words:
        return words, none, none, none, none
    hashes = word_hashes(words)
    grams = np.zeros(n - gram_words + 1, np.uint64)
    for j in range(gram_words):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j:n - gram_words + 1 + j]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[:n - min_words + 1] == owner[min_words - 1:]
    lowest = _least_places(grams, min_words - gram_words + 1)
    at = np.flatnonzero(whole)
    if not len(at):
        return words, none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(lowest[at]) != 0)]))
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    text = owner[start]
    return words, text, start - words.first[text], count, grams[lowest[start]].view(np.int64)


def _bit_filter(minimizers: DataFrame, bits: int) -> np.ndarray:
    """Bit filter of a column ``gram``; its size is bounded by FILTER_BITS, so it
    may be collected and broadcast."""
    place = F.pmod("gram", F.lit(bits))
    filled = (minimizers.groupBy(F.floor(place / 64).alias("word"))
              .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(gram, {bits}) % 64 as int))")).alias("mask")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[filled.column("word").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    return out


def _has(masks: np.ndarray, gram: np.ndarray) -> np.ndarray:
    place = gram % (len(masks) * 64)
    return (masks[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def minimizer_filters(spark: SparkSession, docs: DataFrame, min_words: int, gram_words: int, hot_documents: int,
                      hot_windows: int = HOT_WINDOWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters of the minimizers that occur in two documents or more, and of those
    in more than ``hot_documents`` documents or ``hot_windows`` windows (a document
    may repeat one many times), and the number of words that their segments hold."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            _, text, _, count, gram = segments_of(utf8(batch), min_words, gram_words)
            order = np.lexsort((gram, text))
            text, gram, count = text[order], gram[order], count[order]
            new = np.ones(len(gram), bool)
            new[1:] = (np.diff(text) != 0) | (np.diff(gram) != 0)
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(np.diff(np.append(at, len(gram)))),
                                              pa.array(np.add.reduceat(count, at) if len(at) else count)], names=["gram", "segments", "windows"])

    found = (docs.select("text").mapInArrow(grams, "gram bigint, segments bigint, windows bigint").groupBy("gram")
             .agg(F.count("*").alias("documents"), F.sum("segments").alias("segments"), F.sum("windows").alias("windows")).where("documents > 1"))
    hot = (F.col("documents") > hot_documents) | (F.col("windows") > hot_windows)
    shared = stored(spark, found.select("gram", hot.alias("hot"), F.when(hot, F.col("windows") * min_words)
                                        .otherwise(F.col("windows") + F.col("segments") * (min_words - 1)).alias("words")), "shared-minimizers")
    n, held = shared.agg(F.count("*"), F.sum("words")).first()
    bits = FILTER_BITS[0]
    while bits < min(16 * n, FILTER_BITS[1]):
        bits *= 2
    return _bit_filter(shared, bits), _bit_filter(shared.where("hot"), bits), held or 0


def shared_segments(texts: list[bytes], shared: np.ndarray, hot: np.ndarray, min_words: int,
                    gram_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Text number, first word, route and words of each segment with a shared
    minimizer; those with a hot one window by window."""
    words, text, start, count, gram = segments_of(texts, min_words, gram_words)
    live = np.flatnonzero(_has(shared, gram))
    wide = _has(hot, gram[live])
    times = np.where(wide, count[live], 1)
    each, wide = np.repeat(live, times), np.repeat(wide, times)
    start = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    text, route = text[each], gram[each]
    at = words.first[text] + start
    pieces = words.pieces(at, at + min_words - 1 + np.where(wide, 1, count[each]))
    for k in np.flatnonzero(wide).tolist():
        route[k] = xxhash.xxh64_intdigest(pieces[k]) >> 1
    return text, start, route, pieces


def removed_words(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS,
                  shard_words: int = SHARD_WORDS, hot_documents: int = HOT_DOCUMENTS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """``row, doc_id, n_words, n_removed, kept_sha256, kept_text, intervals`` for every row.

    A word is removed if a window of ``min_words`` words covers it whose word
    sequence also starts in a document with a smaller doc_id.  ``intervals``
    lists the removed [first, last) words; ``kept_text`` (words joined by one
    space) is NULL where nothing is removed.  NULL, empty and short texts have
    no window; a NULL id is neither smaller nor larger than any other; rows
    that repeat an id are no repeats of each other.  Memory grows with the
    longest document and the shard size, not with the corpus.

    The numbered documents are written once and read four times (minimizers,
    segments, places, result): cheaper in disk than to keep the segments, which overlap.  Between distinct
    segments and their places a 128-bit digest stands for the words.
    """
    ship(spark)
    base = documents(numbered(spark, docs, "doc_id", "text"), "doc_id", "text")
    masks, hot, held = minimizer_filters(spark, base, min_words, gram_words, hot_documents, hot_windows)
    shards = int(held // shard_words) + 1
    filters = spark.sparkContext.broadcast((masks, hot))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*held.values(), strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(list(held), pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                              names=["shard", "segment", "owner", "latest"])

        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_pylist()
            text, _, route, pieces = shared_segments(utf8(batch), *filters.value, min_words, gram_words)
            for t, shard, piece in zip(text.tolist(), (route % shards).tolist(), pieces, strict=True):
                i, seen = ids[t], held.get(piece)
                if seen is None:
                    seen = held[piece] = [shard, NO_OWNER, -NO_OWNER]
                if i is not None:
                    seen[1], seen[2] = i if i < seen[1] else seen[1], i if i > seen[2] else seen[2]
            if len(held) > HELD_SEGMENTS:
                yield out()
                held.clear()
        yield out()

    def index(shard: pa.Table) -> pa.Table:
        merged = shard.group_by("segment", use_threads=False).aggregate([("owner", "min"), ("latest", "max")])
        pieces = merged.column("segment").to_numpy().tolist()
        latest = merged.column("latest_max").to_numpy()
        found, counts = window_owners(pieces, merged.column("owner_min").to_numpy(), min_words)
        first = np.cumsum(counts) - counts
        new = np.append(True, np.diff(found) != 0)
        new[first] = True
        at = np.flatnonzero(new)  # runs of windows of one owner
        holder = np.searchsorted(first, at, side="right") - 1
        n = np.diff(np.append(at, len(found)))
        some = found[at] < latest[holder]
        at, holder, n = at[some], holder[some], n[some]
        live = np.unique(holder)
        runs = pa.StructArray.from_arrays([pa.array(at - first[holder]), pa.array(n), pa.array(found[at])], names=["at", "n", "owner"])
        return pa.table({"digest": pa.array([xxhash.xxh3_128_digest(pieces[i]) for i in live.tolist()], pa.binary()),
                         "runs": pa.ListArray.from_arrays(pa.array(np.searchsorted(holder, np.append(live, len(pieces))), pa.int32()), runs)})

    owned = stored(spark, base.select("doc_id", "text").mapInArrow(distinct, "shard int, segment binary, owner bigint, latest bigint")
                   .groupBy("shard").applyInArrow(index, "digest binary, runs array<struct<at bigint, n bigint, owner bigint>>"), "window-owners")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            text, start, _, pieces = shared_segments(utf8(batch), *filters.value, min_words, gram_words)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(start),
                                              pa.array([xxhash.xxh3_128_digest(p) for p in pieces], pa.binary())], names=["row", "doc_id", "start", "digest"])

    repeats = (base.mapInArrow(places, "row bigint, doc_id bigint, start bigint, digest binary").join(owned, "digest")
               .select("row", F.expr("transform(filter(runs, r -> r.owner < doc_id), r -> struct(start + r.at AS first, r.n AS n))").alias("spans"))
               .where("size(spans) > 0")
               .groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")))  # within one document

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, spans = words_of([spaced(t) for t in utf8(batch)]), batch.column("spans")
            n, first, found = len(words.bounds) - 1, words.first, spans.is_valid().to_pylist()
            begin, windows = (x.to_numpy() for x in spans.flatten().flatten())
            begin = begin + np.repeat(first[:-1], spans.value_lengths().fill_null(0).to_numpy())
            edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + windows + min_words - 1, minlength=n + 1)
            gone = np.cumsum(edge)[:n] > 0
            sizes = np.diff(words.bounds)
            kept = np.frombuffer(words.data, np.uint8)[np.repeat(~gone, sizes)].tobytes()
            ends = np.append(0, np.cumsum(np.where(gone, 0, sizes)))[first].tolist()
            rest = [kept[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            filled = np.flatnonzero(np.diff(first))  # texts with words
            opens, closes = gone.copy(), gone.copy()
            opens[1:] &= ~gone[:-1]
            closes[:-1] &= ~gone[1:]
            opens[first[filled]] = gone[first[filled]]
            closes[first[filled + 1] - 1] = gone[first[filled + 1] - 1]
            turns = np.stack([np.flatnonzero(opens), np.flatnonzero(closes) + 1], axis=1)
            holder = np.searchsorted(first, turns[:, 0], side="right") - 1
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(turns) + 1, 2), pa.int32()), pa.array((turns - first[holder][:, None]).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(np.append(0, np.cumsum(gone))[first])),
                 pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string()),
                 pa.array([r.decode() if f else None for r, f in zip(rest, found, strict=True)], pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(holder, np.arange(batch.num_rows + 1)), pa.int32()), pairs)],
                names=["row", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "intervals"])

    return base.join(repeats, "row", "left").mapInArrow(
        finish, "row bigint, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, intervals array<array<bigint>>")
