"""Source divergence audit over the frequent terms of each language.

Terms are found by iceberg prefix refinement.  Every document becomes its
distinct terms, each closed by an end byte.  A level counts, per language, the
documents that hold each byte prefix of the level's length; a prefix in too few
documents is discarded with all its extensions, one that contains the end byte
is a complete, kept term, and the others are extended at the next level.  Level
lengths double, so their number is logarithmic in the longest frequent term.
The surviving prefixes go to the next level as a Bloom filter of bounded size:
an extension that it lets through wrongly has fewer documents than its
discarded prefix and is discarded by its own count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.llm import bloom
from labelforge.llm.common import documents, ship, small_batches, stored, utf8

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTHING = 5
TOP_TERMS = 50
#: Bytes of the first level's prefixes.
FIRST_BYTES = 3
#: Closes a term; no term has it.
END = b" "
#: Bytes of terms that a task takes up at a time.
HELD_BYTES = 16 << 20
#: Terms and sources of one block of the distance matrix, about.
TERM_BLOCK, SOURCE_BLOCK = 4096, 256

#: Letters to themselves in lower case, bytes of other characters to themselves, all else to the end byte.
_TERM_BYTES = bytes(b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else END[0] for b in range(256))


def distinct_terms(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``lang, source, terms, counts`` of every document: its distinct terms, closed
    and joined, and how often each occurs (unsigned 32-bit).  NULL columns are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [Counter(t.translate(_TERM_BYTES).split()) for t in utf8(batch)]
            terms = [END.join(c) + END if c else b"" for c in found]
            counts = [np.fromiter(c.values(), "<u4", len(c)).tobytes() for c in found]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["lang", "source", "terms", "counts"])

    read = documents(docs, "text", "lang", "source").select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    return stored(spark, read.mapInArrow(run, "lang string, source string, terms binary, counts binary"), "distinct-terms", compression="zstd")


def _hashes(lang: str, keys: list[bytes]) -> np.ndarray:
    seed, h = zlib.crc32(lang.encode()), xxhash.xxh3_64_intdigest
    return np.fromiter((h(k, seed) for k in keys), np.uint64, len(keys))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.DictionaryArray, np.ndarray]]:
    """For each language of the batch: its name, its rows, the closed terms of these
    rows and each term's place among the rows."""
    langs, blobs = batch.column("lang").dictionary_encode(), batch.column("terms").to_pylist()
    number = langs.indices.to_numpy()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        rows = np.flatnonzero(number == k)
        data = b"".join(blobs[i] for i in rows)
        if data:
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == END[0]) + 1
            upto = np.cumsum([len(blobs[i]) for i in rows])
            holder = np.searchsorted(upto, ends, side="left")
            starts = np.concatenate([[0], ends]).astype(np.int32)
            yield lang, rows, pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(data)]), holder


def _filter_of(spark: SparkSession, keys: DataFrame, n: int):
    """A broadcast Bloom filter of the ``lang, key`` rows; its size is bounded by ``bloom.MAX_BITS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "key"):
            pairs = zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True)
            found = np.fromiter((xxhash.xxh3_64_intdigest(k, zlib.crc32(g.encode())) for g, k in pairs), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    return spark.sparkContext.broadcast(bloom.build(keys.select("lang", "key").mapInArrow(run, "h bigint"), "h", n))


def _level(terms: DataFrame, size: int, done: int, parents) -> DataFrame:
    """``lang, key, n``: documents that hold each prefix of ``size`` bytes (or whole
    shorter term) whose prefix of ``done`` bytes may have survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "terms", HELD_BYTES):
            for lang, _, closed, holder in _by_language(batch):
                if done:
                    longer = pc.greater(pc.binary_length(closed), done)
                    closed, holder = closed.filter(longer), holder[longer.to_numpy(zero_copy_only=False)]
                prefix = pc.binary_slice(closed, 0, size).dictionary_encode()
                keys, key = prefix.dictionary, prefix.indices.to_numpy()
                if parents is not None:
                    held = bloom.contains(parents.value, _hashes(lang, pc.binary_slice(keys, 0, done).to_pylist()))
                    key, holder = key[held[key]], holder[held[key]]
                once = pa.table({"holder": holder, "key": key}).group_by(["holder", "key"], use_threads=False).aggregate([])
                counts = np.bincount(once.column("key").to_numpy(), minlength=len(keys))
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), keys.take(pa.array(used)), pa.array(counts[used], pa.int64())], names=["lang", "key", "n"])

    found = terms.select("lang", "terms").mapInArrow(run, "lang string, key binary, n bigint")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def kept_terms(spark: SparkSession, terms: DataFrame, min_docs: int = MIN_DOCS, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """``lang, key`` (the closed term) of every term in at least ``min_docs`` documents of its language."""
    kept, size, done, parents = [], first_bytes, 0, None
    while True:
        survivors = stored(spark, _level(terms, size, done, parents).where(F.col("n") >= min_docs).select("lang", "key"), f"prefixes-{size}")
        if parents is not None:
            parents.unpersist()
        whole = F.endswith("key", F.lit(END))
        kept.append(survivors.where(whole))
        growing = survivors.where(~whole)
        n = growing.count()
        if n == 0:
            break
        parents, done, size = _filter_of(spark, growing, n), size, size * 2
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return stored(spark, out, "kept-terms")


def term_counts(spark: SparkSession, terms: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, term, n``: occurrences of each kept term by source, where there are any."""
    held = _filter_of(spark, kept, max(1, kept.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "terms", HELD_BYTES):
            sources, counts = batch.column("source").dictionary_encode(), batch.column("counts").to_pylist()
            number = sources.indices.to_numpy()
            for lang, rows, closed, holder in _by_language(batch):
                term = closed.dictionary_encode()
                keys, key = term.dictionary, term.indices.to_numpy()
                hit = bloom.contains(held.value, _hashes(lang, keys.to_pylist()))[key]
                n = np.frombuffer(b"".join(counts[i] for i in rows), "<u4").astype(np.int64)
                sums = (pa.table({"source": number[rows[holder[hit]]], "key": key[hit], "n": n[hit]})
                        .group_by(["source", "key"], use_threads=False).aggregate([("n", "sum")]).combine_chunks())
                yield from pa.table([pa.array([lang] * len(sums), pa.string()), sources.dictionary.take(sums.column("source")), keys.take(sums.column("key")),
                                     sums.column("n_sum")], names=["lang", "source", "key", "n"]).combine_chunks().to_batches()

    found = (terms.select("lang", "source", "terms", "counts").mapInArrow(run, "lang string, source string, key binary, n bigint")
             .groupBy("lang", "source", "key").agg(F.sum("n").alias("n")))
    return stored(spark, found.join(kept, ["lang", "key"]).select("lang", "source", F.rtrim(F.col("key").cast("string")).alias("term"), "n"), "term-counts")


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kinds)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(SMOOTHING)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + F.lit(SMOOTHING) * kinds).cast("decimal(20,0)"))


def _distances(key: tuple, cells: pa.Table, sources: pa.Table, source_block: int) -> pa.Table:
    """Summed distances, over one block of terms, between the sources of two blocks."""
    lang, _, a, b = (k.as_py() for k in key)
    names, number, rest = sources.column("source").to_pylist(), sources.column("number").to_numpy(), sources.column("rest").to_numpy()
    term = cells.column("term").dictionary_encode().combine_chunks() if cells.num_rows else None
    n_terms = len(term.dictionary) if cells.num_rows else 0
    shares = np.repeat(rest[:, None], n_terms, axis=1)
    if n_terms:
        place = {int(n): i for i, n in enumerate(number)}
        rows = np.fromiter((place[int(n)] for n in cells.column("number").to_numpy()), np.int64, cells.num_rows)
        shares[rows, term.indices.to_numpy()] = cells.column("share").to_numpy()
    left, right = np.flatnonzero(number // source_block == a), np.flatnonzero(number // source_block == b)
    one, two, value = [], [], []
    for i in left:
        others = right[number[right] > number[i]]
        one += [names[i]] * len(others)
        two += [names[j] for j in others]
        value += np.abs(shares[others] - shares[i]).sum(axis=1).tolist()
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "one": pa.array(one, pa.string()), "two": pa.array(two, pa.string()),
                     "value": pa.array(value, pa.int64())})


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, term_block: int = TERM_BLOCK,
          source_block: int = SOURCE_BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every (lang, source) of the
    documents its distance to each other source of the language (``pair``), and its
    ``top`` terms that are more frequent there than in the language (``term``).

    NULL text, lang or source is ''.  Every row is a document, so repeated rows and
    ids count each.  A language without kept terms has distances of 0; an empty
    table has no rows.  Other columns are left behind.

    The distances come from blocks of the matrix of sources and terms; each
    cell goes to the blocks that its source takes part in, and a task holds
    one block, however many terms and sources there are."""
    ship(spark)
    terms = distinct_terms(spark, docs)
    kept = kept_terms(spark, terms, min_docs)
    counts = term_counts(spark, terms, kept)
    lang, group = Window.partitionBy("lang"), Window.partitionBy("lang", "source")
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (terms.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
              .withColumn("lang_total", F.sum("total").over(lang))
              .withColumn("number", F.row_number().over(lang.orderBy("source")) - 1)
              .withColumn("rest", F.when(F.col("kinds") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kinds"))).otherwise(F.lit(0).cast("bigint")))
              .withColumn("blocks", F.floor(F.max("number").over(lang) / source_block) + 1)
              .withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("kinds") / term_block))))
    groups = stored(spark, groups, "groups")

    cells = (counts.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
             .withColumn("share", _share(F.col("n"), F.col("total"), F.col("kinds")))
             .withColumn("lang_share", _share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")))
             .select("lang", "source", "number", "blocks", "chunks", "term", "share", "lang_share"))
    cells = stored(spark, cells, "shares")

    more = F.col("share") > F.col("lang_share")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = (cells.where(more).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))

    # the pairs of blocks (a <= b) that block ``own`` takes part in
    mine = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, own) AS a, greatest(o, own) AS b))")
    own = F.floor(F.col("number") / source_block)
    pairs = lambda df: df.withColumn("own", own).withColumn("ab", F.explode(mine)).withColumn("a", F.col("ab.a")).withColumn("b", F.col("ab.b"))
    block_cells = pairs(cells.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))).select("lang", "chunk", "a", "b", "number", "term", "share")
    block_sources = (pairs(groups.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))))
                     .select("lang", "chunk", "a", "b", "number", "source", "rest"))
    keys = ("lang", "chunk", "a", "b")
    halves = (block_cells.groupBy(*keys).cogroup(block_sources.groupBy(*keys))
              .applyInArrow(lambda key, c, s: _distances(key, c, s, source_block), "lang string, one string, two string, value bigint")
              .groupBy("lang", "one", "two").agg(F.sum("value").alias("value")))
    halves = stored(spark, halves, "distances")
    both = halves.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").unionByName(
        halves.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value"))
    pair = (both.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
            .withColumn("rank", F.row_number().over(ranked)))
    return pair.unionByName(term)
