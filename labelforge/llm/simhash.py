"""SimHash near-duplicates by one-wildcard segment variants.

A 64-bit fingerprint is cut into fewer segments than the distance needs for an
equal one: with two segments and at most three differing bits, one segment
differs by at most one bit.  Each segment is indexed as it is and once with
each of its bits wildcarded; fingerprints that meet under a key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, ship, small_batches, stored, utf8
from labelforge.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Members of a bucket that one task compares at a time; larger buckets are dealt out in pairs of such chunks.
CHUNK = 512
#: Shingle hashes whose bits are counted at a time.
SLICE = 1 << 14


def simhash(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint: bit i is set if more than half of the
    shingle hashes have it.  A-Z are lower-cased, words split at ASCII white
    space; fewer words than ``width``: one shingle of all; none: zero."""
    words = text.lower().split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= width:
        return hashed(b" ".join(words))
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter(map(hashed, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))), np.uint64, n)
    for at in range(0, n, SLICE):
        bits = np.unpackbits(hashes[at:at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``row, doc_id, fp`` (the fingerprint's bits as a signed bigint) for every row.

    NULL text counts as empty; its fingerprint is zero."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([simhash(t, width) for t in utf8(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(fps)], names=["row", "doc_id", "fp"])

    return documents(docs, "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, fp bigint")


def variants(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, key, bit``: each distinct fingerprint under its segment keys.

    The fingerprint is cut into ``max_bits // 2 + 1`` segments, so that one
    differs by at most one bit.  ``key`` holds the segment's number, the place
    of its wildcard (the first place: none) and its other bits; ``bit`` is the
    wildcarded bit."""
    segments = max_bits // 2 + 1
    size = 64 // segments + (64 % segments > 0)
    if size > 32:
        segments, size = 2, 32
    slots = segments * (size + 1)
    out = fps.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    place = F.col("slot") % (size + 1)
    segment = F.expr(f"shiftrightunsigned(fp, cast(slot div {size + 1} as int) * {size}) & {(1 << size) - 1}L")
    out = out.select("fp", "slot", place.alias("place"), segment.alias("segment"))
    return out.select("fp", F.expr(
        "shiftleft(cast(slot as bigint), 32) | if(place = 0, segment, segment & ~shiftleft(1L, cast(place - 1 as int)))").alias("key"),
        F.expr("if(place = 0, 0L, shiftrightunsigned(segment, cast(place - 1 as int)) & 1L)").alias("bit"))


def forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links that join every two of ``fps`` within ``max_bits`` through a chain
    of such pairs: a spanning forest, at most one link for each member."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    left = np.ones(len(fps), bool)
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while len(front):
            found = near[front] & left
            to = np.flatnonzero(found.any(axis=0))
            for j, k in zip(to, found[:, to].argmax(axis=0), strict=True):
                yield front[k], j
            left[to] = False
            front = to


def link(spark: SparkSession, fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links between distinct fingerprints within ``max_bits`` that
    connect all such pairs (not each pair of a dense group is listed).

    Buckets without a pair are dropped by pre-aggregated counts.  A bucket of
    many members is cut into chunks by a hash, and each pair of chunks is a
    task's unit of its own, so no group meets whole in one task."""
    ship(spark)
    index = variants(fps, max_bits)
    counted = index.groupBy("key").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))
    size = 64 // (max_bits // 2 + 1) + (64 % (max_bits // 2 + 1) > 0)
    size = min(size, 32)
    exact = F.expr(f"shiftright(key, 32) % {size + 1} = 0")
    live = stored(spark, counted.where(F.expr("n > 1") & (exact | F.expr("ones > 0 and ones < n")))
                  .select("key", F.ceil(F.col("n") / chunk).alias("chunks")), "live-buckets")
    members = index.join(live, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")))
    dealt = (members.withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
             .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: tuple | None = None

        def flush() -> list[tuple[int, int]]:
            got = np.concatenate(held)
            return [(got[i], got[j]) for i, j in forest(got, max_bits)]

        def out(found: list) -> pa.RecordBatch:
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi")])
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(fp)]
            found: list = []
            for s, e in zip(starts, starts[1:], strict=False):
                key = tuple(keys[:, s])
                if key != at and held:
                    found += flush()
                    held = []
                at = key
                held.append(fp[s:e])
            yield out(found)
        if held:
            yield out(flush())

    return (dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(pairs, "a bigint, b bigint").distinct())


def near_groups(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``row, doc_id, fp, component_id, first_row`` for every row.

    Rows whose fingerprints differ by at most ``max_bits`` bits are linked;
    ``component_id`` is the smallest doc_id reachable (a NULL id counts last)
    and ``first_row`` the row that has it.  Equal texts share a fingerprint, so
    copies never meet as pairs.  An empty table gives an empty result.
    """
    rows = stored(spark, fingerprints(spark, docs, width), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = stored(spark, rows.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = connected_components(spark, link(spark, distinct.select("fp"), max_bits), "a", "b")
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = stored(spark, labelled, "labelled")
    owners = stored(spark, labelled.groupBy("root").agg(F.min("first").alias("owner")), "owners")
    named = stored(spark, labelled.join(owners, "root").select("fp", F.col("owner.doc_id").alias("component_id"), F.col("owner.row").alias("first_row")), "components")
    return rows.join(named, "fp").select("row", "doc_id", "fp", "component_id", "first_row")
