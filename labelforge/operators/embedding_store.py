"""T7 with memory: embeddings kept by the digest of their text.

A run looks up the digests of its texts, embeds only those that the store does
not hold, and adds them.  The store may be far larger than a run, so its vectors
are pruned by a Bloom filter of the run's digests before they are shuffled for
the join.  The filter has a bounded size; what it lets through wrongly, the join
drops."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.text import flatten_newlines
from labelforge.operators.incremental import _read_or_empty
from labelforge.operators.teacher import materialize

#: 16 bits for each digest, within these bounds (the largest filter has 16 MB).
FILTER_BITS = (1 << 12, 1 << 27)
SCHEMA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("batch", T.StringType())])


def text_digest(text: str) -> Column:
    """SHA-256 of the newline-flattened text; NULL has a name of its own."""
    return F.coalesce(F.sha2(flatten_newlines(text).cast("binary"), 256), F.lit("null"))


def digest_key(digest: Column | str) -> Column:
    """The digest's bytes, half as long as its letters: what joins shuffle."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    return F.coalesce(F.when(digest != "null", F.unhex(digest)), digest.cast("binary"))


def _places(digest: str, bits: int) -> list[Column]:
    h = F.xxhash64(digest)
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def digest_filter(digests: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with the filter's 64-bit words in order, and its number of bits."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * max(n, 1) - 1).bit_length()))
    # digests may repeat: their bits are set where they are read, only words are shuffled
    place = digests.select(F.explode(F.array(*_places("digest", bits))).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("ones"))
    every = digests.sparkSession.range(bits // 64).select(F.col("id").alias("word"))  # the words without a bit, too
    full = every.join(words, "word", "left").select("word", F.coalesce("ones", F.lit(0)).alias("ones"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "ones"))), lambda w: w["ones"]).alias("words")), bits


def may_hold(df: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """The rows of ``df`` whose digest the filter may hold.  The broadcast side is one row of bounded size."""
    hit = [F.expr("true")]
    for p in _places("digest", bits):
        word = F.element_at("words", (F.shiftright(p, 6) + 1).cast("int"))
        hit.append(F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return df.join(F.broadcast(words), hit[1] & hit[2], "left_semi")


class EmbeddingStore:
    """Vectors of one encoder under ``root``, a shared folder; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, encoder_name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{encoder_name}/vectors"

    def vectors(self) -> DataFrame:
        """``digest, embedding, batch``: every text embedded so far."""
        return _read_or_empty(self.spark, self.path, SCHEMA)

    def embed(self, df: DataFrame, text: str, encoder: Callable[[DataFrame, str, str], DataFrame], out: str = "embedding",
              batch: str | None = None) -> DataFrame:
        """``df`` with the embedding of ``text``; texts that the store does not hold
        are embedded once each and added as ``batch`` (a fresh name by default).

        A run that fails while embedding adds nothing.  NULL texts get the encoder's
        answer for NULL; repeated texts are embedded once; an empty ``df`` adds nothing."""
        digest = text_digest(text)
        digests = df.select(digest.alias("digest"))
        words, bits = digest_filter(digests, digests.agg(F.approx_count_distinct("digest")).first()[0])
        words = materialize(words, "digest-filter")  # one row, read by both lookups
        held = may_hold(self.vectors(), words, bits).select(digest_key("digest").alias("_key"))
        # known texts leave before the others are made one of each: a text crosses the network once
        unknown = df.select(digest_key(digest).alias("_key"), flatten_newlines(text).alias("_text")).join(held, "_key", "left_anti")
        new = unknown.groupBy("_key").agg(F.any_value("_text").alias("_text")).select(text_digest("_text").alias("digest"), "_text")
        made = encoder(new, "_text", "embedding").select("digest", "embedding").withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        made.write.mode("append").parquet(self.path)
        # read anew: what was added is there now
        vectors = may_hold(self.vectors(), words, bits).select(digest_key("digest").alias("_key"), F.col("embedding").alias(out))
        return df.withColumn("_key", digest_key(digest)).join(vectors, "_key", "left").drop("_key")
