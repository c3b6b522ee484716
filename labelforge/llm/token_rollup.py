"""Token counts as delta-maintained rollups with idempotent batch commits.

A batch of changes (inserts, deletes, revised counts) becomes signed rows that
are added up by source, language and tokenizer version.  The store is a folder:
``ledger`` holds each document's signed counts by batch, ``deltas`` the batch's
sums, ``commits`` a table for each finished batch, which names the batches that
it stands for if it is a compaction.  A batch without its commit is invisible and
is written anew; one with it is never applied again.  One writer at a time.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, ship, small_batches

KEYS = ("source", "lang", "version")
MEASURES = ("documents", "tokens", "chars")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MULTILINGUAL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoder(path: str):
    """A function from text to its number of tokens, for the vocabulary file at
    ``path``; built once in a worker process."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = importlib.import_module("public_tokenizers").PATTERN
        encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def token_counts(spark: SparkSession, docs: DataFrame, version: str, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, lang, version, documents, tokens, chars`` for every row.

    NULL text counts as empty and has no token; a long text is read whole; an empty
    table gives no row; other columns are left behind, whatever their names.  The
    vocabulary file lies at the same path on every executor, where a ``.tiktoken``
    file also needs its split pattern from the module ``public_tokenizers``."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([count(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                names=["doc_id", "source", "lang", "tokens", "chars"])

    return (documents(docs, "doc_id", "text", "source", "lang").mapInArrow(run, "doc_id bigint, source string, lang string, tokens bigint, chars bigint")
            .select("doc_id", "source", "lang", F.lit(version).alias("version"), F.lit(1).cast("bigint").alias("documents"), "tokens", "chars"))


class Rollup:
    """The rollup store in a folder that the driver and all executors share."""

    LEDGER = "doc_id bigint, source string, lang string, version string, documents bigint, tokens bigint, chars bigint"
    DELTAS = "source string, lang string, version string, documents bigint, tokens bigint, chars bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.root}/commits/{batch}/_SUCCESS")

    def batches(self) -> list[str]:
        """Names of the committed batches (one folder each)."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        if not self._exists(f"{self.root}/commits"):
            return []
        found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(top)
        return sorted(x.getPath().getName() for x in found if self.committed(x.getPath().getName()))

    def live(self) -> list[str]:
        """The committed batches that no committed compaction stands for."""
        names = self.batches()
        if not names:
            return []
        commits = self.spark.read.schema("replaces string").parquet(*(f"{self.root}/commits/{n}" for n in names))
        replaced = {r.replaces for r in commits.where("replaces is not null").collect()}
        return [n for n in names if n not in replaced]

    def _read(self, part: str, schema: str) -> DataFrame:
        names = self.live()
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{part}/{n}" for n in names))

    def ledger(self) -> DataFrame:
        """What each document contributes now: its committed signed rows added
        up by id and key; rows that cancel out are gone."""
        kept = self._read("ledger", self.LEDGER).groupBy("doc_id", *KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
        return kept.where("documents <> 0 or tokens <> 0 or chars <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, version, documents, tokens, chars`` over all committed batches."""
        return self._read("deltas", self.DELTAS).groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).where("documents <> 0 or tokens <> 0 or chars <> 0")

    def commit(self, batch: str, changes: DataFrame, replaces: list[str] | None = None) -> bool:
        """Apply signed changes (columns of the ledger) as ``batch``; False if it
        was applied before.  NULL keys are categories; an empty batch is a commit.

        The ledger is written first and read back for the sums, so changes are
        evaluated once; the commit row comes last."""
        if self.committed(batch):
            return False
        columns = ["doc_id", *KEYS, *MEASURES]
        changes.select(*columns).write.mode("overwrite").parquet(f"{self.root}/ledger/{batch}")
        written = self.spark.read.schema(self.LEDGER).parquet(f"{self.root}/ledger/{batch}")
        written.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        names = self.spark.createDataFrame([(n,) for n in replaces or []], "replaces string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/{batch}")
        return True

    def insert(self, batch: str, counts: DataFrame) -> bool:
        """Add the counts.  An id that contributes already contributes both; to
        replace what it contributes, use ``revise``."""
        return self.commit(batch, counts)

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Take back everything that the documents with these ids contribute; ids
        that contribute nothing, NULL ids and repeated ids change nothing more."""
        if self.committed(batch):
            return False
        gone = self.ledger().join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return self.commit(batch, gone.select("doc_id", *KEYS, *((-F.col(m)).alias(m) for m in MEASURES)))

    def revise(self, batch: str, counts: DataFrame) -> bool:
        """Replace what documents contribute under the counts' versions by new counts.

        Several rows of one id and version are all added.  Rows without an id or a
        version replace nothing and are left out.  The counts are evaluated once."""
        if self.committed(batch):
            return False
        counts.select("doc_id", *KEYS, *MEASURES).where("doc_id is not null and version is not null").write.mode("overwrite").parquet(f"{self.root}/revised/{batch}")
        new = self.spark.read.schema(self.LEDGER).parquet(f"{self.root}/revised/{batch}")
        old = self.ledger().join(new.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi")
        signed = old.select("doc_id", *KEYS, *((-F.col(m)).alias(m) for m in MEASURES))
        return self.commit(batch, signed.unionByName(new))

    def compact(self, batch: str) -> bool:
        """Replace all live batches by one with a row per contributing id and key.

        Until it is committed the old batches are read, afterwards the new one;
        the old ones stay committed, so none of them is ever applied again."""
        if self.committed(batch):
            return False
        return self.commit(batch, self.ledger(), self.live())
