"""Teacher labelling, retries, budgets and confidence.

A *teacher* is any batch function ``pd.Series[str] -> pd.Series`` (prompt in,
raw reply out; a cell may hold an ``Exception`` to report a failed call).  A
``teacher_factory`` builds it once per partition (one client per task), and
``mapInPandas`` feeds it Arrow batches.  Replies are keyed by
``(key, teacher, pass)`` so a retried task rewrites the same rows; callers
should materialise the labelled table once (``materialize``) before using it
twice, because a sampling teacher is not deterministic.

The built-in ``rule_teacher`` is an offline stand-in used by tests and the
registered queries; its rule is simple enough to restate in SQL.
"""

from __future__ import annotations

import hashlib
import json
import math
import queue
import re
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.encode import extract_label_json, parse_json_strict, parse_json_strict_each
from labelforge.functions.text import context_sql, doc_prompt, is_blank, sentence_prompt, sentence_prompts
from labelforge.session import checkpoint_root, scratch_path

Teacher = Callable[[pd.Series], pd.Series]
TeacherFactory = Callable[[], Teacher]

DOC_LABELS = ["Normal", "Abnormal", "Uncertain"]
SENTENCE_LABELS = ["Yes", "No", "Uncertain"]

#: Answered prompts that the scripted teacher remembers, and tokens whose bucket an encoder remembers.
REMEMBERED = 20_000
TOKENS_REMEMBERED = 300_000


# ------------------------------------------------------------ offline teachers

def rule_teacher(shift: int = 0, labels: list[str] = DOC_LABELS, label_key: str = "label",
                 explanation_key: str = "explanation", fence_every: int = 11, gate: int = 1) -> TeacherFactory:
    """Deterministic offline teacher: with n = len(prompt), the label is
    labels[(n + shift) % 3] when n % gate == 0, else labels[n % 3]; every
    ``fence_every``-th length gets a fenced (unparseable) reply; a NULL
    prompt gets a NULL reply."""

    def reply(n: int) -> str:
        lab = labels[(n + (shift if n % gate == 0 else 0)) % len(labels)]
        body = json.dumps({label_key: lab, explanation_key: f"{lab} by rule {shift}: {n} characters"})
        return "```json\n" + body + "\n```" if fence_every and n % fence_every == 0 else body

    def make() -> Teacher:
        def call(prompts: pd.Series) -> pd.Series:
            lengths = [None if p is None else len(p) for p in prompts.to_numpy()]
            said = {n: reply(n) for n in set(lengths) if n is not None}
            return pd.Series([said.get(n) for n in lengths], index=prompts.index, dtype=object)

        return call

    return make


def scripted_failures(base: TeacherFactory, permanent_mod: int = 13, transient_mod: int = 5,
                      transient_failures: int = 2) -> TeacherFactory:
    """Wrap a teacher with scripted errors (tests of T3): prompts whose length
    is a multiple of ``permanent_mod`` always fail; multiples of
    ``transient_mod`` fail their first ``transient_failures`` calls.

    Of the prompts that have been answered it remembers the last ``REMEMBERED``
    ones; a prompt older than that fails anew when it comes back."""

    def make() -> Teacher:
        inner = base()
        seen: dict[str, int] = {}  # prompts on their way: no more than the caller re-sends
        answered: dict[str, None] = {}  # oldest first

        def call(prompts: pd.Series) -> pd.Series:
            good = inner(prompts)
            out = []
            for p, g in zip(prompts, good):
                n = len(p) if p is not None else -1
                if p is not None and n % permanent_mod == 0:
                    out.append(RuntimeError("permanent failure"))
                elif p is not None and n % transient_mod == 0 and p not in answered and seen.get(p, 0) < transient_failures:
                    seen[p] = seen.get(p, 0) + 1
                    out.append(TimeoutError("transient failure"))
                else:
                    if seen.pop(p, None) is not None:
                        answered[p] = None
                        if len(answered) > REMEMBERED:
                            del answered[next(iter(answered))]
                    out.append(g)
            return pd.Series(out, index=prompts.index, dtype=object)

        return call

    return make


# ---------------------------------------------------------------- calling

def _chunked(call: Teacher, prompts: pd.Series, size: int | None) -> pd.Series:
    """Send an Arrow batch to the teacher in requests of at most ``size`` prompts."""
    if not size or len(prompts) <= size:
        return call(prompts)
    return pd.concat([call(prompts.iloc[i:i + size]) for i in range(0, len(prompts), size)])


def call_teacher(df: DataFrame, prompt: str, teacher: TeacherFactory, keep: list[str],
                 out: str = "raw_ai_output", partitions: int | None = None,
                 request_batch: int | None = None) -> DataFrame:
    """T1 core: one teacher call per row, batched per Arrow batch.

    ``partitions`` sets the concurrency against the endpoint (a round-robin
    repartition; the teacher client is opened once per partition);
    ``request_batch`` caps the prompts per request (the endpoint's limit)."""
    src = df.select(*keep, prompt)
    if partitions:
        src = src.repartition(partitions)
    schema = src.select(*keep, F.lit(None).cast("string").alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = teacher()
        for pdf in batches:
            res = _chunked(call, pdf[prompt], request_batch)
            res = res.map(lambda v: None if isinstance(v, BaseException) else v)
            yield pdf[keep].assign(**{out: res.values})

    return src.mapInPandas(run, schema)


def _replies(teachers: list[TeacherFactory], prompt: Column | str, request_batch: int | None = None,
             build: Callable[[pa.Array], pa.Array] | None = None) -> Column:
    """The raw replies of several teachers to one prompt, as an array in their
    order.  Only the prompt — or, with ``build``, the text that it is made of in
    the worker — goes to Python and only the replies come back; the clients are
    opened once per partition."""

    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        calls = [t() for t in teachers]
        for batch in batches:
            prompts = (build(batch) if build else batch).to_pandas()
            said = np.empty((len(prompts), len(calls)), dtype=object)
            for j, call in enumerate(calls):
                said[:, j] = [None if isinstance(v, BaseException) else v for v in _chunked(call, prompts, request_batch)]
            offsets = np.arange(len(prompts) + 1, dtype=np.int32) * len(calls)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(said.reshape(-1), pa.string(), from_pandas=True))

    return F.arrow_udf(ask, "array<string>").asNondeterministic()(prompt)


def label_documents(reports: DataFrame, teacher: TeacherFactory, model: str,
                    keys: list[str] = ["subject_id", "study_id"], partitions: int | None = None) -> DataFrame:
    """Extract table of one teacher: report + label, explanation, raw_ai_output, model.

    Prompt = P14 (NULL section → NULL prompt → NULL reply); fields by P17."""
    with_prompt = reports.select(*keys, "findings", "impression",
                                 doc_prompt("findings", "impression").alias("prompt"))
    raw = call_teacher(with_prompt, "prompt", teacher, [*keys, "findings", "impression"], partitions=partitions)
    return raw.select(*keys, "findings", "impression",
                      extract_label_json("raw_ai_output", "label").alias("label"),
                      extract_label_json("raw_ai_output", "explanation").alias("explanation"),
                      "raw_ai_output", F.lit(model).alias("model"))


def label_documents_all(reports: DataFrame, teachers: dict[str, TeacherFactory],
                        keys: list[str] = ["subject_id", "study_id"], partitions: int | None = None,
                        request_batch: int | None = None) -> DataFrame:
    """T1 for several teachers in one pass: the reports are scanned once, their
    prompts go to Python once, and every teacher labels each Arrow batch; one
    output row per (report, teacher).  Same columns as ``label_documents``."""
    src = reports.select(*keys, "findings", "impression", doc_prompt("findings", "impression").alias("prompt"))
    if partitions:
        src = src.repartition(partitions)
    said = src.select(*keys, "findings", "impression", _replies(list(teachers.values()), "prompt", request_batch).alias("_said"))
    raw = said.select(*keys, "findings", "impression", F.posexplode("_said").alias("_i", "raw_ai_output"))
    names = F.array(*[F.lit(m) for m in teachers])
    return raw.select(*keys, "findings", "impression",
                      extract_label_json("raw_ai_output", "label").alias("label"),
                      extract_label_json("raw_ai_output", "explanation").alias("explanation"),
                      "raw_ai_output", F.get(names, F.col("_i")).alias("model"))


def with_passes(df: DataFrame, passes: int = 3, col: str = "pass") -> DataFrame:
    """T2 fan-out: every row ``passes`` times (narrow ``explode``; the passes of
    one sentence stay adjacent in the same task)."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias(col))


def label_sentences(sentences: DataFrame, teacher: TeacherFactory | list[TeacherFactory], keys: list[str],
                    passes: int = 3, sentence: str = "sentence", partitions: int | None = None,
                    together: bool = False) -> DataFrame:
    """Independent votes of ``passes`` calls per sentence (one table with a
    ``pass`` column); fields ``Result``/``Explanation`` parsed from the reply.

    One teacher → one fan-out over the passes (one scan); a list → one
    teacher per pass (e.g. differently seeded), all asked in one scan.
    ``together`` (a list only) leaves the votes of a sentence in one row, as the
    array ``votes``: what is done with the sentence itself is then done once,
    not once per pass; ``spread_votes`` takes them apart."""
    if isinstance(teacher, list):
        if len(teacher) != passes:
            raise ValueError("one teacher per pass")
        base = sentences.select(*keys, F.col(sentence).alias("Context"))
        src = base.repartition(partitions) if partitions else base
        said = src.select(*keys, "Context", _replies(teacher, "Context", build=sentence_prompts).alias("_said"))
        read = said.withColumn("_p", parse_json_strict_each("_said", ("Result", "Explanation")))
        vote = lambda v, i: F.struct((i + 1).alias("pass"), v["_p"]["Result"].alias("Result"),
                                     v["_p"]["Explanation"].alias("Explanation"), v["_said"].alias("raw_ai_output"))
        votes = read.select(*keys, "Context", F.transform(F.arrays_zip("_said", "_p"), vote).alias("votes"))
        return votes if together else spread_votes(votes, keys, "Context")
    if together:
        raise ValueError("votes stay together with one teacher per pass")
    base = sentences.select(*keys, F.col(sentence).alias("Context"), sentence_prompt(sentence).alias("prompt"))
    raw = call_teacher(with_passes(base, passes), "prompt", teacher, [*keys, "pass", "Context"], partitions=partitions)
    # the sentence path parses replies as strict JSON (one object, nothing after it)
    parsed = raw.withColumn("_p", parse_json_strict("raw_ai_output", ("Result", "Explanation")))
    return parsed.select(*keys, "pass", F.col("_p.value.Result").alias("Result"),
                         F.col("_p.value.Explanation").alias("Explanation"), "Context", "raw_ai_output")


def spread_votes(votes: DataFrame, keys: list[str], *keep: str) -> DataFrame:
    """One row per vote of a table with the votes of a sentence ``together``; the columns ``keep`` are repeated."""
    one = votes.select(*keys, *keep, F.explode("votes").alias("_v"))
    return one.select(*keys, "_v.pass", "_v.Result", "_v.Explanation", *keep, "_v.raw_ai_output")


def strict_json_object(text) -> bool:
    """Reply validator: the whole reply is one JSON object (``json.loads``)."""
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, TypeError):
        return False


def _timed(call: Teacher, prompts: pd.Series, timeout: float | None) -> pd.Series:
    """One request; without an answer after ``timeout`` seconds all its rows have failed."""
    if timeout is None:
        return call(prompts)
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((call(prompts), None))
        except Exception as e:  # raised again in the task
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        replies, failure = box.get(timeout=timeout)
    except queue.Empty:
        late = TimeoutError(f"no reply within {timeout} s")
        return pd.Series([late] * len(prompts), index=prompts.index, dtype=object)
    if failure is not None:
        raise failure
    return replies


def call_with_retry(df: DataFrame, prompt: str, teacher: TeacherFactory, keep: list[str], group: list[str],
                    max_errors: int = 50, out: str = "raw_ai_output",
                    validate: Callable[[str], bool] | None = None, wait: float = 0.0, max_wait: float = 60.0,
                    timeout: float | None = None, request_batch: int | None = None) -> DataFrame:
    """Calls with retries inside the task.

    Failed calls — an exception, or a reply ``validate`` rejects (e.g.
    ``strict_json_object``: the reference retries replies it cannot parse) —
    are re-sent (only the failed rows) until they succeed or the error count
    shared by all rows of the same ``group`` (the passes of one sentence)
    exceeds ``max_errors``; those rows come back with ``error`` set.  Output
    adds ``attempts`` and ``error`` (NULL on success).  Rows of one group must
    be adjacent (``with_passes``): only the last group is remembered from one
    Arrow batch to the next.

    Before the n-th re-send the task sleeps ``wait * 2 ** (n - 1)`` seconds, at
    most ``max_wait``; a request of ``request_batch`` prompts without an answer
    after ``timeout`` seconds counts as failed."""
    src = df.select(*keep, prompt)
    schema = src.select(*keep, F.lit(None).cast("string").alias(out), F.lit(0).alias("attempts"),
                        F.lit(None).cast("string").alias("error")).schema
    missing = [g for g in group if g not in keep]
    if missing:
        raise ValueError(f"group columns {missing} must be kept")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = teacher()
        # error counts live for the whole task: the passes of one sentence are
        # adjacent rows and share one budget even across an Arrow batch boundary
        errors: dict[tuple, int] = {}
        dead: dict[tuple, str] = {}
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            n = len(pdf)
            reply = [None] * n
            attempts = [0] * n
            error: list[str | None] = [None] * n
            gkey = list(zip(*[pdf[g].tolist() for g in group]))
            pending = [i for i in range(n) if gkey[i] not in dead]
            resent = 0
            while pending:
                if resent and wait:
                    time.sleep(min(wait * 2 ** min(resent - 1, 30), max_wait))
                resent += 1
                res = _chunked(lambda p: _timed(call, p, timeout), pdf[prompt].iloc[pending], request_batch)
                nxt = []
                for i, r in zip(pending, res):
                    attempts[i] += 1
                    g = gkey[i]
                    if not isinstance(r, BaseException) and validate is not None and not validate(r):
                        r = ValueError("reply is not one JSON object")
                    if isinstance(r, BaseException):
                        errors[g] = errors.get(g, 0) + 1
                        if errors[g] > max_errors and g not in dead:
                            dead[g] = f"{type(r).__name__}: {r}"
                        nxt.append(i)
                    else:
                        reply[i] = r
                # failed rows are re-sent unless their group ran out of errors
                pending = [i for i in nxt if gkey[i] not in dead]
            for i in range(n):  # a dead group loses its answered passes too
                if gkey[i] in dead:
                    error[i] = dead[gkey[i]]
                    reply[i] = None
            yield pdf[keep].assign(**{out: reply, "attempts": attempts, "error": error})
            last = gkey[-1:]
            errors = {g: errors[g] for g in last if g in errors}
            dead = {g: dead[g] for g in last if g in dead}

    return src.mapInPandas(run, schema)


def skip_after_failure(results: DataFrame, report_keys: list[str], index: str = "sentence_index") -> DataFrame:
    """T3 skip-rest: drop every result of a report at or after its first failed
    sentence (the reference stops the report there).  The first failure per
    report is a partial+final ``min`` aggregation, joined back.  Calls are
    sent per Arrow batch, so later sentences of a failed report may already
    have been answered; their results are dropped here, which gives the
    reference's output at the price of those calls."""
    first_bad = (results.where(F.col("error").isNotNull()).groupBy(*report_keys)
                 .agg(F.min(index).alias("_first_bad")))
    # hashed on the side with one row per report: the results are streamed, not sorted
    j = results.join(first_bad.hint("shuffle_hash"), report_keys, "left")
    return j.where(F.col("_first_bad").isNull() | (F.col(index) < F.col("_first_bad"))).drop("_first_bad")


def dead_letter(results: DataFrame, report_keys: list[str]) -> DataFrame:
    """The reports listed as trouble (one row per report with a failure)."""
    return (results.where(F.col("error").isNotNull()).groupBy(*report_keys)
            .agg(F.min("sentence_index").alias("first_failed_sentence"), F.count(F.lit(1)).alias("failed_calls"),
                 F.max("error").alias("error")))


# --------------------------------------------------------------- budgets

def running_total(df: DataFrame, order: list[str], value: Column | str, out: str = "cum",
                  partitions: int | None = None) -> DataFrame:
    """Global running sum of ``value`` in ``order`` without a one-partition window.

    1. range-partition by the order key (balanced even when one file holds a
       third of the rows) and sort within partitions;
    2. per partition, a local running sum (Arrow batch function);
    3. the per-partition totals — one row per partition, a proven size bound
       — give each partition's offset, broadcast back.
    The local sums are checkpointed (shared checkpoint folder) so both uses
    read the same partitioning.
    """
    spark = df.sparkSession
    checkpoint_root(spark)  # reliable checkpoints go to the shared folder
    v = F.col(value) if isinstance(value, str) else value
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select("*", v.cast("long").alias("_v"))
    ranged = src.repartitionByRange(n, *order).sortWithinPartitions(*order)

    schema = T.StructType(ranged.schema.fields + [T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry = 0
        for pdf in batches:
            cs = pdf["_v"].cumsum() + carry
            carry = int(cs.iloc[-1]) if len(cs) else carry
            yield pdf.assign(_pid=pid, _local=cs.values)

    loc = ranged.mapInPandas(local, schema).checkpoint(eager=True)
    totals = loc.groupBy("_pid").agg(F.max("_local").alias("_tot"))
    from pyspark.sql import Window

    offsets = totals.select("_pid", (F.sum("_tot").over(Window.orderBy("_pid")) - F.col("_tot")).alias("_off"))
    res = loc.join(F.broadcast(offsets), "_pid", "left")
    return res.select(*df.columns, (F.col("_local") + F.coalesce("_off", F.lit(0))).alias(out))


def call_plan_rows(sentences: DataFrame, passes: int = 3, chat_calls: int = 1, embedding_calls: int = 2) -> DataFrame:
    """T4 input: one row per (sentence, pass) with its API calls (1 chat + 2 embeddings)."""
    return with_passes(sentences, passes).withColumn("calls", F.lit(chat_calls + embedding_calls))


def api_budget(plan: DataFrame, order: list[str], budget: int, calls: str = "calls") -> DataFrame:
    """T4: keep the rows whose cumulative calls stay within ``budget`` (complete
    results only; the reference stops at the first call over budget)."""
    cum = running_total(plan, order, calls, out="cum_calls")
    return cum.where(F.col("cum_calls") <= budget)


# --------------------------------------------------------------- confidence

# runs of letters and digits, as on the JVM side
_TOKEN_SPLIT = re.compile(r"[\W_]+")


def _tf(text) -> Counter:
    if not text:
        return Counter()
    counts = Counter(_TOKEN_SPLIT.split(text.lower()))
    counts.pop("", None)
    return counts


def _norm(counts: Counter) -> float:
    return math.sqrt(sum(c * c for c in counts.values()))


def _cosine_series(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosines row by row; each distinct text of ``a`` (the context that several
    votes share) is tokenised once per Arrow batch, its rows one after another."""
    out = [0.0] * len(a)
    texts = b.to_numpy()
    for context, places in a.groupby(a, sort=False).indices.items():
        ta = _tf(context)
        na = _norm(ta)
        if na == 0:
            continue
        for i in places:
            tb = _tf(texts[i])
            if tb:
                small, big = (tb, ta) if len(tb) < len(ta) else (ta, tb)
                out[i] = sum(c * big.get(t, 0) for t, c in small.items()) / (na * _norm(tb))
    return pd.Series(out, index=a.index, dtype="float64")


_TF_COSINE_UDF = None


def tf_cosine_udf(a: Column | str, b: Column | str) -> Column:
    """T5 similarity per row: cosine of the term-frequency vectors of two texts
    (lower-cased runs of letters/digits).  Arrow-batched, linear in the text
    length, no shuffle — the computation needs nothing outside its row.
    (Built lazily: a module-level ``pandas_udf`` would need a session on the
    Python workers that import this module.)"""
    global _TF_COSINE_UDF
    if _TF_COSINE_UDF is None:
        _TF_COSINE_UDF = F.pandas_udf(_cosine_series, "double")
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return _TF_COSINE_UDF(a, b)


def tf_cosine(df: DataFrame, key: list[str], a: str, b: str, out: str = "similarity") -> DataFrame:
    """T5 similarity as a relational plan: tokens exploded to ``(key, token, side)``
    counts, one aggregation per (key, token) and one per key.  Pure JVM but it
    shuffles every token; ``tf_cosine_udf`` is the default (no shuffle)."""
    toks = lambda c: F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    tagged = F.concat(F.transform(toks(a), lambda t: F.struct(t.alias("tok"), F.lit(0).alias("side"))),
                      F.transform(toks(b), lambda t: F.struct(t.alias("tok"), F.lit(1).alias("side"))))
    e = df.select(*key, F.explode(tagged).alias("x"))
    per_tok = e.groupBy(*key, F.col("x.tok").alias("tok")).agg(
        F.count_if(F.col("x.side") == 0).alias("ca"), F.count_if(F.col("x.side") == 1).alias("cb"))
    g = per_tok.groupBy(*key).agg(F.sum(F.col("ca") * F.col("cb")).alias("dot"),
                                  F.sum(F.col("ca") * F.col("ca")).alias("na"),
                                  F.sum(F.col("cb") * F.col("cb")).alias("nb"))
    sim = F.try_divide(F.col("dot").cast("double"), F.sqrt("na") * F.sqrt("nb"))
    return g.select(*key, F.coalesce(sim, F.lit(0.0)).alias(out))


def explanation_confidence(extract: DataFrame, key: list[str] | None = None) -> DataFrame:
    """T5: add ``confidence`` — NULL for a blank explanation, else the TF cosine
    of the context text (P6) and the explanation.  A per-row column: no
    shuffle, no join; ``key`` is accepted for API compatibility."""
    ctx = context_sql("findings", "impression")
    conf = F.when(is_blank("explanation"), F.lit(None).cast("double")).otherwise(tf_cosine_udf(ctx, F.col("explanation")))
    return extract.withColumn("confidence", conf)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two numeric arrays (JVM higher-order functions)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


#: A place of a sparse vector that is not zero; the places ascend.
PLACE = np.dtype([("place", "<i4"), ("value", "<f8")])


def _places_of(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all sparse vectors of a batch one after another, and the row of each."""
    sizes = pc.fill_null(pc.binary_length(vectors), 0).to_numpy(zero_copy_only=False)
    joined = b"" if vectors.null_count == len(vectors) else memoryview(vectors.buffers()[2])
    first = np.frombuffer(vectors.buffers()[1], dtype=np.int32)[vectors.offset] if len(vectors) else 0
    places = np.frombuffer(joined, dtype=PLACE, count=int(sizes.sum()) // PLACE.itemsize, offset=int(first) if len(joined) else 0)
    return places, np.repeat(np.arange(len(vectors)), sizes // PLACE.itemsize)


def _sparse_dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """``dot`` of an Arrow batch of sparse vectors: the same sums, from the first place to the last; NULL where one is NULL."""
    (x, x_rows), (y, y_rows) = _places_of(a), _places_of(b)
    wide = 1 + max(int(v["place"].max(initial=0)) for v in (x, y))
    ours, theirs = x_rows * wide + x["place"], y_rows * wide + y["place"]  # both ascend
    at = np.minimum(np.searchsorted(ours, theirs), max(len(ours) - 1, 0))
    both = np.flatnonzero(ours[at] == theirs) if len(ours) else np.zeros(0, dtype=np.int64)
    products = x["value"][at[both]] * y["value"][both]
    sums = np.bincount(y_rows[both], weights=products, minlength=len(a)).astype(np.float64)
    unknown = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return pa.array(sums, mask=unknown)


_SPARSE_DOT_UDF = None


def embedding_confidence(a: Column | str, b: Column | str, normalize: bool = False, sparse: bool = False) -> Column:
    """``(a·b + 1) / 2`` on raw vectors (``normalize=True`` uses unit vectors).

    ``sparse=True`` takes sparse vectors (see ``bucket_encoder``) and multiplies
    whole Arrow batches in Python, to the same sums."""
    if sparse:
        if normalize:
            raise ValueError("sparse vectors are taken as they are")
        global _SPARSE_DOT_UDF
        if _SPARSE_DOT_UDF is None:
            _SPARSE_DOT_UDF = F.arrow_udf(_sparse_dot, "double")
        return (_SPARSE_DOT_UDF(a, b) + 1) / 2
    if normalize:
        from labelforge.operators.vectors import l2_normalize

        a, b = l2_normalize(a), l2_normalize(b)
    return (dot(a, b) + 1) / 2


# ----------------------------------------------------------------- encoders

def hashed_encoder(num_features: int = 64) -> Callable[[DataFrame, str, str], DataFrame]:
    """T7 offline encoder: JVM-side tokenizer + feature hashing + L2 norm → array<double>."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
        nz = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)
        v = nz.transform(tf.transform(tok.transform(df)))
        return v.withColumn(out, vector_to_array("_vec")).drop("_tok", "_tf", "_vec")

    return encode


def bucket_encoder(dim: int = 64, sparse: bool = False) -> Callable[[DataFrame, str, str], DataFrame]:
    """T7 offline encoder: lower-cased letter/digit tokens are hashed to ``dim``
    buckets by the first 32 bits of their md5, counted, and L2-normalised →
    ``array<double>``; NULL gives zeros.  Simple enough to restate in SQL, so
    embeddings and everything built on them can be checked.

    Tokens are cut by JVM expressions; the counting is an Arrow batch function
    that encodes a text which a batch holds several times once.  ``sparse``
    vectors are ``binary``, a ``PLACE`` for each bucket that is not empty: a row
    carries a few bytes a token, where an array is copied bucket by bucket at
    every step between the JVM and Python."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        tokens = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")
        return df.withColumn(out, _buckets_udf(dim, sparse)(tokens))

    return encode


def jvm_bucket_encoder(dim: int = 64) -> Callable[[DataFrame, str, str], DataFrame]:
    """T7 offline encoder: the vectors of ``bucket_encoder`` without Python.  Every
    token of every row is hashed, so it is the slower one where words repeat."""
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        buckets = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("string"))
        named = df.withColumn("_tok", F.coalesce(buckets, F.array().cast("array<string>")))
        count = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_tok", outputCol="_tf")
        v = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0).transform(count.transform(named))
        return v.withColumn(out, vector_to_array("_vec")).drop("_tok", "_tf", "_vec")

    return encode


_BUCKET_UDFS: dict = {}


def _buckets_udf(dim: int, sparse: bool):
    """Blank-separated tokens → unit vector of their bucket counts (built lazily, as ``tf_cosine_udf``)."""
    if (dim, sparse) not in _BUCKET_UDFS:

        known: dict[str, int] = {}  # of one worker

        def bucket(token: str) -> int:
            i = known.get(token)
            if i is None:
                if len(known) >= TOKENS_REMEMBERED:
                    known.clear()
                i = known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
            return i

        def encode(texts: pa.Array) -> pa.Array:
            once = texts.dictionary_encode()
            n = len(once.dictionary) + 1  # the last row is that of NULL
            place = once.indices.fill_null(n - 1).to_numpy(zero_copy_only=False)
            tokens = pc.split_pattern(once.dictionary.cast(pa.large_string()), " ")
            rows = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
            words = tokens.flatten().dictionary_encode()
            each = words.dictionary.to_numpy(zero_copy_only=False)
            ids = np.array([bucket(t) if t else -1 for t in each], dtype=np.int64)[words.indices.to_numpy(zero_copy_only=False)]
            some = ids >= 0  # no token before a leading blank
            counts = np.bincount(rows[some] * dim + ids[some], minlength=n * dim).reshape(n, dim).astype(np.float64)
            unit = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-12)
            if sparse:
                row, bucket_of = np.nonzero(unit)
                places = np.empty(len(row), dtype=PLACE)
                places["place"], places["value"] = bucket_of, unit[row, bucket_of]
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32) * PLACE.itemsize
                return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(places)]).take(pa.array(place))
            offsets = pa.array(np.arange(len(place) + 1, dtype=np.int32) * dim)
            return pa.ListArray.from_arrays(offsets, pa.array(unit[place].reshape(-1)))

        _BUCKET_UDFS[dim, sparse] = F.arrow_udf(encode, "binary" if sparse else "array<double>")
    return _BUCKET_UDFS[dim, sparse]


def batch_encoder(encoder_factory: Callable[[], Callable[[pd.Series], list]]) -> Callable[[DataFrame, str, str], DataFrame]:
    """T7 remote/local model encoder: a batch function ``texts -> vectors``
    opened once per partition (Arrow batches via ``mapInPandas``)."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches):
            enc = encoder_factory()
            for pdf in batches:
                yield pdf.assign(**{out: list(enc(pdf[text]))})

        return df.mapInPandas(run, schema)

    return encode


def embed_text(df: DataFrame, text: str, encoder=None, out: str = "embedding", dedupe: bool = True) -> DataFrame:
    """Embed newline-flattened text with a pluggable encoder.

    ``dedupe=True`` embeds each distinct text once and joins the vectors back
    (the reference embeds the same context in each of 3 passes) — worth two
    text shuffles where the encoder is slow; ``dedupe=False`` embeds in place,
    without a shuffle: the faster form for the built-in ``bucket_encoder``."""
    from labelforge.functions.text import flatten_newlines

    encoder = encoder or bucket_encoder()
    if not dedupe:
        return encoder(df.withColumn("_flat", flatten_newlines(text)), "_flat", out).drop("_flat")
    distinct = df.select(flatten_newlines(text).alias("_key")).distinct()
    emb = encoder(distinct, "_key", out)
    flat = df.withColumn("_flat", flatten_newlines(text))
    # null-safe: a NULL text gets the encoder's answer for NULL, as in place
    return flat.join(emb, F.col("_flat").eqNullSafe(F.col("_key")), "left").drop("_flat", "_key")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a labelled table once to the shared checkpoint folder and read it
    back, so a non-deterministic teacher is called once per row."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
