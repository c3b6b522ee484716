"""Teacher calls in report order, with a stop at a report's first dead sentence
(T3) and a call budget that all running tasks share (T4).

Reports are dealt whole to tasks and read in order.  A task keeps some reports
open and sends the next call of each in one request, so a report never has two
calls under way and none is made after a failure that ends it, while requests
stay full.  Rows are read ahead up to a bound; a report longer than that is read
as its calls proceed.

With a budget the calls run in a barrier stage.  When a task has used up its
share, the tasks exchange what they have spent and what they want next, and all
of them derive the same shares of what is left.  A share is written to the shared folder before its
calls are made: a stage that runs again after a lost executor starts from what
the lost attempt may have spent.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from labelforge.operators.teacher import TeacherFactory, _chunked, _timed, materialize
from labelforge.session import scratch_path

#: Reports that a task has calls for at a time, and rows that it reads ahead.
OPEN_REPORTS = 256
READ_AHEAD = 10_000
#: Tries that a task asks for at first.  An exchange takes about a second: while a
#: share lasts less than ``SHARE_SECONDS``, the next one is twice as large.
LEASE = 4_096
SHARE_SECONDS = 20.0


def fair_shares(wants: list[int], attempts: int) -> list[int]:
    """``attempts`` dealt to those who want some: evenly, and what one leaves over goes to the others."""
    shares = [0] * len(wants)
    hungry = [i for i, w in enumerate(wants) if w > 0]
    while attempts and hungry:
        each = max(1, attempts // len(hungry))
        for i in hungry:
            got = min(each, wants[i] - shares[i], attempts)
            shares[i] += got
            attempts -= got
        hungry = [i for i in hungry if shares[i] < wants[i]]
    return shares


class _Ledger:
    """What each task attempt may have spent: a small file for each, in a folder of the stage."""

    def __init__(self, folder: str, me: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder.replace("file:///", "/").replace("file:/", "/"))
        self.fs.create_dir(self.base, recursive=True)
        self.file = f"{self.base}/{me}"

    def note(self, calls: int) -> None:
        with self.fs.open_output_stream(f"{self.file}.new") as out:
            out.write(str(calls).encode())
        try:
            self.fs.move(f"{self.file}.new", self.file)
        except OSError:  # a file system whose rename does not replace
            self.fs.delete_file(self.file)
            self.fs.move(f"{self.file}.new", self.file)

    def others(self, present: set[str]) -> int:
        """Calls of attempts that are not ``present``: those of a lost run of the stage."""
        from pyarrow import fs

        total = 0
        for info in self.fs.get_file_info(fs.FileSelector(self.base)):
            if not info.base_name.endswith(".new") and info.base_name not in present:
                with self.fs.open_input_stream(info.path) as source:
                    total += int(source.read())
        return total


class _Gate:
    """A task's view of the shared budget; every task asks in every round."""

    def __init__(self, budget: int, most: int, folder: str):
        from pyspark import BarrierTaskContext

        self.context = BarrierTaskContext.get()
        self.me, self.most, self.spent, self.over = self.context.partitionId(), most, 0, False
        name = str(self.context.taskAttemptId())
        self.ledger = _Ledger(folder, name)
        self.budget = budget - self.ledger.others(set(self.context.allGather(name)))
        self.context.barrier()  # all have read before one notes

    def grant(self, want: int, alive: bool) -> int:
        said = [json.loads(m) for m in self.context.allGather(json.dumps([self.spent, want, alive]))]
        attempts = max(0, self.budget - sum(s for s, *_ in said)) // self.most
        if not attempts or not any(a for *_, a in said):
            self.ledger.note(self.spent)
            self.over = True
            return 0
        mine = fair_shares([w for _, w, _ in said], attempts)[self.me]
        self.ledger.note(self.spent + mine * self.most)
        return mine


class _Report:
    """The rows of one report that are read and not yet answered."""

    def __init__(self):
        self.rows: deque = deque()
        self.sentence = None
        self.answered: list[dict] = []  # of the current sentence
        self.attempts = self.calls = self.errors = 0
        self.due = 0.0
        self.dead: str | None = None


def ordered_calls(plan: DataFrame, prompt: str, teacher: TeacherFactory, keep: list[str], report: list[str], sentence: str = "sentence_index",
                  order: tuple[str, ...] = ("pass",), max_errors: int = 50, validate: Callable[[str], bool] | None = None, wait: float = 0.0,
                  max_wait: float = 60.0, timeout: float | None = None, request_batch: int | None = None, tasks: int | None = None,
                  budget: int | None = None, chat_calls: int = 1, reply_calls: int = 2, open_reports: int = OPEN_REPORTS,
                  read_ahead: int = READ_AHEAD, lease: int = LEASE) -> DataFrame:
    """``keep`` plus ``raw_ai_output, attempts, calls, error`` of every row
    whose call was made, report by report in the order ``sentence, *order``.

    A call fails by an exception, by a reply that ``validate`` rejects or by
    ``timeout``; it is sent again, after ``wait * 2 ** (n - 1)`` seconds at
    most ``max_wait``, until the failures of its sentence exceed ``max_errors``.
    Then the report ends: no further call of it is made, all rows of that
    sentence come back with ``error`` and without reply, and its later
    sentences do not come back.

    A try costs ``chat_calls``, an answered row ``reply_calls`` on top (what its
    embeddings will cost).  With a ``budget`` no call is made that might exceed
    it together with all other tasks' calls, answered rows are complete, and the
    result is written once and read back.  A report is one task's work from its
    first sentence to its last, whatever its length.

    NULL prompts are sent as they are; an empty plan gives an empty result."""
    spark = plan.sparkSession
    parts = tasks or (spark.sparkContext.defaultParallelism if budget is not None else int(spark.conf.get("spark.sql.shuffle.partitions")))
    lost = [c for c in (*report, sentence, *order) if c not in keep]
    if lost:
        raise ValueError(f"columns {lost} must be kept")
    src = plan.select(*keep, F.col(prompt).alias("_prompt")).repartition(parts, *report).sortWithinPartitions(*report, sentence, *order)
    schema = src.select(*keep, F.lit(None).cast("string").alias("raw_ai_output"), F.lit(0).alias("attempts"), F.lit(0).alias("calls"),
                        F.lit(None).cast("string").alias("error")).schema
    arrow, most = to_arrow_schema(schema), chat_calls + reply_calls
    folder = scratch_path(spark, "call-ledger") if budget is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = teacher()
        gate = _Gate(budget, most, folder) if budget is not None else None
        source = (row for batch in batches for row in batch.to_pylist())
        held: dict[tuple, _Report] = {}
        out: list[dict] = []
        last, n_held, ended, granted = None, 0, False, 0
        share, since = lease, time.monotonic()

        def finished(r: _Report) -> None:
            """The current sentence of ``r`` is over."""
            out.extend(r.answered)
            r.answered, r.errors = [], 0

        def drop(r: _Report) -> int:
            """Rows of a dead report: those of the dead sentence come back with the error."""
            for row in r.rows:
                if row[sentence] == r.sentence:
                    out.append(row | {"raw_ai_output": None, "attempts": 0, "calls": 0, "error": r.dead})
            n = len(r.rows)
            r.rows.clear()
            return n

        while True:
            while not ended and n_held < read_ahead and len(held) <= open_reports:
                row = next(source, None)
                if row is None:
                    ended = True
                    break
                key = tuple(row[c] for c in report)
                if key != last:
                    if last in held and not held[last].rows:
                        finished(held.pop(last))
                    last = key
                    held[key] = _Report()
                row_of = held[key]
                row_of.rows.append(row)
                n_held += 1
                if row_of.dead is not None:
                    n_held -= drop(row_of)
            for key in [k for k, r in held.items() if not r.rows and (k != last or ended)]:
                finished(held.pop(key))
            now = time.monotonic()
            wave = [r for r in held.values() if r.rows and r.due <= now]
            alive = bool(held) or not ended
            if gate is not None:
                if granted == 0 or n_held == 0:
                    if granted == 0 and n_held and time.monotonic() - since < SHARE_SECONDS:
                        share *= 2
                    # what a task has no rows for goes back at the next exchange
                    granted = gate.grant(min(n_held, share) if ended else share, alive)
                    if gate.over:
                        break
                    since = time.monotonic()
                wave = wave[:granted]
                granted -= len(wave)
            elif not alive:
                break
            if not wave:
                later = [r.due for r in held.values() if r.rows]
                if later:
                    time.sleep(max(min(later) - now, 0.0))
            else:
                for r in wave:
                    if r.rows[0][sentence] != r.sentence:
                        finished(r)
                        r.sentence = r.rows[0][sentence]
                prompts = pd.Series([r.rows[0]["_prompt"] for r in wave], dtype=object)
                replies = _chunked(lambda p: _timed(call, p, timeout), prompts, request_batch)
                spent = 0
                for r, reply in zip(wave, replies, strict=True):
                    r.attempts += 1
                    r.calls += chat_calls
                    spent += chat_calls
                    if not isinstance(reply, BaseException) and validate is not None and not validate(reply):
                        reply = ValueError("reply is not one JSON object")
                    if not isinstance(reply, BaseException):
                        spent += reply_calls
                        r.answered.append(r.rows.popleft() | {"raw_ai_output": reply, "attempts": r.attempts, "calls": r.calls + reply_calls, "error": None})
                        n_held -= 1
                        r.attempts = r.calls = 0
                        r.due = 0.0
                        continue
                    r.errors += 1
                    if r.errors <= max_errors:
                        r.due = time.monotonic() + min(wait * 2 ** min(r.errors - 1, 30), max_wait) if wait else 0.0
                        continue
                    r.dead = f"{type(reply).__name__}: {reply}"
                    tried = r.rows.popleft() | {"raw_ai_output": None, "attempts": r.attempts, "calls": r.calls, "error": r.dead}
                    out.extend(a | {"raw_ai_output": None, "error": r.dead} for a in r.answered)
                    out.append(tried)
                    r.answered = []
                    n_held -= 1 + drop(r)
                if gate is not None:
                    gate.spent += spent
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([{f: row[f] for f in arrow.names} for row in out], schema=arrow)
                out.clear()
        for r in held.values():
            out.extend(r.answered)
        yield pa.RecordBatch.from_pylist([{f: row[f] for f in arrow.names} for row in out], schema=arrow)

    made = src.mapInArrow(run, schema, barrier=budget is not None)
    return materialize(made, "budgeted_calls") if budget is not None else made
