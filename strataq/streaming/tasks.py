"""Folds over the events of a key in the order of their times, with deadlines of their own: batches of changes, task queues.

A fold is plain logic over one key's state; it runs in two ways with the same results:

* folded(): over a table, sorted by key and time within partitions; a task holds one state at a time.
* streamed(): over a stream by transformWithState. Events wait in state until the watermark has passed them, so those that
  come out of order are folded in order; later ones are dropped with the watermark. A timer for each key stands at its
  next waiting event or deadline, so a batch closes, or a claim lapses, without any event. Keys without a pending deadline
  or event leave no state, but for what the fold still needs.

Times are microseconds. Events of one time are in the order of their op's rank in the fold, then by op.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strataq.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
#: What a fold yields: when, a word, and two numbers.
OUT = "at long, what string, n long, since long"
Row = tuple[int, str, int, int]


class Debounce:
    """Batches of changes: a batch is due when nothing has come for `quiet` seconds, or `window` seconds after its first.

    Yields (due, 'batch', number of events, first event) for each batch.
    """

    ranks: tuple[str, ...] = ()

    def __init__(self, quiet: float, window: float):
        self.quiet, self.window = int(quiet * SECOND), int(max(window, quiet) * SECOND)

    def due(self, state: dict | None) -> int | None:
        return min(state["last"] + self.quiet, state["first"] + self.window) if state else None

    def pass_to(self, state: dict | None, until: int) -> tuple[dict | None, list[Row]]:
        due = self.due(state)
        return (None, [(due, "batch", state["n"], state["first"])]) if due is not None and due <= until else (state, [])

    def step(self, state: dict | None, at: int, op: str) -> tuple[dict | None, list[Row]]:
        return ({"first": at, "last": at, "n": 1} if state is None else state | {"last": at, "n": state["n"] + 1}), []


class Queue:
    """A task of a queue: publish, claim, heartbeat, nack, ack and replay; yields (at, status, attempts, 0) when its status changes.

    A claim that isn't renewed for `visibility` seconds lapses, and the task is pending again; a nack puts it off for
    `retry` seconds. A task fails for good at a nack of its last attempt, or at a claim beyond it, and stays dead until it
    is replayed. Publishing re-arms done tasks only. Done tasks are forgotten after `keep` seconds.
    """

    ranks = ("publish", "replay", "claim", "heartbeat", "nack", "ack")

    def __init__(self, attempts: int = 3, visibility: float = 300, retry: float = 30, keep: float = 7 * 86400):
        self.attempts, self.visibility, self.retry, self.keep = attempts, int(visibility * SECOND), int(retry * SECOND), int(keep * SECOND)

    def due(self, state: dict | None) -> int | None:
        if state and state["status"] == "inflight":
            return state["visible"]
        return state["visible"] + self.keep if state and state["status"] == "done" else None

    def pass_to(self, state: dict | None, until: int) -> tuple[dict | None, list[Row]]:
        due = self.due(state)
        if due is None or due > until:
            return state, []
        if state["status"] == "done":
            return None, []
        return state | {"status": "pending"}, [(due, "pending", state["tries"], 0)]

    def step(self, state: dict | None, at: int, op: str) -> tuple[dict | None, list[Row]]:
        status, tries = (state["status"], state["tries"]) if state else (None, 0)
        new = None
        if op == "publish" and status in (None, "done"):
            new = {"status": "pending", "tries": 0, "visible": at}
        elif op == "replay" and status == "dead":
            new = {"status": "pending", "tries": 0, "visible": at}
        elif op == "claim" and status == "pending" and state["visible"] <= at:
            over = tries + 1 > self.attempts
            new = {"status": "dead" if over else "inflight", "tries": tries + 1, "visible": at + self.visibility}
        elif op == "heartbeat" and status == "inflight":
            return state | {"visible": at + self.visibility}, []
        elif op == "nack" and status in ("pending", "inflight"):
            new = {"status": "dead" if tries >= self.attempts else "pending", "tries": tries, "visible": at + self.retry}
        elif op == "ack" and status is not None and status != "done":
            new = {"status": "done", "tries": tries, "visible": at}
        if new is None:
            return state, []
        return new, [(at, new["status"], new["tries"], 0)]


def advance(fold, state: dict | None, events: list[tuple[int, str]], until: int | None) -> tuple[dict | None, list[Row]]:
    """State and rows after events, which are in order, and then up to an instant; deadlines come before events of their time."""
    out: list[Row] = []
    for at, op in [*events, (until, None)] if until is not None else events:
        while True:
            before = state
            state, rows = fold.pass_to(state, at)
            out += rows
            if state is before:
                break
        if op is not None:
            state, rows = fold.step(state, at, op)
            out += rows
    return state, out


def _order(fold):
    rank = {op: i for i, op in enumerate(fold.ranks)}
    return lambda e: (e[0], rank.get(e[1], len(rank)), e[1])


def folded(events: DataFrame, fold, until: int | None = None) -> DataFrame:
    """(key, at, what, n, since) of events(key, at: timestamp, op), up to an instant; rows with a null are left out."""
    ship_package(events.sparkSession)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(op) for op in fold.ranks] or [F.lit("")]), F.col("op")), F.lit(0))
    rows = events.where("key IS NOT NULL AND at IS NOT NULL AND op IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.unix_micros("at").alias("us"), "op", F.when(rank > 0, rank).otherwise(len(fold.ranks) + 1).alias("rank"))
    rows = rows if until is None else rows.where(F.col("us") <= until)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            keys, us, ops = (batch.column(i).to_pylist() for i in range(3))
            starts = [0, *(np.flatnonzero(np.array(keys[1:]) != np.array(keys[:-1])) + 1).tolist(), len(keys)]
            for begin, end in zip(starts, starts[1:], strict=False):
                if begin == end:
                    continue
                if keys[begin] != key:
                    out += [(key, *r) for r in advance(fold, state, [], until)[1]] if key is not None else []
                    key, state = keys[begin], None
                state, rows = advance(fold, state, list(zip(us[begin:end], ops[begin:end], strict=True)), None)
                out += [(key, *r) for r in rows]
            yield from _batch(out)
        if key is not None:
            yield from _batch([(key, *r) for r in advance(fold, state, [], until)[1]])

    return rows.repartition("key").sortWithinPartitions("key", "us", "rank", "op").mapInArrow(run, f"key string, {OUT}")


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "at", "what", "n", "since"])


class _Processor(StatefulProcessor):
    """Waiting events as a list, and the fold's state and the timer as one value."""

    def __init__(self, fold):
        self.fold = fold

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, op string")
        self.value = handle.getValueState("value", "text string")

    def _load(self) -> tuple[dict | None, int | None]:
        found = json.loads(self.value.get()[0]) if self.value.exists() else {}
        return found.get("state"), found.get("timer")

    def _save(self, state: dict | None, old: int | None, next_us: int | None) -> None:
        timer = None if next_us is None else -(-next_us // 1000)
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        if state is None and timer is None:
            self.value.clear()
        else:
            self.value.update((json.dumps({"state": state, "timer": timer}),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, timer = self._load()
        came = [(int(us), str(op)) for frame in rows for us, op in zip(frame["us"], frame["op"], strict=True)]
        if came:
            self.waiting.appendList(came)
            first = min(us for us, _ in came)
            self._save(state, timer, first if timer is None else min(first, timer * 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, _ = self._load()
        until = timerValues.getCurrentWatermarkInMs() * 1000
        events = [(e[0], e[1]) for e in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((e for e in events if e[0] <= until), key=_order(self.fold))
        later = [e for e in events if e[0] > until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        state, out = advance(self.fold, state, ready, until)
        due = self.fold.due(state)
        # The timer that has expired is gone by itself.
        self._save(state, None, min([*(e[0] for e in later), *([] if due is None else [due])], default=None))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "at", "what", "n", "since"])

    def close(self) -> None:
        pass


def streamed(events: DataFrame, fold, delay: str = "1 hour") -> DataFrame:
    """(key, at, what, n, since) of a stream of events(key, at, op); drain it in append mode."""
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("key IS NOT NULL AND at IS NOT NULL AND op IS NOT NULL").withWatermark("at", delay)
    keyed = rows.select(F.col("key").cast("string").alias("key"), "at", F.unix_micros("at").alias("us"), "op")
    return keyed.groupBy("key").transformWithStateInPandas(_Processor(fold), f"key string, {OUT}", "Append", "EventTime")
