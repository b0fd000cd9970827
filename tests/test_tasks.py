"""Debounced batches and queues: the rules, the fold over a table, and the stream over events out of order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strataq.streaming import events as streams
from strataq.streaming import tasks

S = tasks.SECOND


def run(fold, *events, until=None):
    return tasks.advance(fold, None, [(int(at * S), op) for at, op in events], None if until is None else int(until * S))[1]


def test_batches():
    fold = tasks.Debounce(2, 5)
    assert run(fold, (0, "x"), (1, "x"), (10, "x"), until=11) == [(3 * S, "batch", 2, 0)]
    assert run(fold, *((t, "x") for t in range(8)), until=100) == [(5 * S, "batch", 5, 0), (9 * S, "batch", 3, 5 * S)]  # never quiet
    assert run(tasks.Debounce(2, 1), (0, "x"), (1.5, "x"), until=9) == [(2 * S, "batch", 2, 0)]  # a window is as long as the quiet at least


def test_queue_rules():
    fold = tasks.Queue(attempts=2, visibility=10, retry=3)
    says = lambda *events, **k: [(at / S, what, n) for at, what, n, _ in run(fold, *events, **k)]
    assert says((0, "publish"), (1, "claim"), (2, "ack")) == [(0, "pending", 0), (1, "inflight", 1), (2, "done", 1)]
    # A dead worker's claim lapses and is given again; a live one isn't stolen, and a heartbeat keeps it.
    assert says((0, "publish"), (1, "claim"), (5, "claim"), (11, "claim"), until=30) == [(0, "pending", 0), (1, "inflight", 1), (11, "pending", 1), (11, "inflight", 2), (21, "pending", 2)]
    assert says((0, "publish"), (1, "claim"), (9, "heartbeat"), (15, "claim"), until=18) == [(0, "pending", 0), (1, "inflight", 1)]
    # A nack waits; the last one is the end, and a claim beyond it too.
    assert says((0, "publish"), (1, "claim"), (2, "nack"), (3, "claim"), (5, "claim"), (6, "nack"), (7, "publish"), (8, "claim")) == [(0, "pending", 0), (1, "inflight", 1), (2, "pending", 1), (5, "inflight", 2), (6, "dead", 2)]
    assert says((0, "publish"), (1, "claim"), (11, "claim"), (21, "claim")) [-1] == (21, "dead", 3)
    assert says((0, "publish"), (1, "claim"), (2, "claim"), (11, "claim"), (12, "nack"), (13, "replay"), (14, "claim"))[-2:] == [(13, "pending", 0), (14, "inflight", 1)]
    # Publishing again: nothing while it is open, and a new round when it is done, also when that has been forgotten.
    assert says((0, "publish"), (1, "publish"), (2, "claim"), (3, "ack"), (4, "publish")) == [(0, "pending", 0), (2, "inflight", 1), (3, "done", 1), (4, "pending", 0)]
    week = 8 * 86400
    assert says((0, "publish"), (2, "claim"), (3, "ack"), (week, "publish"))[-1] == (week, "pending", 0) and says((1, "claim"), (2, "nack"), (3, "ack")) == []


def made(n=400):
    rnd = random.Random(6)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    ops = ["publish", "claim", "claim", "heartbeat", "nack", "ack", "replay"]
    rows = [(f"k{rnd.randint(0, 8)}", start + dt.timedelta(seconds=rnd.choice([0, 0, 0.25]) + rnd.randint(0, 4000)), rnd.choice(ops)) for _ in range(n)]
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rnd.randint(-200, 200)))  # out of order by 400 seconds at most


@pytest.mark.parametrize("fold", [tasks.Debounce(20, 45), tasks.Queue(attempts=2, visibility=60, retry=10, keep=600)], ids=["debounce", "queue"])
def test_stream_equals_fold_on_events_out_of_order(spark, tmp_path, fold):
    rows = made()
    schema = "key string, at timestamp, op string"
    for i in range(0, len(rows), 80):
        spark.createDataFrame([*rows[i : i + 80], (None, rows[0][1], "claim")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streams.drain(tasks.streamed(source, fold, "500 seconds"), "append")
    until = int((max(r[1] for r in rows).timestamp() - 500) * 1000) * 1000
    plain = []
    for key in sorted({r[0] for r in rows}):
        own = sorted(((int(at.timestamp() * S), op) for k, at, op in rows if k == key), key=tasks._order(fold))
        plain += [(key, *r) for r in tasks.advance(fold, None, [e for e in own if e[0] <= until], until)[1]]
    table = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, tasks.folded(table, fold, until).collect())) == sorted(plain)
    assert sorted(map(tuple, found.collect())) == sorted(plain) and len(plain) > 60
    assert tasks.folded(table.limit(0), fold).collect() == []
    assert tasks.folded(table.where(F.col("key").isNull()), fold).collect() == []
