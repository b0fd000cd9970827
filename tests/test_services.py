"""Data sources with offsets over a recorded service: ranges, what is read again after a failure, and what isn't."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strataq.sources import services
from strataq.sources.services import Mailboxes, Service, new_items, ranges, register_service


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


class Recorded(Service):
    """Groups as files of NDJSON; what was asked and acknowledged is logged."""

    schema = "group string, number long, text string"

    def __init__(self, folder):
        self.folder = folder

    def log(self, line):
        with open(f"{self.folder}/log", "a") as f:
            f.write(line + "\n")

    def logged(self, word):
        try:
            return [json.loads(x.split(" ", 1)[1]) for x in open(f"{self.folder}/log").read().splitlines() if x.startswith(word)]
        except FileNotFoundError:
            return []

    def write(self, group, epoch, count):
        with open(f"{self.folder}/{group}.json", "w") as f:
            json.dump([epoch, count], f)

    def groups(self):
        return [(n[:-5], *json.load(open(f"{self.folder}/{n}"))) for n in sorted(os.listdir(self.folder)) if n.endswith(".json")]

    def items(self, group, after, upto):
        self.log("read " + json.dumps([group, after, upto]))
        for i in range(after + 1, upto + 1):
            yield (group, i, f"{group} {i}")

    def done(self, offsets):
        self.log("done " + json.dumps(offsets))


@pytest.fixture
def service(tmp_path):
    out = Recorded(str(tmp_path))
    out.write("a", "1", 25)
    out.write("b", "1", 3)
    return out


def test_ranges():
    end = {"a": ["1", 25], "b": ["2", 3], "c": ["1", 0]}
    assert [(r.group, r.after, r.upto) for r in ranges({"a": ["1", 8], "b": ["1", 3]}, end, 10)] == [("a", 8, 18), ("a", 18, 25), ("b", 0, 3)]
    assert ranges(end, end, 10) == [] and [r.group for r in ranges({}, end, 100, {"b"})] == ["b"]


def test_batches_and_saved_offsets(spark, service):
    register_service(spark, "recorded", service)
    rows, offsets = new_items(spark, "recorded", service, per_task=10)
    service.write("a", "1", 99)  # comes after the offsets: not read, and not lost
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 28 and offsets == {"a": ["1", 25], "b": ["1", 3]}
    service.write("b", "2", 2)  # made anew
    rows, offsets = new_items(spark, "recorded", service, offsets)
    assert rows.groupBy("group").agg(F.min("number"), F.max("number")).orderBy("group").collect() == [("a", 26, 99), ("b", 1, 2)]
    rows, _ = new_items(spark, "recorded", service, offsets)
    assert rows.collect() == []


def test_a_filter_on_groups_plans_only_these(spark, service):
    register_service(spark, "recorded_groups", service)
    rows = spark.read.format("recorded_groups").load().where("group = 'b' AND number > 1")
    assert sorted(r["number"] for r in rows.collect()) == [2, 3]
    assert {r[0] for r in service.logged("read")} == {"b"}


def test_a_failed_batch_of_a_stream_is_read_again_once(spark, service, tmp_path):
    register_service(spark, "recorded_stream", service)
    state, got = {"fail": False}, []

    def take(batch, epoch):
        rows = [tuple(r)[:2] for r in batch.collect()]
        if state["fail"]:
            raise RuntimeError("broken off")
        got.append((epoch, sorted(rows)))

    def run():
        query = spark.readStream.format("recorded_stream").option("per_task", 10).load().writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    assert [len(rows) for _, rows in got] == [28]
    service.write("a", "1", 30)
    state["fail"] = True
    with pytest.raises(Exception, match="broken off"):
        run()
    service.write("a", "1", 40)  # while it was down
    state["fail"] = False
    run()  # what was planned before, and no more
    assert len(got) == 2
    run()
    assert [rows for _, rows in got[1:]] == [[("a", i) for i in range(26, 31)], [("a", i) for i in range(31, 41)]] and got[1][0] == 1
    run()
    assert len(got) == 3
    assert service.logged("done")[-1]["a"][1] >= 30


class Imap:
    """Messages by UID, as a server answers for them."""

    messages = {4: b"Message-ID: <x4>\r\nSubject: Four\r\nFrom: a@x\r\n\r\nbody four", 9: b"Message-ID: <x9>\r\nSubject: Nine\r\n\r\nbody nine"}

    def login(self, user, password):
        assert (user, password) == ("ana", "s:ecret")

    def logout(self):
        pass

    def select(self, box, readonly):
        assert readonly

    def status(self, box, what):
        return "OK", [f'"{box}" (UIDNEXT 10 UIDVALIDITY 77)'.encode()]

    def uid(self, verb, *args):
        if verb == "SEARCH":
            low = int(args[1].split()[1].split(":")[0])
            return "OK", [" ".join(str(u) for u in self.messages if u >= low or u == max(self.messages)).encode()]
        return "OK", [(b"head", self.messages[int(args[0])]), b")"]


def test_mailboxes(monkeypatch):
    box = Mailboxes("host", ["INBOX"], "BOX_LOGIN", connect=lambda host, port: Imap())
    with pytest.raises(ValueError):
        box.groups()
    monkeypatch.setenv("BOX_LOGIN", "ana:s:ecret")
    assert services.newest(box) == {"INBOX": ["77", 9]}
    found = list(box.items("INBOX", 0, 9))
    assert [(m[1], m[2], m[3], m[7].strip()) for m in found] == [(4, "<x4>", "Four", "body four"), (9, "<x9>", "Nine", "body nine")]
    assert list(box.items("INBOX", 9, 20)) == []
