"""Remote services whose items have rising numbers in groups (mailboxes, channels), as Spark data sources with offsets.

A Service is a small client that tasks get a copy of. register_service() makes it a data source of its own name, for
batches (spark.read) and streams (spark.readStream). Reads are planned from a listing of the groups: each partition is a
range of one group's numbers, so a group that holds most items is read by many tasks. An offset is {group: [epoch,
number]}; a group whose epoch has changed (a mailbox that was made anew) is read from its beginning. A stream's offsets
are in its checkpoint: a batch that failed is read again with the same ranges, what was saved is not, and the service is
told by done() what need not be kept. For batches, the caller keeps the offsets that new_items() gives with the rows.
"""

from __future__ import annotations

import email
import email.policy
import imaplib
import json
import os
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from strataq.session import ship_package

#: Numbers of a group that one task reads.
PER_TASK = 1000
Offsets = dict[str, list]


class Service(ABC):
    """A client; it is copied to tasks, so connections are made in its methods. Items begin with their group and number."""

    schema: str

    @abstractmethod
    def groups(self) -> list[tuple[str, str, int]]:
        """(group, epoch, greatest number) of all groups."""

    @abstractmethod
    def items(self, group: str, after: int, upto: int) -> Iterator[tuple]:
        """Items of a group with after < number <= upto."""

    def done(self, offsets: Offsets) -> None:
        """Everything up to these offsets has been taken over."""


@dataclass
class Range(InputPartition):
    group: str
    after: int
    upto: int

    def __init__(self, group: str, after: int, upto: int):
        self.group, self.after, self.upto = group, after, upto


def newest(service: Service) -> Offsets:
    return {group: [epoch, number] for group, epoch, number in service.groups()}


def ranges(start: Offsets, end: Offsets, size: int, groups: set[str] | None = None) -> list[Range]:
    """Ranges of at most size numbers from one offset to another."""
    out = []
    for group, (epoch, number) in sorted(end.items()):
        before = start.get(group)
        after = int(before[1]) if before and before[0] == epoch else 0
        if groups is None or group in groups:
            out += [Range(group, at, min(at + size, number)) for at in range(after, number, size)]
    return out


class _Reader(DataSourceReader):
    def __init__(self, service: Service, start: Offsets, end: Offsets | None, size: int):
        self.service, self.start, self.end, self.size, self.only = service, start, end, size, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Groups that a filter names are the only ones that are planned."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("group",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = own if self.only is None else self.only & own
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(self.start, newest(self.service) if self.end is None else self.end, self.size, self.only)

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is not None:  # where nothing is planned, Spark asks once for nothing
            yield from self.service.items(partition.group, partition.after, partition.upto)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, service: Service, size: int):
        self.service, self.size = service, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return newest(self.service)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return ranges(start, end, self.size)

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is not None:  # where nothing is planned, Spark asks once for nothing
            yield from self.service.items(partition.group, partition.after, partition.upto)

    def commit(self, end: dict) -> None:
        self.service.done(end)


def register_service(spark: SparkSession, name: str, service: Service) -> None:
    """Makes a service the data source `name`; options are per_task, and for batches offsets and until, as JSON."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # for pushFilters

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return service.schema

        def _size(self) -> int:
            return int(self.options.get("per_task", PER_TASK))

        def reader(self, schema) -> DataSourceReader:
            until = self.options.get("until")
            return _Reader(service, json.loads(self.options.get("offsets", "{}")), json.loads(until) if until else None, self._size())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(service, self._size())

    spark.dataSource.register(Source)


def new_items(spark: SparkSession, name: str, service: Service, saved: Offsets | None = None, **options) -> tuple[DataFrame, Offsets]:
    """Items beyond saved offsets, and the offsets to save once they have been taken over; these bound what is read."""
    until = newest(service)
    rows = spark.read.format(name).options(offsets=json.dumps(saved or {}), until=json.dumps(until), **options).load()
    return rows, until


def _connect(host: str, port: int) -> imaplib.IMAP4:
    return imaplib.IMAP4_SSL(host, port, timeout=60)


class Mailboxes(Service):
    """Messages of mailboxes by UID, their epoch being UIDVALIDITY; the environment variable secret_env holds user:password."""

    schema = "group string, number long, message_id string, subject string, sender string, recipients string, date string, text string"

    def __init__(self, host: str, mailboxes: list[str], secret_env: str, port: int = 993, connect=_connect):
        self.host, self.mailboxes, self.secret_env, self.port, self.connect = host, mailboxes, secret_env, port, connect

    def _session(self) -> imaplib.IMAP4:
        user, colon, password = os.environ.get(self.secret_env, "").partition(":")
        if not colon:
            raise ValueError(f"{self.secret_env} has to hold user:password")
        client = self.connect(self.host, self.port)
        client.login(user, password)
        return client

    def groups(self) -> list[tuple[str, str, int]]:
        client, out = self._session(), []
        try:
            for box in self.mailboxes:
                ok, data = client.status(box, "(UIDNEXT UIDVALIDITY)")
                if ok != "OK":
                    raise ConnectionError(f"no status of {box}")
                found = {k: v for k, v in re.findall(r"(UIDNEXT|UIDVALIDITY) (\d+)", data[0].decode())}
                out.append((box, found["UIDVALIDITY"], int(found["UIDNEXT"]) - 1))
        finally:
            client.logout()
        return out

    def items(self, group: str, after: int, upto: int) -> Iterator[tuple]:
        client = self._session()
        try:
            client.select(group, readonly=True)
            ok, data = client.uid("SEARCH", None, f"UID {after + 1}:{upto}")
            if ok != "OK":
                raise ConnectionError(f"no listing of {group}")
            # A range beyond the last message is answered with the last message.
            for uid in sorted(int(u) for u in (data[0] or b"").split() if after < int(u) <= upto):
                ok, parts = client.uid("FETCH", str(uid), "(BODY.PEEK[])")
                raw = next((bytes(p[1]) for p in parts or [] if isinstance(p, tuple)), None)
                if ok != "OK" or raw is None:
                    raise ConnectionError(f"no message {uid} of {group}")
                message = email.message_from_bytes(raw, policy=email.policy.default)
                body = message.get_body(("plain", "html"))
                head = [str(message.get(h) or "") for h in ("Message-ID", "Subject", "From", "To", "Date")]
                yield (group, uid, *head, body.get_content() if body is not None else "")
        finally:
            client.logout()
