"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence.

A rule (host, path, verdict) fits a URL if the URL's host is the rule's host or a subdomain of it, and the URL's path
starts with the rule's path. Of the rules that fit, the longest (host and path together) decides; the default verdict
holds where none fits. The trie is broadcast only while the rules are at most BROADCAST_RULES; beyond that judge()
joins exploded host suffixes with the rules, so that no rule set is too large.

Null URL, or one without "://": host and path are empty. Empty hosts and labels fit no rule but one for the same empty
host. Repeated rows are judged each for itself; repeated rules count once, and of equal rules with different verdicts
"block" wins. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import ship_package

#: Rules up to which the trie is sent to every executor (some 100 MB at most).
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Nodes by reversed host labels; each has a tree of path segments, the last of which may be a beginning only."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {})
            if rest not in ends or verdict == "block":
                ends[rest] = (len(host) + len(path), host + path, verdict)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = (-1, None, None)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._longest(node, path.split("/"), best)
        return best[1], best[2]

    @staticmethod
    def _longest(node: dict, segments: list[str], best: tuple) -> tuple:
        for segment in segments:
            ends = node.get("ends")
            if ends:
                for rest, found in ends.items() if len(ends) < 8 else ((segment[:i], ends.get(segment[:i])) for i in range(len(segment) + 1)):
                    if found and segment.startswith(rest) and found[0] > best[0]:
                        best = found
            node = node.get(("path", segment))
            if node is None:
                break
        return best


def parts(urls: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path) by expressions that run in the JVM."""
    pattern = "://([^/?#]*)([^?#]*)"
    url = F.coalesce(urls[url_col].cast("string"), F.lit(""))
    return urls.select(
        urls[id_col].cast("long").alias("id"),
        F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"),
    )


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = BROADCAST_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) of every URL. rules: (host, path, verdict), as a list or a DataFrame."""
    split = parts(urls, id_col, url_col)
    if isinstance(rules, DataFrame):
        few = rules.limit(most + 1).count() <= most
        known = [tuple(r) for r in rules.select("host", "path", "verdict").collect()] if few else None
    else:
        known = rules if len(rules) <= most else None
        rules = None if known is not None else urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    if known is None:
        return _judge_by_join(split, rules, default).withColumnRenamed("id", id_col)
    ship_package(urls.sparkSession)
    trie = urls.sparkSession.sparkContext.broadcast(Trie(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.judge
        for batch in batches:
            found = [find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())], ["id", "host", "path", "rule", "verdict"])

    return split.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _judge_by_join(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule sets of any size: each host's suffixes meet the rules by equality, without a broadcast.

    Each row is joined with its own distinct (host, path), of which repeated rows make one.
    """
    distinct = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    offers = distinct.withColumn("suffix", F.explode(suffixes))
    known = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("start")).agg(F.max("verdict").alias("v"))
    length = F.length("suffix") + F.length("start")
    best = (
        offers.join(known, "suffix").where(F.expr("startswith(path, start)"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("suffix", "start").alias("rule"), F.col("v").alias("verdict")), F.struct(length, F.length("suffix"))).alias("b"))
    )
    return split.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
