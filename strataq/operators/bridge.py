"""Edges from memory records to what they speak of, and between records that correct or cover each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions import names

#: Signals from the strongest, with the confidence of an edge that is drawn by each.
CONFIDENCE = {"reference": 1.0, "symbol": 0.8, "heading": 0.7, "entity": 0.5}
MAX_TARGETS = 3
_RUNGS = list(CONFIDENCE)


def _placed(rung: int, candidates: Column) -> Column:
    """(rung, place, name) of what a text names."""
    return F.transform(candidates, lambda name, place: F.struct(F.lit(rung).alias("rung"), place.alias("place"), (name if rung == 1 else names.comparable(name)).alias("name")))


def about_edges(records: DataFrame, references: DataFrame, symbols: DataFrame, headings: DataFrame, entities: DataFrame, most: int = MAX_TARGETS) -> DataFrame:
    """(record_id, target, signal, confidence): of each record the first signal with any target, and its first targets.

    records(record_id, text); references(record_id, target); symbols, headings and entities (label, target). Targets come
    in the order in which the text names them, those of one name by id. A record's first `most` targets hold at most
    `most` of those of one name, the least, so names with many targets are cut to these before the join: what is joined
    grows with the names in texts, however common a name is. Null labels, targets, ids and texts match nothing.
    """
    by_label = None
    for rung, table in enumerate((symbols, headings, entities), 1):
        key = F.lower("label") if rung == 1 else names.comparable(F.col("label"))
        part = table.select(F.lit(rung).alias("rung"), key.alias("name"), "target").where("name <> '' AND target IS NOT NULL")
        by_label = part if by_label is None else by_label.unionByName(part)
    least = W.partitionBy("rung", "name").orderBy("target")
    targets = by_label.distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= most).drop("n")
    known = records.where("record_id IS NOT NULL").select("record_id", "text")
    named = F.concat(*[_placed(rung, candidates) for rung, candidates in enumerate((names.identifiers(F.col("text")), names.phrases(F.col("text")), names.entities(F.col("text"))), 1)])
    found = known.select("record_id", F.explode(named).alias("c")).select("record_id", "c.*").join(targets, ["rung", "name"]).select("record_id", "rung", "place", "target")
    explicit = references.where("target IS NOT NULL").join(known.select("record_id").distinct(), "record_id", "left_semi").select("record_id", F.lit(0).alias("rung"), F.lit(0).alias("place"), "target")
    each = found.unionByName(explicit).groupBy("record_id", "rung", "target").agg(F.min("place").alias("place"))
    of_rung = W.partitionBy("record_id").orderBy("rung")
    first = W.partitionBy("record_id").orderBy("rung", "place", "target")
    ranked = each.withColumn("r", F.dense_rank().over(of_rung)).withColumn("n", F.row_number().over(first)).where((F.col("r") == 1) & (F.col("n") <= most))
    signal = F.element_at(F.array(*[F.lit(s) for s in _RUNGS]), F.col("rung") + 1)
    confidence = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE.values()]), F.col("rung") + 1)
    return ranked.select("record_id", "target", signal.alias("signal"), confidence.alias("confidence"))


def coverage(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(signal, records): how many records each signal connects; those that none connects are `unbridged`."""
    by = edges.select("record_id", "signal").distinct()
    return records.select("record_id").distinct().join(by, "record_id", "left").groupBy(F.coalesce("signal", F.lit("unbridged")).alias("signal")).agg(F.count("*").alias("records"))


def succession(records: DataFrame, pointer: str, outward: bool = True) -> DataFrame:
    """(from_record, to_record) of records that name another one in a column, where that one is there.

    outward: from the record to the one it names (supersedes); else from the named one (subsumed_by).
    """
    ends = records.where(F.coalesce(F.col(pointer), F.lit("")) != "").select("record_id", F.col(pointer).alias("named"))
    there = ends.join(records.select(F.col("record_id").alias("named")).distinct(), "named", "left_semi")
    pair = ["record_id", "named"] if outward else ["named", "record_id"]
    return there.select(F.col(pair[0]).alias("from_record"), F.col(pair[1]).alias("to_record"))
