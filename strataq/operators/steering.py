"""Steering of retrieval by memory: rules in records, alias expansion, and what is worth merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MAX_ALIAS_TERMS = 8
STEERING_KINDS = ("alias", "preference", "exclusion")
ARROW = r"\s*(?:->|→|=>)\s*"


def terms(column: Column) -> Column:
    """Terms of a list with commas or semicolons: trimmed, without quotes, lower case, first ones of equals."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), "[,;]"), lambda p: F.lower(F.regexp_replace(F.trim(p), "^[`\"']+|[`\"']+$", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def parse_rules(records: DataFrame, kind: str = "kind", text: str = "text") -> DataFrame:
    """records with rule: struct(type, triggers, values), null where the text is no rule of its kind.

    alias: `term -> other, ...` in the first line; preference: `when: a, b -> prefer: x, y`; exclusion: `never: x, y`.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    line = F.regexp_extract(body, r"^([^\n]*)", 1)
    left = F.lower(F.regexp_replace(F.trim(F.regexp_extract(line, rf"^(.*?){ARROW}(.*)$", 1)), "^[`\"']+|[`\"']+$", ""))
    when_ = rf"(?i)\bwhen\s*:\s*([^\n]*?){ARROW}prefer\s*:\s*([^\n]+)"
    triggers = F.when(F.col(kind) == "alias", F.filter(F.array(left), lambda t: t != "")).when(F.col(kind) == "preference", terms(F.regexp_extract(body, when_, 1))).when(F.col(kind) == "exclusion", F.array().cast("array<string>"))
    values = (
        F.when(F.col(kind) == "alias", F.slice(terms(F.regexp_extract(line, rf"^(.*?){ARROW}(.*)$", 2)), 1, MAX_ALIAS_TERMS))
        .when(F.col(kind) == "preference", terms(F.regexp_extract(body, when_, 2)))
        .when(F.col(kind) == "exclusion", terms(F.regexp_extract(body, r"(?i)\bnever\s*:\s*([^\n]+)", 1)))
    )
    ok = (F.size(values) > 0) & ((F.size(triggers) > 0) | (F.col(kind) == "exclusion"))
    return records.withColumn("rule", F.when(ok, F.struct(F.col(kind).alias("type"), triggers.alias("triggers"), values.alias("values"))))


def fires(trigger: str, present: set[str]) -> bool:
    """A trigger fires if it is a token of the query or all its parts are."""
    parts = {p for p in re.split("[^A-Za-z0-9]+", trigger) if len(p) > 1}
    return trigger in present or bool(parts) and parts <= present


def expand(tokens: list[str], aliases: dict[str, list[str]]) -> list[str]:
    """Tokens of a query with the words of all aliases that they trigger; none is taken away."""
    present = set(tokens)
    more = {w for trigger, values in aliases.items() if fires(trigger, present) for value in values for w in re.split(r"[\s_\-]+", value.strip().lower()) if len(w) > 1}
    return sorted(present | more) if more else tokens


def merge_candidates(records: DataFrame, least_size: int = 3, most_jaccard: float = 0.55) -> DataFrame:
    """(scope, subject, kind, acl, size, mean_jaccard) of groups of live records about one subject that differ in words.

    The mean is over all pairs of a group, which a self-join on the group gives; groups are one subject's records.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    acl = F.when(F.col("scope") == "org", "*").otherwise(F.coalesce("written_by", F.lit("")))
    live = records.where(~F.col("kind").isin(*STEERING_KINDS) & (F.coalesce("tier", F.lit("")).isin("", "hot")) & (F.coalesce("subject", F.lit("")) != ""))
    own = live.select("record_id", "scope", "subject", "kind", acl.alias("acl"), words.alias("words"))
    key = ["scope", "subject", "kind", "acl"]
    sizes = own.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    x, y = own.join(sizes, key), own.select(*key, F.col("record_id").alias("other"), F.col("words").alias("others"))
    union = F.size(F.array_union("words", "others"))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("words", "others")) / union)
    means = x.join(y, key).where("record_id < other").groupBy(*key, "size").agg(F.round(F.avg(jaccard), 6).alias("mean_jaccard"))
    return means.where(F.col("mean_jaccard") <= most_jaccard)
