"""Words of identifiers and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case with dashes in place of all but letters, digits, dots, underscores and dashes; `item` if nothing is left."""
    dashed = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9._-]+", "-")
    bare = F.regexp_replace(F.regexp_replace(dashed, r"^[-._]+", ""), r"[-._]+$", "")
    return F.when(bare == "", "item").otherwise(bare)


def identifier_parts(name: Column) -> Column:
    """Parts of an identifier, at humps and at all but letters and digits; empty ones stay."""
    return F.split(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+")


def term(name: Column) -> Column:
    """An identifier as a phrase of slugs, one for each of its parts."""
    return F.array_join(F.transform(identifier_parts(name), slug), " ")


def without_markup(line: Column) -> Column:
    """A line of Markdown without code marks, links' targets and what stands around a heading."""
    bare = F.regexp_replace(F.regexp_replace(line, "`([^`]+)`", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"^[ #\t]+", ""), r"[ #\t]+$", "")
