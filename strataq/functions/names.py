"""What a text names, as columns: identifiers, quoted phrases, capitalised entities, and labels in comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many distinct identifiers and phrases of a text are looked up.
IDENTIFIERS, PHRASES = 40, 12
#: Shapes of identifiers, of quoted phrases and of entities.
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]+)*\b"
QUOTED = "[\"'`]([^\"'`]{3,120})[\"'`]"
ENTITIES = (
    r"\b[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b",
    r"\b[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3}\b",
    r"\b[A-Z]{2,}\b",
)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def is_identifier(word: Column) -> Column:
    """A word that only code has: an underscore, a dot or an inner capital, and three letters at least."""
    return (F.length(word) >= 3) & word.rlike(r"[_.]|[a-z][A-Z]")


def comparable(label: Column) -> Column:
    """A label in lower case with single blanks, without an article in front."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))
    return F.regexp_replace(spaced, "^(the|a|an) ", "")


def identifiers(text: Column, most: int = IDENTIFIERS) -> Column:
    """Identifiers of a text in lower case, in order, each once."""
    return F.slice(F.array_distinct(F.transform(F.filter(_found(text, IDENTIFIER), is_identifier), F.lower)), 1, most)


def phrases(text: Column, most: int = PHRASES) -> Column:
    """Quoted phrases in lower case, in order, each once."""
    trimmed = F.transform(_found(text, QUOTED, 1), lambda p: F.lower(F.trim(p)))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda p: F.length(p) >= 3)), 1, most)


def entities(text: Column) -> Column:
    """Comparable labels of capitalised runs: humped words first, then title case, then capitals alone."""
    every = F.concat(*[F.transform(_found(text, p), comparable) for p in ENTITIES])
    return F.array_distinct(F.filter(every, lambda label: label != ""))
