"""Paths: glob filters, pruning, kinds of files, and references from one file to another.

References are resolved by equality joins: every file is entered under each suffix of its path (a file at depth d has d),
so a target meets the files that end with it without a comparison of all pairs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a scan leaves out, first for its cost, then for its secrets.
NOISE = """
    **/.git/** **/node_modules/** **/__pycache__/** **/.venv/** **/venv/** **/dist/** **/build/** **/target/** **/.next/** **/.cache/**
    **/.tox/** **/.gradle/** **/.terraform/** **/.mypy_cache/** **/.pytest_cache/** **/.ruff_cache/**
    """.split()
SECRETS = """
    **/.env **/.env.* **/*.envrc
    **/*id_rsa* **/*id_dsa* **/*id_ecdsa* **/*id_ed25519* **/*.pem **/*.key **/*.p12 **/*.pfx **/*.jks **/*.keystore **/*.asc **/*.gpg
    **/.ssh/** **/.gnupg/** **/.aws/** **/.azure/** **/.kube/** **/.docker/config.json **/.config/gh/** **/.config/gcloud/** **/.netrc **/.npmrc
    **/.pypirc **/.git-credentials **/credentials **/credentials.json **/secrets.yaml **/secrets.yml **/*.kdbx
    **/Library/Keychains/** **/.mozilla/** **/.password-store/**
    """.split()
#: Kinds of files by extension.
KINDS = {
    "document": ("pdf", "docx", "pptx", "xlsx", "doc", "rtf", "epub"),
    "image": ("png", "jpg", "jpeg", "webp", "gif"),
    "audio": ("wav", "mp3", "m4a", "flac", "ogg"),
    "markdown_note": ("md",),
}


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for whole strings; * and ? cross slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2)
        if c == "[" and end > 0:
            inner = pattern[i + 1 : end].replace("\\", r"\\").replace("[", r"\[")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "(?s)^(?:" + re.sub(r"(?:\.\*)+", ".*", "".join(out)) + ")$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether some pattern matches the path, or the path with a slash before it."""
    both = [path.rlike(glob_regex(p)) | F.concat(F.lit("/"), path).rlike(glob_regex(p)) for p in patterns]
    return reduce(lambda a, b: a | b, both, F.lit(False))


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    return (matches_any(path, include) if include else F.lit(True)) & ~matches_any(path, exclude)


def prunable(directory: Column, exclude: list[str]) -> Column:
    """Whether nothing below the directory can be selected: it is excluded, or all below it is."""
    return matches_any(directory, [*exclude, *(p[:-3] for p in exclude if p.endswith("/**"))])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def kind_of(path: Column, source_type: Column | None = None) -> Column:
    """Kind of artifact by extension; files of a memory source are records."""
    out = F.lit("file")
    for kind, ends in KINDS.items():
        out = F.when(extension(path).isin(*ends), kind).otherwise(out)
    return out if source_type is None else F.when(source_type == "memory", "memory_record").otherwise(out)


def suffixes(path: Column) -> Column:
    """A path and all that is left of it as directories are taken off."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _first_rung(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path) for candidates (ref, rung, name, whole): files of the least rung with any; whole paths before suffixes."""
    entered = files.select("path", F.posexplode(suffixes(F.col("path"))).alias("off", "name"))
    found = candidates.join(entered, "name").where((F.col("off") == 0) | ~F.col("whole"))
    level = F.struct("rung", (F.col("off") > 0).alias("tail"))
    best = found.withColumn("level", level).withColumn("least", F.min("level").over(W.partitionBy("ref")))
    return best.where("level = least").select("ref", "path").distinct()


def resolve_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path) of refs(ref, target): the file at the target, else all files whose paths end with it."""
    name = F.regexp_replace(F.regexp_replace("target", r"\\", "/"), "^(?:/|\\./)+", "")
    return _first_rung(refs.select("ref", F.lit(0).alias("rung"), name.alias("name"), F.lit(False).alias("whole")).where("name <> ''"), files)


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path) of refs(ref, target) with dotted modules: the module's file, else its package's."""
    base = F.array_join(F.filter(F.split("target", r"[./\\]"), lambda p: p != ""), "/")
    rung = F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("rung", "name")
    return _first_rung(refs.where(base != "").select("ref", rung).withColumn("whole", F.lit(False)), files)


def resolve_links(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path) of refs(ref, target) with links in documents, without anchors and questions.

    In order: the very path; with .md or .txt where the link has no extension; files whose paths end with the link.
    """
    name = F.ltrim(F.trim(F.regexp_extract("target", r"^([^#?]*)", 1)), F.lit("./"))
    last = F.element_at(F.split(name, "/"), -1)
    bare = ~F.contains(last, F.lit("."))
    tries = F.array(
        F.struct(F.lit(0).alias("rung"), name.alias("name"), F.lit(True).alias("whole")),
        F.when(bare, F.struct(F.lit(1).alias("rung"), F.concat(name, F.lit(".md")).alias("name"), F.lit(True).alias("whole"))),
        F.when(bare, F.struct(F.lit(2).alias("rung"), F.concat(name, F.lit(".txt")).alias("name"), F.lit(True).alias("whole"))),
        F.struct(F.lit(3).alias("rung"), name.alias("name"), F.lit(False).alias("whole")),
    )
    local = refs.where(~F.col("target").rlike("^(?:https?://|mailto:)") & (name != ""))
    return _first_rung(local.select("ref", F.explode(F.array_compact(tries)).alias("t")).select("ref", "t.*"), files)
