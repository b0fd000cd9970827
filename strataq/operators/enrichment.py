"""Enrichment that needs Python: code symbols, text normalisation, MinHash, k-means, HTML. All in Arrow batches."""

from __future__ import annotations

import ast
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.session import ship_package


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def synthetic_modules(nation: DataFrame) -> DataFrame:
    """(id, text): a small Python module for each row, so that code enrichment has input."""
    name = F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_"))
    body = F.concat(F.lit("import os\nfrom math import sqrt\n\nLIMIT = "), F.col("n_nationkey"), F.lit("\n\nclass "), F.initcap("n_name"), F.lit("Store:\n    def load(self):\n        return sqrt(LIMIT)\n\ndef "), name, F.lit("(x):\n    return os.path.join(x)\n"))
    return nation.select(F.col("n_nationkey").cast("long").alias("id"), F.regexp_replace(body, "class ([A-Za-z]+) ([A-Za-z]+)Store", "class $1$2Store").alias("text"))


def symbols_of(source: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of imports, classes, functions, constants and calls; nothing for text that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("import", a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(("import", node.module or "", node.lineno))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", node.name, node.lineno))
        elif isinstance(node, ast.Assign):
            out += [("constant", t.id, node.lineno) for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
        elif isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            out.append(("call", name, node.lineno))
    return sorted(out, key=lambda s: (s[2], s[0], s[1]))


def python_symbols(modules: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *s) for i, t in zip(batch["id"], batch["text"], strict=True) for s in symbols_of(t or "")], columns=["id", "kind", "name", "line"])

    return _rows(modules, "id", "text").mapInPandas(run, "id long, kind string, name string, line long")


#: What frames a statement.
FRAMES = ("note that", "please note", "remember that", "just so you know", "for the record", "for reference", "heads up", "fyi", "reminder")
FRAMING = re.compile("^(" + "|".join(FRAMES) + r")[ \t:,\-–—]*")
#: Of the rules of normalize(); a part of every key, so that keys of other rules differ.
NORMALIZER = 1
ARTICLE = re.compile(r"^(the|a|an)\s+")


def normalize(text: str) -> str:
    """Comparable form of a statement: compatibility form, folded case, single blanks, no end marks, framing or article."""
    value = " ".join(unicodedata.normalize("NFKC", text).casefold().split()).rstrip(".!?,;: ")
    return ARTICLE.sub("", FRAMING.sub("", value, count=1), count=1).strip()


def canonical_key(scope: str, subject: str | None, kind: str, written_by: str | None, text: str) -> str:
    """The key that records share that say the same: records for all share one, others only with their writer's."""
    acl = "*" if scope == "org" else written_by or ""
    key = f"v{NORMALIZER}|{scope}|{subject or ''}|{kind}|{acl}|{normalize(text)}"
    return hashlib.blake2b(key.encode(), digest_size=8).hexdigest()


def folded(records: DataFrame) -> DataFrame:
    """(record_id, canon_key, kept_id): of records with equal keys the first asserted is kept."""
    spark = records.sparkSession
    ship_package(spark)
    names = ["record_id", "scope", "subject", "kind", "written_by", "text", "asserted_at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [canonical_key(*(None if pd.isna(x) else x for x in row[:-1]), row[-1] or "") for row in batch[names[1:6]].itertuples(index=False)]
            yield batch[["record_id", "asserted_at"]].assign(canon_key=keys)

    keyed = records.select(*names).mapInPandas(run, "record_id string, asserted_at string, canon_key string")
    first = keyed.groupBy("canon_key").agg(F.min_by("record_id", F.struct("asserted_at", "record_id")).alias("kept_id"))
    return keyed.join(first, "canon_key").select("record_id", "canon_key", "kept_id")


def normalized(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, normalized, canon_key): equal keys mean equal statements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [normalize(t or "") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "normalized": found, "canon_key": [hashlib.blake2b(x.encode(), digest_size=8).hexdigest() for x in found]})

    return _rows(records, id_col, text_col).mapInPandas(run, "id string, normalized string, canon_key string").withColumnRenamed("id", id_col)


PERMUTATIONS = 128


def minhash(docs: DataFrame, group: str, text_col: str) -> DataFrame:
    """(group, signature): 128 least hashes of a group's words, as hex; partial minima are taken in each partition."""
    words = docs.select(F.col(group).alias("g"), F.explode(F.array_distinct(F.split(F.lower(text_col), "[^a-z0-9]+"))).alias("w")).where("w <> ''").distinct()
    hashes = F.array(*[F.xxhash64(F.lit(i), "w") for i in range(PERMUTATIONS)])
    least = words.select("g", F.posexplode(hashes).alias("i", "h")).groupBy("g", "i").agg(F.min("h").alias("h"))
    return least.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: F.lower(F.hex(x["h"]))), ",").alias("signature")).withColumnRenamed("g", group)


def kmeans(rows: DataFrame, k: int, rounds: int = 25) -> DataFrame:
    """(cluster, size): Lloyd's algorithm from the k vectors of least hashed id; only k centroids reach the driver."""
    ship_package(rows.sparkSession)
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).select("embedding").collect()
    centers = np.array([r["embedding"] for r in first], float)

    def assign(shared, final: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                x = np.array(batch["embedding"].tolist(), float).reshape(len(batch), -1)
                if len(x):
                    near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"cluster": np.arange(len(c)), "n": n, "total": total.tolist()})

        return run

    for _ in range(rounds):
        sums = rows.select("embedding").mapInPandas(assign(spark.sparkContext.broadcast(centers), False), "cluster int, n long, total array<double>")
        parts = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(centers.shape[1])]).orderBy("cluster").collect()
        new = np.array([[r[f"t{i}"] / r["n"] for i in range(centers.shape[1])] if r["n"] else centers[r["cluster"]] for r in parts])
        if np.allclose(new, centers):
            break
        centers = new
    return spark.createDataFrame([(int(r["cluster"]), int(r["n"])) for r in parts if r["n"]], "cluster int, size long")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def text_of_html(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


def html_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text): visible text of pages, a line for each run of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [text_of_html(t or "") for t in batch["text"]]})

    return _rows(pages, id_col, html_col).mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)


MARKDOWN_LINK, WIKI_LINK, WEB_LINK = r"\[[^\]\n]*\]\(([^)\s]+)[^)]*\)", r"\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\]", r"(https?://[^\s)>\]\"']+)"
#: What a cited key looks like, words that stand in brackets without being one, and the shape of versions.
CITATION = r"\[@?([A-Za-z0-9_.:-]+)\]"
NOT_CITED = ("x", "ok", "tbd", "todo", "na", "n/a", "unreleased", "yes", "no", "y", "n")
VERSION = r"^[vV]?[\dxXyYzZ]+([._-][\dxXyYzZ]+)*$"


def link_targets(text: Column) -> Column:
    """Targets of Markdown links, wiki links and web addresses, each once, in this order of kinds."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (MARKDOWN_LINK, WIKI_LINK, WEB_LINK)]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.trim(x)))


def citations(text: Column) -> Column:
    """Cited keys in brackets, of three characters or more; no versions or words like todo. Of keys that differ in case only, the first."""
    found = F.filter(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*NOT_CITED) & ~x.rlike(VERSION))
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: F.lower(y)), F.lower(x)) == i + 1)
