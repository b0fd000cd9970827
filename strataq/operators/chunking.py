"""Chunks of documents with overlap, headings, and labels of chunks by the heading above them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import ship_package

MAX_CHARS, OVERLAP = 4000, 400


def windows(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of windows: a window ends at its last newline if that lies past its middle."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(n, start + max_chars)
        if end < n:
            line_end = text.rfind("\n", start, end)
            end = line_end if line_end > start + max_chars // 2 else end
        out.append((start, end))
        if end >= n:
            return out
        start = max(end - overlap, start + 1)
    return out


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, start_line, end_line, text, text_hash): blank windows give no chunk and take no index."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                text = text or ""
                number = counted = line = 0  # line: line ends before counted
                last = max(1, len(text.splitlines()))
                for start, end in windows(text, max_chars, overlap):
                    line, counted = line + text.count("\n", counted, start), start
                    body = text[start:end].strip()
                    if body:
                        rows.append((key, number, line + 1, min(line + text.count("\n", start, end) + 1, last), body))
                        number += 1
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "start_line", "end_line", "text"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInPandas(run, f"id {dict(kept.dtypes)['id']}, chunk_index long, start_line long, end_line long, text string").withColumn("text_hash", F.sha2("text", 256)).withColumnRenamed("id", id_col)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("p", "content")).select(id_col, (F.col("p") + 1).alias("line"), "content")


#: Keywords that begin a heading, by level, and the most words that a title has.
KEYWORD_LEVELS = {
    "book": 1, "part": 1, "title": 1, "division": 1, "schedule": 1, "appendix": 1, "annex": 1, "exhibit": 1, "chapter": 2, "subpart": 2, "article": 3, "section": 3,
    "rule": 3, "regulation": 3, "clause": 4, "step": 4, "paragraph": 4, "subsection": 5,
}
MAX_TITLE_WORDS = 10
HEADING = "line int, level int, kind string, number string, title string"


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, level, kind, number, title) by rule families: Markdown, keyword, section sign, numbered, lettered, capitals.

    A heading without a title takes the next line with text, two lines on at most, if that is short and no heading.
    """
    text = F.trim("content")
    keyword = "(?i)^(" + "|".join(KEYWORD_LEVELS) + r")\s+([0-9]+(?:\.[0-9]+)*[a-z]?|[ivxlcdm]+|[a-z])\b\s*[-–—:.)]?\s*(.*)$"
    code = r"^§{1,2}\s*([0-9]+(?:\.[0-9]+)*[A-Za-z]?)\s*[-–—:.)]?\s*(.*)$"
    numbered = r"^([0-9]+(?:\.[0-9]+){0,5})\.?\s+(\p{Lu}.*)$"
    lettered = r"^\(([a-z]{1,2}|[ivxlcdm]{1,5})\)\s*(\S.*)$"
    short = F.size(F.split(text, r"\s+")) <= MAX_TITLE_WORDS + 2
    sentence = text.rlike(r"[.;,]$")
    kind = (
        F.when(text.rlike(r"^#{1,6}\s+\S"), "markdown").when(text.rlike(keyword) & short, "keyword").when(text.rlike(code) & short, "code")
        .when(text.rlike(numbered) & short & ~sentence, "numbered").when(text.rlike(lettered) & short, "lettered")
        .when(text.rlike(r"^\p{Lu}[\p{Lu}0-9][\p{Lu}0-9 ,'&/()\[\].:;–—-]{2,78}$") & text.rlike(r"\p{Lu}{3}"), "caps")
    )
    level_of = F.coalesce(*[F.when(F.lower(F.regexp_extract(text, keyword, 1)) == w, n) for w, n in KEYWORD_LEVELS.items()], F.lit(3))
    parts = {"keyword": (keyword, 2, 3), "code": (code, 1, 2), "numbered": (numbered, 1, 2), "lettered": (lettered, 1, 2)}
    number, title = F.lit(""), text
    for name, (pattern, at_number, at_title) in parts.items():
        number = F.when(F.col("kind") == name, F.regexp_extract(text, pattern, at_number)).otherwise(number)
        title = F.when(F.col("kind") == name, F.regexp_extract(text, pattern, at_title)).otherwise(title)
    title = F.when(F.col("kind") == "markdown", F.regexp_extract(text, r"^#+\s+(.*?)\s*#*$", 1)).otherwise(title)
    level = (
        F.when(F.col("kind") == "markdown", F.length(F.regexp_extract(text, "^(#+)", 1))).when(F.col("kind") == "keyword", level_of).when(F.col("kind") == "code", 3)
        .when(F.col("kind") == "numbered", F.size(F.split(F.regexp_extract(text, numbered, 1), r"\."))).when(F.col("kind") == "lettered", 6).otherwise(1)
    )
    marked = lines(docs, id_col, text_col).withColumn("kind", kind)
    ahead = F.struct("kind", text.alias("t"))
    order = W.partitionBy(id_col).orderBy("line")
    seen = marked.withColumn("next", F.lead(ahead, 1).over(order)).withColumn("after", F.lead(ahead, 2).over(order)).where("kind IS NOT NULL")

    def fits(column: str):
        t = F.col(f"{column}.t")
        return F.when(F.col(f"{column}.kind").isNull() & (t != "") & (F.size(F.split(t, r"\s+")) <= MAX_TITLE_WORDS) & ~t.rlike(r"[.;,]$"), t)

    caption = F.coalesce(fits("next"), F.when(F.col("next.t") == "", fits("after")), F.lit(""))
    own = F.when((title == "") & F.col("kind").isin("keyword", "code"), caption).otherwise(title)
    return seen.select(id_col, "line", level.cast("int").alias("level"), "kind", number.alias("number"), own.alias("title"))


def ordinal(kind: str, number: str) -> list[int]:
    """Place of a heading among its siblings, as a path: 4.2 is [4, 2], IV is [4], b is [2]; empty if there is none."""
    if re.fullmatch(r"[0-9]+(\.[0-9]+)*[A-Za-z]?", number):
        return [int(x) for x in re.findall("[0-9]+", number)]
    value = roman(number)
    lone_letter = kind == "lettered" and len(number) == 1 and number in "cdlm"
    if value and not lone_letter:
        return [value]
    return [ord(number.lower()) - 96] if re.fullmatch("[A-Za-z]", number) else []


def nested(rows: list[dict]) -> list[dict]:
    """Headings of one document, in order, with ordinal, parent (line or None) and path of titles.

    Numbers say where a heading belongs, in whatever convention they are written: 4.1 goes below the last heading that is
    4, be it `4.`, `§ 4` or `ARTICLE IV`, also if others have come between. Without such a heading, one goes below the
    deepest open heading of a lower level whose number doesn't speak against it: a number holds only those that begin with
    it (§ 12.3 isn't in ARTICLE IV), but parts, annexes and the like hold any numbering. A section that was put in later
    (12A) holds none of 12's. Lettered items, Markdown and capitals have no number of their own and nest by level.

    A lone letter that is a numeral too is read as what continues its run; else i, v and x are numerals, the rest letters.
    """
    chain: list[dict] = []
    chains: dict[int, list[dict]] = {}
    by_number: dict[tuple, dict] = {}
    places: dict[int, tuple] = {}
    last_letter = 0
    for row in rows:
        own = ordinal(row["kind"], row["number"])
        if row["kind"] == "lettered":
            if last_letter and len(row["number"]) == 1:
                own = next(([n] for n in (ord(row["number"]) - 96, roman(row["number"])) if n == last_letter + 1), own)
            last_letter = own[0] if own else 0
        else:
            last_letter = 0
        row["ordinal"] = own
        place = tuple(own) if row["kind"] in ("numbered", "code", "keyword") else ()
        above = by_number.get(place[:-1])
        if above is None:
            for other in reversed(chain):
                theirs = places[other["line"]]
                container = other["kind"] == "keyword" and other["level"] == 1
                inside = not place or not theirs or container or (len(theirs) < len(place) and place[: len(theirs)] == theirs)
                if other["level"] < row["level"] and inside:
                    above = other
                    break
        chain = [*chains[above["line"]], row] if above is not None else [row]
        chains[row["line"]], places[row["line"]] = chain, place
        row["parent"] = above["line"] if above is not None else None
        row["path"] = " > ".join(x["title"] or x["number"] for x in chain)
        if place and row["number"][-1:].isdigit() or place and row["kind"] == "keyword" and not row["number"][:1].isdigit():
            by_number[place] = row
    return rows


def outline(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, level, kind, number, title, ordinal, parent, path): headings in their hierarchy, a document at a time."""
    ship_package(docs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = nested(pdf.sort_values("line").to_dict("records"))
        out = pd.DataFrame(rows, columns=["id", "line", "level", "kind", "number", "title", "ordinal", "parent", "path"])
        return out.assign(parent=out["parent"].astype("Int32"))

    found = headings(docs, id_col, text_col).withColumnRenamed(id_col, "id").withColumn("id", F.col("id").cast("string"))
    kind = docs.schema[id_col].dataType
    out = found.groupBy("id").applyInPandas(run, f"id string, {HEADING}, ordinal array<int>, parent int, path string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def heading_edges(outlines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(from_node, to_node, type): headings below their document or their parent."""
    own = F.concat(F.lit("heading:"), F.col(id_col), F.lit(":"), F.col("line"))
    above = F.when(F.col("parent").isNotNull(), F.concat(F.lit("heading:"), F.col(id_col), F.lit(":"), F.col("parent"))).otherwise(F.concat(F.lit("file:"), F.col(id_col)))
    return outlines.select(above.alias("from_node"), own.alias("to_node"), F.when(F.col("parent").isNull(), "has_heading").otherwise("contains").alias("type"))


def tree(rows: list[dict]) -> list[dict]:
    """Nested headings, each with its children, of one document's outline."""
    by_line = {r["line"]: {"title": r["title"], "number": r["number"], "line": r["line"], "children": []} for r in rows}
    for r in rows:
        if r["parent"] is not None:
            by_line[r["parent"]]["children"].append(by_line[r["line"]])
    return [by_line[r["line"]] for r in rows if r["parent"] is None]


def section_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 4000, overlap: int = 400) -> DataFrame:
    """(id, chunk_index, start_line, heading_path, chunk): a chunk for each heading's span and for what comes before.

    Spans that are longer than max_chars are cut into windows. Blank chunks are left out.
    """
    ship_package(docs.sparkSession)
    marks = outline(docs, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("line", "path"))).alias("marks"))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(marks, id_col, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, found in batch.itertuples(index=False):
                all_lines = text.split("\n")
                found = [] if found is None else list(found)
                cuts = [(1, ""), *((m["line"], m["path"]) for m in found)]
                n = 0
                for (begin, path), end in zip(cuts, [*(c[0] for c in cuts[1:]), len(all_lines) + 1], strict=True):
                    span = "\n".join(all_lines[begin - 1 : end - 1])
                    counted, line = 0, begin
                    for a, b in windows(span, max_chars, overlap):
                        line, counted = line + span.count("\n", counted, a), a
                        piece = span[a:b].strip()
                        if piece:
                            out.append((key, n, line, path, piece))
                            n += 1
            yield pd.DataFrame(out, columns=["id", "chunk_index", "start_line", "heading_path", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, chunk_index int, start_line int, heading_path string, chunk string").withColumnRenamed("id", id_col)


def roman(numeral: str) -> int | None:
    """Value of a Roman numeral; None if it isn't one."""
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    digits = [values.get(c) for c in numeral.lower()]
    if not digits or None in digits:
        return None
    return sum(-d if i + 1 < len(digits) and d < digits[i + 1] else d for i, d in enumerate(digits))


def gap_audit(ordinals: DataFrame, key: str = "series") -> DataFrame:
    """(series, line, issue, missing) of (series, line, ordinal): gaps, duplicates and items out of order.

    An item out of order doesn't move what is expected next, so each is compared with the running maximum.
    """
    before = F.max("ordinal").over(W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    rows = ordinals.withColumn("before", before).where("before IS NOT NULL")
    issue = F.when(F.col("ordinal") == F.col("before"), "duplicate").when(F.col("ordinal") < F.col("before"), "out_of_order").when(F.col("ordinal") > F.col("before") + 1, "gap")
    missing = F.when(issue == "gap", F.array_join(F.sequence(F.col("before") + 1, F.col("ordinal") - 1), ","))
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select(key, "line", "issue", missing.alias("missing"))


def as_of_join(points: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """points with the value of the last mark at or before each: one sort by key and place, no range join."""
    rows = points.select(key, at, F.lit(1).alias("is_point"), F.lit(None).cast(marks.schema[value].dataType).alias(value)).unionByName(marks.select(key, at, F.lit(0).alias("is_point"), value))
    last = F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(at, "is_point").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("found", last).where("is_point = 1").select(key, at, F.col("found").alias(value))
