"""Listings of remote services as tables: what is new in them, budgets, and how their items become Markdown.

A service's answers are read as JSON rows (files.json_items, or any Spark reader), so each function takes DataFrames. A
checkpoint is a table of versions seen, written after a sync has succeeded, so a failed sync reads its items again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import ship_package

#: Newest messages of a channel, and levels of blocks below a page.
MESSAGES, BLOCK_LEVELS = 500, 3
#: How blocks of text are written.
BLOCKS = {
    "paragraph": "{}", "heading_1": "# {}", "heading_2": "## {}", "heading_3": "### {}", "bulleted_list_item": "- {}",
    "numbered_list_item": "1. {}", "quote": "> {}", "callout": "> {}", "toggle": "{}",
}
READERS: dict[str, Callable[..., DataFrame]] = {}


class BudgetExceeded(ValueError):
    """A listing has more files or bytes than its budget."""


def register(kind: str, reader: Callable[..., DataFrame]) -> None:
    """Makes reader(spark, **options) the reader of a kind of source."""
    READERS[kind] = reader


def read_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """Items of a source by its kind: a registered reader, else a Spark data source of that name."""
    if kind in READERS:
        return READERS[kind](spark, **options)
    return spark.read.format(kind).options(**options).load()


def within_budget(listing: DataFrame, max_files: int | None = None, max_bytes: int | None = None, size: str = "size_bytes") -> DataFrame:
    """The listing, if it is within its budget; sizes are added up before any content is read."""
    found = listing.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    if (max_files is not None and found["n"] > max_files) or (max_bytes is not None and found["size"] > max_bytes):
        raise BudgetExceeded(f"{found['n']} files of {found['size']} bytes; allowed are {max_files} files and {max_bytes} bytes")
    return listing


def unread(listing: DataFrame, seen: DataFrame, key: str, version: str) -> DataFrame:
    """Items whose version isn't the one seen (key, version); items without a version are read always."""
    before = seen.select(key, F.col(version).alias("__seen"))
    return listing.join(before, key, "left").where(F.col("__seen").isNull() | F.col(version).isNull() | (F.col("__seen") != F.col(version))).drop("__seen")


def beyond(messages: DataFrame, offsets: DataFrame, group: str, number: str) -> DataFrame:
    """Messages with numbers above what each group (a mailbox) has got to; all of a group without an offset."""
    return messages.join(offsets.select(group, F.col(number).alias("__last")), group, "left").where(F.col("__last").isNull() | (F.col(number) > F.col("__last"))).drop("__last")


def checkpoint(listing: DataFrame, seen: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version) to save: the greatest of a listing; what it doesn't name stays as it was."""
    now = listing.where(F.col(key).isNotNull() & F.col(version).isNotNull()).groupBy(key).agg(F.max(version).alias(version))
    return now.unionByName(seen.select(key, version).join(now.select(key), key, "left_anti"))


def reused(listing: DataFrame, seen: DataFrame, watermark: str) -> DataFrame:
    """listing(key, etag, size, modified) with the digest of the same object in seen (key, etag, size, sha256), else null.

    An object counts as the same if it isn't newer than the watermark and has the same tag and size.
    """
    before = seen.select("key", F.col("etag").alias("__etag"), F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    same = (F.col("modified") <= F.lit(watermark)) & (F.col("etag") == F.col("__etag")) & (F.col("size") == F.col("__size"))
    return listing.join(before, "key", "left").withColumn("sha256", F.when(same, F.col("__sha"))).drop("__etag", "__size", "__sha")


def _block_line(level: int) -> Column:
    """A block's Markdown (one line, or three of code) at a level, null if it has none."""
    text, pad = F.coalesce("text", F.lit("")), F.lit("  " * level)
    plain = F.coalesce(*[F.when(F.col("type") == kind, F.concat(F.lit(form[:-2]), text)) for kind, form in BLOCKS.items()])
    todo = F.concat(F.lit("- ["), F.when(F.col("checked"), "x").otherwise(" "), F.lit("] "), text)
    code = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), pad, text, F.lit("\n"), pad, F.lit("```"))
    line = F.when(F.col("type") == "code", code).when(F.col("type") == "divider", "---").when(text == "", None).when(F.col("type") == "to_do", todo).otherwise(plain)
    return F.concat(pad, line)


def page_markdown(pages: DataFrame, blocks: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(page_id, text): pages(page_id, title) with blocks(block_id, parent_id, place, type, text, checked, language) below.

    A page's blocks hang on its id, a block's on the block's. Each level is one join with the level above it, and a
    place in the page is an array of places, so no tree is walked. Levels beyond the last aren't read.
    """
    above = pages.select("page_id", F.col("page_id").alias("parent_id"), F.array().cast("array<int>").alias("at"))
    lines = None
    for level in range(levels):
        here = blocks.join(above, "parent_id").withColumn("at", F.concat("at", F.array(F.col("place").cast("int"))))
        part = here.select("page_id", "at", _block_line(level).alias("line")).where("line IS NOT NULL")
        lines = part if lines is None else lines.unionByName(part)
        above = here.select("page_id", F.col("block_id").alias("parent_id"), "at")
    body = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("b"))
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("untitled"))), F.lit(""), F.array_join("b.line", "\n"))
    return pages.join(body, "page_id", "left").select("page_id", F.concat(F.rtrim(F.regexp_replace(text, r"\s+$", "")), F.lit("\n")).alias("text"))


def channel_markdown(channels: DataFrame, messages: DataFrame, most: int = MESSAGES) -> DataFrame:
    """(channel_id, path, text): open channels (channel_id, name, is_archived) with their newest messages, oldest first.

    messages(channel_id, ts, user, text, subtype): those with a subtype or without text count, but aren't shown.
    """
    newest = W.partitionBy("channel_id").orderBy(F.desc(F.col("ts").cast("double")), F.desc("ts"))
    kept = messages.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most).where("coalesce(subtype, '') = ''")
    words = F.trim(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("**"), F.coalesce("user", F.lit("unknown")), F.lit("** ("), F.col("ts").cast("string"), F.lit("): "), words)
    shown = kept.where(words != "").groupBy("channel_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").cast("double").alias("t"), line.alias("line")))).alias("m"))
    title = F.coalesce("name", F.col("channel_id").cast("string"))
    text = F.concat_ws("\n", F.concat(F.lit("# #"), title), F.lit(""), F.array_join("m.line", "\n"))
    path = F.lower(F.concat(title, F.lit("-"), F.substring(F.col("channel_id").cast("string"), 1, 8), F.lit(".md")))
    return channels.where(~F.coalesce("is_archived", F.lit(False))).join(shown, "channel_id", "left").select("channel_id", path.alias("path"), F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("text"))


class _Storage(HTMLParser):
    """Blocks of a wiki page's markup; a block inside another one is also part of its text."""

    MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "p": "", "li": "- ", "td": "", "pre": ""}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.words = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.MARKS:
            self.blocks.append((tag, []))
            self.open.append(len(self.blocks) - 1)

    def handle_endtag(self, tag):
        if any(self.blocks[i][0] == tag for i in self.open):
            while self.blocks[self.open.pop()][0] != tag:
                pass

    def handle_data(self, data):
        if data.strip():
            self.words.append(data.strip())
            for i in self.open:
                self.blocks[i][1].append(data.strip())


def storage_text(markup: str | None) -> str:
    """Markdown of a wiki page's markup: headings, paragraphs, items, cells and code; without any, its text."""
    parser = _Storage()
    parser.feed(markup or "")
    parser.close()
    shown = []
    for tag, words in parser.blocks:
        text = " ".join(words)
        if text and tag == "pre":
            shown += ["```", text, "```"]
        elif text:
            shown.append(parser.MARKS[tag] + text)
    return "\n\n".join(shown) or " ".join(parser.words)


def wiki_text(pages: DataFrame, id_col: str = "page_id", markup_col: str = "html") -> DataFrame:
    """(id, text) of wiki pages."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "text": [storage_text(x) for x in batch["markup"]]})

    kind = dict(pages.dtypes)[id_col]
    return pages.select(id_col, F.col(markup_col).alias("markup")).mapInPandas(run, f"`{id_col}` {kind}, text string")
