"""Ranked full-text search: weighted BM25 over title, path, heading and text, divided by a structural prior.

bm25() answers a single question: one pass over the texts counts the terms in place, without a shuffle, into a narrow
table; statistics and scores come from that. Corpora that are searched often get an index once (build_index): postings
clustered by term, of which a search reads its terms' row groups, and no text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import checkpointed, forget, spread

#: Weights of title, path, heading and text (fixed values).
WEIGHTS = {"title": 8.0, "path": 3.0, "heading": 2.0, "body": 1.0}
K1, B = 1.2, 0.75
#: Words that frame a question and aren't searched for.
STOPWORDS = frozenset(
    """
    a an the this that these those there here it its
    i we you me my our your us they them their
    is are was were be been being am do does did doing done
    have has had having can could should would will shall may might must
    of to in on at by for from with without into onto about across over under
    and or not but if then than as so such via per
    what which who whom whose when where why how
    find finds locate locating search searching show shows tell tells give gives
    get gets list lists explain explaining describe describing
    please help need needs want wants use uses using used
    me about above below more most some any all each every
    file files document documents thing things stuff
    """.split()
)
#: Partitions of an index, each a range of terms.
INDEX_FILES = 32
FOLD_FROM, FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def query_tokens(query: str, drop_stopwords: bool = True) -> list[str]:
    """Searchable tokens of a query: whole words, their parts at underscores and at camel-case humps, sorted."""
    found = set()
    for word in re.findall(r"[A-Za-z][A-Za-z0-9_]+", query):
        humps = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", word).split()
        found.update([word.lower()], (p.lower() for p in word.split("_") if len(p) > 1), (p.lower() for p in humps if len(p) > 1))
    content = found - STOPWORDS
    return sorted(content if drop_stopwords and content else found)


def tokens_text(column: Column) -> Column:
    """Tokens of a text between single blanks: lower case, accents folded, split at all but letters and digits."""
    low = F.lower(F.coalesce(column, F.lit("")))
    folded = F.when(low.rlike(f"[{FOLD_FROM}]"), F.translate(low, FOLD_FROM, FOLD_TO)).otherwise(low)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def wide_text(joined: Column) -> Column:
    """tokens_text() with two blanks between tokens and one at either end, so that each token has blanks of its own."""
    return F.concat(F.lit(" "), F.replace(joined, F.lit(" "), F.lit("  ")), F.lit(" "))


def occurrences(wide: Column, term: str) -> Column:
    """How often a token, or a phrase of adjacent tokens where the term has underscores, occurs in wide_text()."""
    phrase = f" {'  '.join(p for p in term.split('_') if p)} "
    return ((F.octet_length(wide) - F.octet_length(F.replace(wide, F.lit(phrase), F.lit("")))) / len(phrase.encode())).cast("long")


def _counted(column: str, terms: list[str]) -> Column:
    """(dl, f0, f1, ...) of one column: its tokens, and occurrences of each term. The tokens are made once."""
    return F.transform(
        F.array(wide_text(tokens_text(F.col(column)))),
        lambda w: F.struct(
            F.when(w == "  ", 0).otherwise(F.floor((F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit("")))) / 2)).alias("dl"),
            *[occurrences(w, term).alias(f"f{i}") for i, term in enumerate(terms)],
        ),
    )[0]


def bm25(docs: DataFrame, terms: list[str], k: int = 10, id_col: str = "id") -> DataFrame:
    """(rank, id, path, score): the k best of docs(id, title, path, heading, body); lower scores are better."""
    each = spread(docs).select(F.col(id_col).alias("id"), "path", *[_counted(c, terms).alias(f"c_{c}") for c in WEIGHTS])
    size = sum((F.col(f"c_{c}.dl") for c in WEIGHTS), F.lit(0))
    weighted = [sum((F.lit(w) * F.col(f"c_{c}.f{i}") for c, w in WEIGHTS.items()), F.lit(0.0)).alias(f"f{i}") for i in range(len(terms))]
    written = checkpointed(each)
    counted = written.select("id", "path", size.alias("dl"), *weighted)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms))])
    matched = counted.where(F.greatest(*[F.col(f"f{i}") for i in range(len(terms))]) > 0 if len(terms) > 1 else F.col("f0") > 0)
    found = checkpointed(_best(matched.crossJoin(F.broadcast(stats)), len(terms), k))
    forget(written)
    return found.withColumnRenamed("id", id_col)


def _best(matched: DataFrame, terms: int, k: int) -> DataFrame:
    """(rank, id, path, score) of rows (id, path, dl, f0, ..., n, avgdl, n0, ...)."""

    def part(i: int) -> Column:
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        f = F.col(f"f{i}")
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    score = -sum((part(i) for i in range(terms)), F.lit(0.0)) / structural_prior(F.col("path"))
    best = matched.select("id", "path", F.round(score, 6).alias("score")).orderBy("score", "id").limit(k)
    return best.select(F.row_number().over(W.orderBy("score", "id")).alias("rank"), "id", "path", "score")


def build_index(docs: DataFrame, where: str, id_col: str = "id") -> None:
    """Writes an index of docs(id, title, path, heading, body): postings in ranges of terms, and lengths."""
    tokens = checkpointed(spread(docs).select(F.col(id_col).alias("id"), "path", *[F.split(tokens_text(F.col(c)), " ").alias(f"t_{c}") for c in WEIGHTS]))
    size = sum((F.size(F.filter(f"t_{c}", lambda t: t != "")) for c in WEIGHTS), F.lit(0))
    tokens.select("id", "path", size.alias("dl")).write.parquet(f"{where}/lengths")
    def weighed(weight: float):
        return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))

    of_column = [F.transform(f"t_{c}", weighed(w)) for c, w in WEIGHTS.items()]
    one = tokens.select("id", F.explode(F.concat(*of_column)).alias("t")).where("t.term <> ''").groupBy(F.col("t.term").alias("term"), "id").agg(F.sum("t.w").alias("f"))
    one.repartitionByRange(INDEX_FILES, "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{where}/postings")
    forget(tokens)


def search_index(spark: SparkSession, where: str, terms: list[str], k: int = 10) -> DataFrame:
    """(rank, id, path, score) as bm25() has them, of single tokens, from an index."""
    lengths = spark.read.parquet(f"{where}/lengths")
    hits = spark.read.parquet(f"{where}/postings").where(F.col("term").isin(*terms))
    counted = hits.groupBy("id").agg(*[F.sum(F.when(F.col("term") == t, F.col("f")).otherwise(0.0)).alias(f"f{i}") for i, t in enumerate(terms)])
    found = hits.agg(*[F.count(F.when(F.col("term") == t, 1)).alias(f"n{i}") for i, t in enumerate(terms)])
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return _best(counted.join(lengths, "id").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(found)), len(terms), k)


def structural_prior(path: Column) -> Column:
    """Divisor by place: depth, tests and samples rank lower."""
    low = F.lower(path)
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    tests = low.like("%/tests/%") | low.like("tests/%") | low.like("%/test_%") | low.like("test_%") | low.like("%_test.%")
    samples = low.like("%/samples/%") | low.like("samples/%") | low.like("%/examples/%") | low.like("examples/%")
    return 1.0 + 0.05 * depth + F.when(tests, 0.60).otherwise(0.0) + F.when(samples, 0.30).otherwise(0.0)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """(term, id, tf, positions): an inverted index for corpora that are searched often; cluster it by term."""
    token = docs.select(id_col, F.posexplode(F.split(tokens_text(F.col(text_col)), " ")).alias("pos", "term"))
    return token.where("term <> ''").groupBy("term", id_col).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
