"""A knowledge base in a folder: ingest texts, search them, walk their graph, keep agent memory, and ask SQL of it all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.corpus import used
from strataq.operators import assembly, chunking, enrichment, fulltext, fusion, graph, incremental, memory, paths, policy, search_index, traversal, vectors
from strataq.session import checkpointed, forget, ship_package, small
from strataq.sources import walk
from strataq.sources.connectors import BudgetExceeded
from strataq.store import Conflict, Run, Store, Version

#: Tables of the folder; each row is of a run.
SCHEMAS = {
    "artifacts": "artifact_id string, source string, relative_path string, sha256 string, digest string, size_bytes long, acl string, stamp string, deleted boolean",
    "chunks": "artifact_id string, chunk_index int, start_line int, heading_path string, text string",
    "headings": "artifact_id string, line int, level int, title string, ordinal array<int>, parent int, path string",
    "links": "artifact_id string, target string",
    "postings": search_index.POSTINGS,
    "dictionary": search_index.DICTIONARY,
    "vectors": "artifact_id string, chunk_id string, embedding array<double>",
    "edges": "from_node string, to_node string, type string",
    "memory": "record_id string, scope string, subject string, kind string, written_by string, text string, asserted_at string, valid_from string, valid_until string, supersedes string, uses long, observations long, tier string, last_seen string, last_used_at string",
}
VIEWS = ("artifacts", "chunks", "headings", "links", "nodes", "edges", "memory_records")
#: Arms of a hybrid search, the first ones' records being shown, and hits of each that are fused.
ARMS, POOL = ("text", "vector", "graph"), 50
#: More sources than this in an ingest, and it counts as one of all sources.
NAMED_SOURCES = 1000
#: Hits whose chunks are read by a filter on their artifacts.
FILTERED = 1000


def _chunk_id() -> Column:
    return F.concat("artifact_id", F.lit(":chunk="), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))


def _rows(docs: DataFrame, acl: Column, stamp: Column) -> DataFrame:
    """Artifacts of docs (source, path, text), with their texts."""
    text, rights = F.coalesce("text", F.lit("")), acl.cast("string")
    return docs.select(
        F.concat_ws(":", F.lit("file"), "source", "path").alias("artifact_id"), F.col("source").cast("string").alias("source"), F.col("path").alias("relative_path"),
        F.sha2(text, 256).alias("sha256"), F.sha2(F.concat_ws("\n", F.coalesce(rights, F.lit("")), text), 256).alias("digest"), F.octet_length(text).cast("long").alias("size_bytes"),
        rights.alias("acl"), stamp.cast("string").alias("stamp"), text.alias("text"),
    )


def _next(head: Version) -> int:
    return max((r.order for r in head.runs), default=0) + 1


class KnowledgeBase:
    """Tables below one folder, which all executors can reach, in versions (see store).

    An ingest writes what is new or changed and nothing else, as a run of its own: artifacts, chunks, headings, links, and
    a segment of the search index with the terms of what it replaces taken back. Then it commits the run. Two ingests of
    different sources both count; of two that overlap, the later one is done again on top of the first. Of an artifact's
    rows those of its last run count, so all older ones are masked by the artifacts of later runs, which compact() makes
    few. Every read is of one version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = Store(spark, folder, SCHEMAS)

    def version(self) -> int:
        """How many ingests have changed anything."""
        return self.store.version().facts.get("ingests", 0)

    # Tables

    def _ordered(self, name: str, version: Version) -> DataFrame:
        """Rows of a table with the order of their runs."""
        orders = self.spark.createDataFrame([(r.name, r.order) for r in version.runs], "run string, order long")
        return self.store.read(name, version).join(small(orders), "run")

    def _unmasked(self, rows: DataFrame, version: Version) -> DataFrame:
        """Rows (artifact_id, order, ...) whose artifact no later run has."""
        first = min((r.order for r in version.runs if r.facts.get("n_artifacts")), default=0)
        if not any(r.order > first and r.facts.get("n_artifacts") for r in version.runs):
            return rows.drop("order")
        later = self._ordered("artifacts", version).where(F.col("order") > first).groupBy("artifact_id").agg(F.max("order").alias("until"))
        mask = small(later.withColumnRenamed("artifact_id", "masked"))
        return rows.join(mask, (F.col("artifact_id") == F.col("masked")) & (F.col("until") > F.col("order")), "left_anti").drop("order")

    def _live(self, name: str, version: Version | None = None) -> DataFrame:
        version = version or self.store.version()
        return self._unmasked(self._ordered(name, version), version)

    def artifacts(self, version: Version | None = None) -> DataFrame:
        """Artifacts as they are now."""
        return self._live("artifacts", version).where("NOT deleted").drop("deleted")

    def chunks(self, version: Version | None = None) -> DataFrame:
        return self._live("chunks", version).withColumn("chunk_id", _chunk_id())

    def headings(self) -> DataFrame:
        return self._live("headings").drop("run")

    def links(self) -> DataFrame:
        return self._live("links").drop("run")

    def table(self, name: str) -> DataFrame:
        return {"artifacts": self.artifacts, "chunks": self.chunks, "headings": self.headings, "links": self.links, "nodes": self.nodes, "edges": self.edges, "memory_records": self.memory_records}[name]()

    def sql(self, statement: str, **args) -> DataFrame:
        """Any Spark SQL over the base's tables, with named parameters."""
        for name in used(statement, VIEWS):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(statement, args=args or None)

    # Ingest

    def ingest(self, docs: DataFrame) -> DataFrame:
        """(change, n): docs (source, path, text, and acl if there is one) become the whole of the sources they name.

        Artifacts that are gone from these sources are deleted; those whose text and acl are as before aren't touched.
        Rows without source or path are left out, a null text is empty, and of rows with one path the one with the least
        digest counts. Only changed texts are cut into chunks; columns of other names are ignored.
        """
        acl = F.col("acl") if "acl" in docs.columns else F.lit(None)
        rows = _rows(docs.where("source IS NOT NULL AND path IS NOT NULL"), acl, F.lit(None))
        while True:
            try:
                return self._ingest(rows)
            except Conflict:
                continue

    def sync(self, source: str, folder: str, acl: str | None = None, **limits) -> DataFrame:
        """(change, n): the files of a folder become the whole of a source; limits are those of walk.walk.

        Files whose size and time are as they were aren't read, and if none has changed nothing is written. A walk that a
        limit has stopped raises BudgetExceeded before any file is read.
        """
        while True:
            files, report = walk.walk(self.spark, folder, **limits)
            try:
                if report["limit"]:
                    raise BudgetExceeded(f"{report['limit']}: {report.get('file', 0)} files of {report['bytes']} bytes, {report['entries']} entries")
                return self._sync(source, files, acl)
            except Conflict:
                continue
            finally:
                forget(files)

    def _sync(self, source: str, files: DataFrame, acl: str | None) -> DataFrame:
        base = self.store.version()
        stamp = F.concat_ws(":", "size_bytes", "mtime", F.lit(acl))
        now = files.select("*", F.concat(F.lit(f"file:{source}:"), "relative_path").alias("artifact_id"), stamp.alias("stamp"))
        before = self.artifacts(base).where(F.col("source") == source)
        change = checkpointed(incremental.changes(before, now, "artifact_id", "stamp"))
        touched = now.join(change.where("change IN ('added', 'changed')").select("artifact_id"), "artifact_id", "left_semi")
        docs = walk.texts(touched).join(touched.select("relative_path", "stamp"), "relative_path").select(F.lit(source).alias("source"), F.col("relative_path").alias("path"), "text", "stamp")
        counts = self._change(_rows(docs, F.lit(acl), F.col("stamp")), before, change, base, [f"source:{source}"])
        forget(change)
        return counts

    def _ingest(self, rows: DataFrame) -> DataFrame:
        base = self.store.version()
        now = rows.groupBy("artifact_id", "source").agg(F.min("digest").alias("digest"))
        named = now.select("source").distinct()
        before = self.artifacts(base).join(small(named), "source", "left_semi")
        change = checkpointed(incremental.changes(before, now, "artifact_id", "digest").join(now.select("artifact_id", "digest"), "artifact_id", "left"))
        sources = [r["source"] for r in named.limit(NAMED_SOURCES + 1).collect()]
        counts = self._change(rows, before, change, base, [f"source:{s}" for s in sources] if len(sources) <= NAMED_SOURCES else [])
        forget(change)
        return counts

    def _change(self, rows: DataFrame, before: DataFrame, change: DataFrame, base: Version, keys: list[str]) -> DataFrame:
        counts = {r["change"]: r["n"] for r in change.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if counts.keys() - {"unchanged"}:
            run = self.store.lease()
            try:
                self._write(rows, before, change, base, run, keys)
            finally:
                self.store.release(run)
        return self.spark.createDataFrame(sorted(counts.items()), "change string, n long")

    def _write(self, rows: DataFrame, before: DataFrame, change: DataFrame, base: Version, run: str, keys: list[str]) -> None:
        touched = change.where("change IN ('added', 'changed')")
        on = [c for c in ("artifact_id", "digest") if c in touched.columns]
        fresh = checkpointed(rows.join(touched.select(*on), on, "left_semi").dropDuplicates(["artifact_id"]))
        key = fresh.select("artifact_id", "text")
        cut = chunking.section_chunks(key, "artifact_id").select("artifact_id", "chunk_index", "start_line", "heading_path", F.col("chunk").alias("text"))
        self.store.write("chunks", run, cut.repartitionByRange("artifact_id", "chunk_index").sortWithinPartitions("artifact_id", "chunk_index"))
        self.store.write("headings", run, chunking.outline(key, "artifact_id"))
        self.store.write("links", run, key.select("artifact_id", F.explode(enrichment.link_targets(F.col("text"))).alias("target")))
        gone = before.join(change.where("change = 'deleted'").select("artifact_id"), "artifact_id", "left_semi").withColumn("deleted", F.lit(True))
        added = fresh.withColumn("deleted", F.lit(False))
        columns = self.spark.createDataFrame([], SCHEMAS["artifacts"]).columns
        self.store.write("artifacts", run, added.select(*columns).unionByName(gone.select(*columns)))

        mine = Version(0, [Run(run, 0)])
        docs = self._searchable(self.store.read("chunks", mine), fresh)
        old = before.join(change.where("change IN ('changed', 'deleted')").select("artifact_id"), "artifact_id", "left_semi")
        taken = checkpointed(self._searchable(self.chunks(base).join(small(old.select("artifact_id")), "artifact_id", "left_semi"), old))
        self.store.write("postings", run, search_index.postings(docs))
        words = search_index.dictionary(self.store.read("postings", mine)).unionByName(search_index.taken_back(taken))
        self.store.write("dictionary", run, words.repartitionByRange("term").sortWithinPartitions("term"))
        size, less = search_index.measure(docs), search_index.measure(taken)
        facts = {"n": size["n"] - less["n"], "length": size["length"] - less["length"], "n_artifacts": True}
        forget(fresh)
        forget(taken)

        def add(head: Version) -> Version:
            return Version(0, [*head.runs, Run(run, _next(head), keys, facts)], head.facts | {"ingests": head.facts.get("ingests", 0) + 1})

        self.store.commit(base, add, keys)

    # Upkeep

    def compact(self) -> bool:
        """Puts the rows that count into one run; False if another writer replaced the same runs meanwhile."""
        base = self.store.version()
        runs = [r for r in base.runs if not r.facts.get("graph")]
        if len(runs) < 2:
            return True
        run = self.store.lease()
        try:
            for name in ("artifacts", "chunks", "headings", "links", "postings", "vectors"):
                live = self._live(name, base).drop("run")
                order = {"postings": ["term", "id"], "chunks": ["artifact_id", "chunk_index"]}.get(name)
                live = live.where("NOT deleted") if name == "artifacts" else live
                self.store.write(name, run, live.repartitionByRange(*order).sortWithinPartitions(*order) if order else live)
            mine = Version(0, [Run(run, 0)])
            self.store.write("dictionary", run, search_index.dictionary(self.store.read("postings", mine)).repartitionByRange("term").sortWithinPartitions("term"))
            self.store.write("memory", run, self.store.read("memory", base).drop("run"))
            facts = {"n_artifacts": True} | {f: sum(r.facts.get(f, 0) for r in runs) for f in ("n", "length")}
            replaced = {r.name for r in runs}

            def swap(head: Version) -> Version:
                if replaced - {r.name for r in head.runs}:
                    raise Conflict("runs were replaced")
                whole = Run(run, max(r.order for r in runs), ["compact"], facts)
                return Version(0, [whole, *(r for r in head.runs if r.name not in replaced)], head.facts)

            # Runs that came meanwhile stay on top of it, whatever they touch.
            self.store.commit(self.store.version(), swap, ["compact"])
            return True
        except Conflict:
            return False
        finally:
            self.store.release(run)

    # Search

    def _searchable(self, chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
        about = artifacts.select("artifact_id", "relative_path", "source", "acl")
        rows = chunks.join(about, "artifact_id")
        return rows.select(
            _chunk_id().alias("id"), "artifact_id", "source", "acl", F.element_at(F.split("relative_path", "/"), -1).alias("title"), F.col("relative_path").alias("path"),
            F.col("heading_path").alias("heading"), F.col("text").alias("body"),
        )

    def answers(self, questions: DataFrame, k: int = 10, identities: list[str] | None = None, default_public: bool = True, sources: list[str] | None = None, section: str | None = None, version: Version | None = None) -> DataFrame:
        """(question, rank, chunk_id, artifact_id, score) for a table of questions (question, terms), from the index alone.

        What the caller may not see, or did not ask for, is left out before anything is ranked; the statistics behind the
        scores are those of the whole base, so a chunk's score is the same for every caller.
        """
        version = version or self.store.version()
        of = self._live("postings", version)
        of = of.where(policy.visible(identities, default_public))
        if sources is not None:
            of = of.where(F.col("source").isin(*sources))
        if section and section.strip():
            of = of.where(F.contains(F.lower(F.coalesce("heading", F.lit(""))), F.lit(section.strip().lower())))
        size = {f: sum(r.facts.get(f, 0) for r in version.runs) for f in ("n", "length")}
        found = search_index.best(of, self.store.read("dictionary", version), size["n"], size["length"], questions, k)
        return found.select("question", "rank", F.col("id").alias("chunk_id"), F.regexp_replace("id", ":chunk=[0-9]+$", "").alias("artifact_id"), "score")

    def search(self, query: str, k: int = 10, identities: list[str] | None = None, default_public: bool = True, sources: list[str] | None = None, section: str | None = None) -> DataFrame:
        """(rank, chunk_id, artifact_id, path, heading, score, snippet): the k best chunks that the caller may see."""
        asked = self.spark.createDataFrame([("", fulltext.query_tokens(query) or [query.lower()])], "question string, terms array<string>")
        version = self.store.version()
        rows = self.answers(asked, k, identities, default_public, sources, section, version).select("rank", "chunk_id", "artifact_id", "score").collect()
        found = F.broadcast(self.spark.createDataFrame(rows, "rank int, chunk_id string, artifact_id string, score double"))
        names = sorted({r["artifact_id"] for r in rows})
        only = F.col("artifact_id").isin(*names) if len(names) <= FILTERED else F.lit(True)
        texts = self.chunks(version).where(only).drop("run", "artifact_id").join(found, "chunk_id")
        about = self.artifacts(version).where(only).select("artifact_id", F.col("relative_path").alias("path"))
        return texts.join(about, "artifact_id").select("rank", "chunk_id", "artifact_id", "path", F.col("heading_path").alias("heading"), "score", assembly.extract(F.col("text")).alias("snippet")).orderBy("rank")

    def embed(self, embedder: Callable[[list[str]], list[list[float]]]) -> int:
        """Gives every chunk that has no vector one, by embedder(texts), which tasks call for batches of texts; how many there were.

        Vectors of texts that have changed are masked as their chunks are. If an ingest comes between, it is done again.
        """
        ship_package(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = embedder(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.float64()))], ["artifact_id", "chunk_id", "embedding"])

        while True:
            base = self.store.version()
            wanted = self.chunks(base).select("artifact_id", "chunk_id", "text").join(self._live("vectors", base).select("chunk_id"), "chunk_id", "left_anti").select("artifact_id", "chunk_id", "text")
            run_ = self.store.lease()
            try:
                self.store.write("vectors", run_, wanted.mapInArrow(run, SCHEMAS["vectors"]))
                own = Run(run_, 0)
                n = self.store.read("vectors", Version(0, [own])).count()
                if n:
                    self.store.commit(base, lambda head: Version(0, [*head.runs, Run(run_, _next(head), ["vectors"])], head.facts))
                return n
            except Conflict:
                continue
            finally:
                self.store.release(run_)

    def hybrid(self, query: str, k: int = 10, embedder: Callable[[list[str]], list[list[float]]] | None = None, arms: tuple[str, ...] = ARMS, identities: list[str] | None = None, default_public: bool = True, sources: list[str] | None = None) -> tuple[DataFrame, list[str]]:
        """((rank, key, artifact_id, path, score, retrieved_by), arms without an answer to give): ranks of arms, fused.

        Arms are text (chunks by words), vector (chunks by meaning: it needs an embedder and vectors) and graph (nodes by
        names: headings and files stand for their artifact, links for the one they come from). An arm that can't be asked
        is left out, and named. An artifact comes once. The caller's rights and sources hold in every arm before it ranks.
        """
        version = self.store.version()
        seen = self.artifacts(version).where(policy.visible(identities, default_public))
        seen = seen.where(F.col("source").isin(*sources)) if sources is not None else seen
        seen = seen.select("artifact_id", "relative_path")
        found, missing = [], []
        for arm in arms:
            if arm == "text":
                asked = self.spark.createDataFrame([("", fulltext.query_tokens(query) or [query.lower()])], "question string, terms array<string>")
                rows = self.answers(asked, POOL, identities, default_public, sources, version=version).select(F.col("chunk_id").alias("key"), F.col("artifact_id").alias("node"), "rank")
            elif arm == "vector":
                own = self._live("vectors", version)
                if embedder is None or own.isEmpty():
                    missing.append(arm)
                    continue
                near = vectors.cosine_top_k(own.join(seen, "artifact_id", "left_semi"), embedder([query])[0], POOL, "chunk_id")
                rows = near.select(F.col("chunk_id").alias("key"), F.regexp_replace("chunk_id", ":chunk=[0-9]+$", "").alias("node"), "rank")
            elif arm == "graph":
                if self.edges().isEmpty():
                    missing.append(arm)
                    continue
                of = F.regexp_extract(F.split("key", " ")[0], "^(?:heading:)?(file:.*?)(?::[0-9]+)?$", 1)
                hits = self.search_graph(query, 4 * POOL).select("rank", "key", of.alias("node")).join(seen.select(F.col("artifact_id").alias("node")), "node", "left_semi")
                rows = hits.select("key", "node", F.row_number().over(Window.orderBy("rank")).alias("rank")).where(F.col("rank") <= POOL)
            else:
                raise ValueError(f"no arm {arm}")
            found.append((arm, rows))
        if not found:
            return self.spark.createDataFrame([], "rank int, key string, artifact_id string, path string, score double, retrieved_by string"), missing
        fused = fusion.reciprocal_rank(found, k)
        about = seen.select(F.col("artifact_id"), F.col("relative_path").alias("path"))
        return about.join(F.broadcast(fused), F.col("artifact_id") == F.col("node")).select("rank", "key", "artifact_id", "path", "score", "retrieved_by").orderBy("rank"), missing

    def context(self, query: str, k: int = 10, identities: list[str] | None = None, default_public: bool = True) -> DataFrame:
        """(place, artifact_id, n_chunks, included, text): documents of the best chunks, put together within a budget."""
        hits = checkpointed(self.search(query, k, identities, default_public).select("rank", "chunk_id", "artifact_id"))
        about = self.artifacts().select(F.col("artifact_id").alias("id"), "relative_path", "size_bytes")
        chunks = self.chunks().select("artifact_id", F.col("chunk_id").alias("id"), "chunk_index", F.col("heading_path").alias("label"), "text")
        return assembly.documents(hits.select("artifact_id", F.col("rank").alias("place")), about, chunks, hits.select("chunk_id"))

    # Graph

    def nodes(self) -> DataFrame:
        """(node_id, type, label): sources, artifacts and headings."""
        live = self.artifacts()
        sources = live.select("source").distinct().select(F.concat(F.lit("source:"), "source").alias("node_id"), F.lit("source").alias("type"), F.col("source").alias("label"))
        files = live.select(F.col("artifact_id").alias("node_id"), paths.kind_of(F.col("relative_path"), F.lit(None).cast("string")).alias("type"), F.col("relative_path").alias("label"))
        heads = self.headings().select(F.concat(F.lit("heading:"), "artifact_id", F.lit(":"), "line").alias("node_id"), F.lit("heading").alias("type"), F.col("title").alias("label"))
        return sources.unionByName(files).unionByName(heads)

    def _edges(self) -> DataFrame:
        live = self.artifacts()
        held = live.select(F.concat(F.lit("source:"), "source").alias("from_node"), F.col("artifact_id").alias("to_node"), F.lit("contains").alias("type"))
        heads = chunking.heading_edges(self.headings(), "artifact_id").withColumn("from_node", F.regexp_replace("from_node", "^file:(?=file:)", ""))
        refs = self.links().select(F.struct("artifact_id", "target").alias("ref"), "target")
        resolved = paths.resolve_links(refs, live.select(F.col("relative_path").alias("path")).distinct())
        linked = resolved.join(live.select(F.col("relative_path").alias("path"), "artifact_id"), "path").select(F.col("ref.artifact_id").alias("from_node"), F.col("artifact_id").alias("to_node"), F.lit("links_to").alias("type"))
        return held.unionByName(heads).unionByName(linked.where("from_node <> to_node").distinct())

    def build_graph(self) -> None:
        """Writes the edges of the base as it is now, sorted, and then points to them; walks read what was written last."""
        run = self.store.lease()
        try:
            self.store.write("edges", run, self._edges().repartitionByRange("from_node", "to_node").sortWithinPartitions("from_node"))

            def swap(head: Version) -> Version:
                return Version(0, [*(r for r in head.runs if not r.facts.get("graph")), Run(run, _next(head), ["graph"], {"graph": True})], head.facts)

            self.store.commit(self.store.version(), swap, ["graph"])
        finally:
            self.store.release(run)

    def edges(self) -> DataFrame:
        return self.store.read("edges").drop("run")

    def neighbors(self, node: str, depth: int = 1, edge_types: list[str] | None = None) -> DataFrame:
        return graph.neighbors(self.edges(), node, depth, edge_types, stored=True)

    def path(self, source: str, target: str, max_depth: int = 8) -> list[str]:
        return traversal.path(self.edges(), source, target, max_depth, stored=True)

    def part(self, node: str, depth: int = 1, limit: int = 100, **wanted) -> tuple[DataFrame, DataFrame, bool]:
        """The nodes around one, the edges among them, and whether there are more than the limit."""
        return traversal.part_of(self.nodes(), self.edges(), node, depth, limit, stored=True, **wanted)

    def search_graph(self, query: str, k: int = 10) -> DataFrame:
        return graph.search(self.nodes(), self.edges(), fulltext.query_tokens(query) or [query.lower()], query.lower().strip(), k)

    # Memory

    def remember(self, records: DataFrame) -> None:
        """Adds records; columns that they lack are null, columns that memory lacks are left out."""
        known = self.spark.createDataFrame([], SCHEMAS["memory"])
        given = records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema])
        run = self.store.lease()
        try:
            self.store.write("memory", run, given.where("record_id IS NOT NULL"))
            own = [f"memory:{run}"]
            self.store.commit(self.store.version(), lambda head: Version(0, [*head.runs, Run(run, _next(head), own)], head.facts), own)
        finally:
            self.store.release(run)

    def memory_records(self) -> DataFrame:
        """Records, of those that say the same the first asserted; a record written again counts as it was last asserted."""
        log = self.store.read("memory").drop("run")
        last = log.groupBy("record_id").agg(F.max_by(F.struct(*log.columns), F.struct(F.coalesce("asserted_at", F.lit("")), F.coalesce("text", F.lit("")))).alias("m")).select("m.*")
        kept = enrichment.folded(last).select(F.col("kept_id").alias("record_id")).distinct()
        return last.join(kept, "record_id", "left_semi")

    def recall(self, now: str, wanted: str | dict | policy.MemoryPolicy | None = None) -> DataFrame:
        """Records that a policy admits at an instant; a correction ends what it corrects when it is asserted."""
        ended = memory.effective_end(self.memory_records()).drop("valid_until", "superseded_at").withColumnRenamed("ends", "valid_until")
        return ended.where(policy.admits(policy.MemoryPolicy.parse(wanted), now)).withColumn("salience", memory.salience(now))
