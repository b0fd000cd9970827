import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataq.operators import enrichment, graph, memory, paths, steering


@given(st.text(alphabet="a/*?[!].b", max_size=8), st.text(alphabet="ab/.*[", max_size=8))
@settings(max_examples=300, deadline=None)
def test_globs_are_shell_patterns(pattern, path):
    try:
        wanted = fnmatch.fnmatchcase(path, pattern)
    except re.error:
        return
    if "[" not in pattern:
        assert bool(re.search(paths.glob_regex(pattern), path)) == wanted


def test_secrets_and_pruning(spark):
    rows = spark.createDataFrame([(p,) for p in (".env", "a/.env.local", "x/id_rsa", "src/main.py", "node_modules/a.js", "a/venv/b", "keys.txt")], "path string")
    out = {r["path"] for r in rows.where(paths.matches_any(F.col("path"), [*paths.NOISE, *paths.SECRETS])).collect()}
    assert out == {".env", "a/.env.local", "x/id_rsa", "node_modules/a.js", "a/venv/b"}
    dirs = spark.createDataFrame([("a/node_modules",), ("node_modules",), ("a/nodes",)], "d string")
    assert {r["d"] for r in dirs.where(paths.prunable(F.col("d"), paths.NOISE)).collect()} == {"a/node_modules", "node_modules"}


def test_link_ladder(spark):
    files = spark.createDataFrame([("a/guide.md",), ("guide.txt",), ("b/guide",), ("b/pkg/__init__.py",), ("pkg.py",), ("x/pkg.py",)], "path string")
    refs = spark.createDataFrame([(1, "guide"), (2, "./a/guide#top"), (3, "http://x/guide"), (4, "pkg/__init__.py"), (5, "#top"), (6, "nothing")], "ref int, target string")
    assert sorted(map(tuple, paths.resolve_links(refs, files).collect())) == [(1, "guide.txt"), (2, "a/guide.md"), (4, "b/pkg/__init__.py")]
    imports = spark.createDataFrame([(1, "pkg"), (2, "b.pkg"), (3, "")], "ref int, target string")
    assert sorted(map(tuple, paths.resolve_imports(imports, files).collect())) == [(1, "pkg.py"), (2, "b/pkg/__init__.py")]


def test_rules_and_aliases(spark):
    texts = [("alias", "FileWatch daemon -> fileService, 'watcher'; watcher"), ("alias", "no arrow"), ("preference", "x when: sync, idle → prefer: docs/, src/"), ("preference", "when: -> prefer: x"), ("exclusion", "Never: tmp/, TMP/"), ("exclusion", "never:"), ("fact", "a -> b"), ("alias", None)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, kind string, text string")
    found = {r["i"]: (r["rule"]["triggers"], r["rule"]["values"]) for r in steering.parse_rules(rows).collect() if r["rule"]}
    assert found == {0: (["filewatch daemon"], ["fileservice", "watcher"]), 2: (["sync", "idle"], ["docs/", "src/"]), 4: ([], ["tmp/"])}
    aliases = {"filewatch daemon": ["file-service", "watcher"]}
    assert steering.expand(["daemon", "filewatch"], aliases) == ["daemon", "file", "filewatch", "service", "watcher"]
    assert steering.expand(["daemon"], aliases) == ["daemon"]


def test_keys_fold_framing_and_respect_writers(spark):
    key = enrichment.canonical_key
    assert key("user", None, "fact", "ana", "Heads up — The Build is GREEN!") == key("user", "", "fact", "ana", "build is green")
    assert key("user", "", "fact", "ana", "x") != key("user", "", "fact", "bob", "x") and key("org", "", "fact", "ana", "x") == key("org", "", "fact", "bob", "x")
    rows = spark.createDataFrame([("r2", "org", "s", "fact", "a", "Note that x", "2024-02"), ("r1", "org", "s", "fact", "b", "X.", "2024-01"), ("r3", "org", "t", "fact", "b", "X.", "2024-01")], "record_id string, scope string, subject string, kind string, written_by string, text string, asserted_at string")
    assert {r["record_id"]: r["kept_id"] for r in enrichment.folded(rows).collect()} == {"r1": "r1", "r2": "r1", "r3": "r3"}


def test_salience_takes_the_latest_of_three_instants(spark):
    row = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-03-31T00:00:00Z", "", 0, 0, "user")], "asserted_at string, last_seen string, last_used_at string, uses int, observations int, scope string")
    assert row.select(memory.salience("2024-06-29T00:00:00Z").alias("s")).first()["s"] == 0.5


def test_merge_candidates_and_budget(spark):
    texts = ["red cars go fast", "blue boats float well", "green trees grow tall", "red cars go fast today"]
    rows = spark.createDataFrame([(str(i), "org", "s" if i < 3 else "t", "fact", "hot", "w", t) for i, t in enumerate([*texts, *["same words here"] * 3])], "record_id string, scope string, subject string, kind string, tier string, written_by string, text string")
    assert [(r["subject"], r["size"], r["mean_jaccard"]) for r in steering.merge_candidates(rows).collect()] == [("s", 3, 0.0), ("t", 4, 0.5)]
    items = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("g", 4, 1)], "g string, k int, n int")
    assert [(r["k"], r["place"]) for r in graph.fill_budget(items, "g", "k", "n", "k", 10).orderBy("place").collect()] == [("1", 0), ("3", 1), ("4", 2)]
