"""The walk by levels, and a folder kept as a source: what is listed, what is read, and what a second sync does."""

import glob
import os

import pytest

from strataq.kb import KnowledgeBase
from strataq.sources import walk
from strataq.sources.connectors import BudgetExceeded


def make(root, **files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    make(root, **{
        "a.md": "one", "src/b.py": "two", "src/deep/c.md": "three", "src/deep/er/d.md": "four", ".env": "s", "src/.aws/config": "s", "src/.npmrc": "s", "key/x.kdbx": "s", "credentials.json": "s",
        "node_modules/x/y.js": "no", "src/node_modules/z.js": "no", "big.md": "b" * 500,
    })
    return root


def names(files):
    return sorted(r["relative_path"] for r in files.collect())


def test_selection(spark, tree):
    files, report = walk.walk(spark, tree)
    assert names(files) == ["a.md", "big.md", "src/b.py", "src/deep/c.md", "src/deep/er/d.md"]
    assert (report["file"], report["pruned"], report["limit"]) == (5, 3, None) and report["bytes"] == 500 + 3 + 3 + 5 + 4
    assert names(walk.walk(spark, tree, include=["**/*.md"], exclude=["src/deep/er/**"], max_file_bytes=100)[0]) == ["a.md", "src/deep/c.md"]
    assert names(walk.walk(spark, tree, max_depth=1)[0]) == ["a.md", "big.md", "src/b.py"]
    assert walk.walk(spark, tree + "/none")[0].count() == 0


def test_pruned_folders_are_never_listed(spark, tree):
    os.chmod(f"{tree}/node_modules", 0)
    try:
        _, report = walk.walk(spark, tree)
        kinds = walk.walk(spark, tree, exclude=["src/deep/**"])[1]
    finally:
        os.chmod(f"{tree}/node_modules", 0o755)
    assert "unreadable" not in report and kinds["entries"] < report["entries"] and kinds["folder"] == report["folder"] - 2


def test_links_that_lead_back_end(spark, tree):
    os.symlink(tree, f"{tree}/src/again")
    os.symlink(f"{tree}/src/deep", f"{tree}/src/twin")
    os.symlink(f"{tree}/gone", f"{tree}/dead")
    assert names(walk.walk(spark, tree)[0]) == ["a.md", "big.md", "src/b.py", "src/deep/c.md", "src/deep/er/d.md"]
    assert names(walk.walk(spark, tree, follow=True)[0]) == ["a.md", "big.md", "src/b.py", "src/deep/c.md", "src/deep/er/d.md"]


def test_a_budget_ends_the_walk(spark, tree):
    _, report = walk.walk(spark, tree, max_files=1)
    assert report["limit"] == "max_files" and report["file"] == 2
    assert walk.walk(spark, tree, max_bytes=600)[1]["limit"] is None and walk.walk(spark, tree, max_entries=3)[1]["limit"] == "max_entries"


def test_a_second_sync_reads_and_writes_nothing(spark, tree, tmp_path, monkeypatch):
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    with pytest.raises(BudgetExceeded):
        base.sync("docs", tree, max_bytes=10)
    assert base.version() == 0
    assert base.sync("docs", tree, include=["**/*.md"]).collect() == [("added", 4)]
    assert base.search("three").first()["path"] == "src/deep/c.md"
    before = sorted(glob.glob(f"{base.folder}/**", recursive=True))
    os.chmod(f"{tree}/a.md", 0)
    monkeypatch.setattr(walk, "texts", lambda files: pytest.fail("read") if files.count() else files.selectExpr("relative_path", "'' AS text"))
    assert base.sync("docs", tree, include=["**/*.md"]).collect() == [("unchanged", 4)]
    assert sorted(glob.glob(f"{base.folder}/**", recursive=True)) == before
    monkeypatch.undo()
    os.chmod(f"{tree}/a.md", 0o644)
    make(tree, **{"a.md": "changed text", "new.md": "five"})
    os.remove(f"{tree}/src/deep/er/d.md")
    assert sorted(base.sync("docs", tree, include=["**/*.md"]).collect()) == [("added", 1), ("changed", 1), ("deleted", 1), ("unchanged", 2)]
    assert sorted(r["text"] for r in base.chunks().collect() if len(r["text"]) < 99) == ["changed text", "five", "three"]
