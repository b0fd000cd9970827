"""A walk over a folder by tasks: a frontier of folders is listed level by level, and what is pruned is never listed.

Tasks open folders and files by their paths, so the folder has to be mounted on all executors (a store that only Spark
reaches is read by files.scan). Each level is one job: its folders are dealt over tasks, and its entries are written, so
no list of files is ever held by the driver. With follow, folders are known by their real paths, so a link that leads
back to a folder that has been seen ends there. A budget is looked at after each level: the walk stops, and says why.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators.paths import NOISE, SECRETS, glob_regex
from strataq.session import checkpointed, forget, ship_package

ENTRY = "kind string, path string, relative_path string, size_bytes long, mtime double, real string"
#: Fixed value: entries that a walk may look at.
MOST_ENTRIES = 5_000_000


def _matcher(patterns: list[str]):
    found = [re.compile(glob_regex(p)) for p in patterns]
    return lambda path: any(p.match(path) or p.match("/" + path) for p in found)


def _lister(include: list[str], exclude: list[str], max_depth: int | None, max_file_bytes: int | None, follow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, unwanted = _matcher(include), _matcher(exclude)
        pruned = _matcher([*exclude, *(p[:-3] for p in exclude if p.endswith("/**"))])
        names = [f.split(" ")[0] for f in ENTRY.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            for path, above in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    entries = sorted(os.scandir(path), key=lambda e: e.name)
                except OSError:
                    out.append(("unreadable", path, above, None, None, None))
                    continue
                for e in entries:
                    relative = f"{above}/{e.name}" if above else e.name
                    try:
                        if e.is_dir(follow_symlinks=follow):
                            deep = max_depth is not None and relative.count("/") + 1 > max_depth
                            kind = "pruned" if pruned(relative) else "deep" if deep else "folder"
                            out.append((kind, e.path, relative, None, None, os.path.realpath(e.path) if follow and kind == "folder" else None))
                        elif e.is_file(follow_symlinks=follow) and (not include or wanted(relative)) and not unwanted(relative):
                            about = e.stat(follow_symlinks=follow)
                            kind = "oversized" if max_file_bytes is not None and about.st_size > max_file_bytes else "file"
                            out.append((kind, e.path, relative, about.st_size, about.st_mtime, None))
                        else:
                            out.append(("skipped", e.path, relative, None, None, None))
                    except OSError:
                        out.append(("unreadable", e.path, relative, None, None, None))
                    if len(out) >= 10_000:
                        yield packed()
                        out.clear()
        if out:
            yield packed()

    return run


def walk(
    spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_depth: int | None = None, follow: bool = False,
    max_files: int | None = None, max_bytes: int | None = None, max_file_bytes: int | None = None, max_entries: int = MOST_ENTRIES,
) -> tuple[DataFrame, dict]:
    """((path, relative_path, size_bytes, mtime) of the files below root, what there was).

    Noise and secrets (paths.NOISE, paths.SECRETS) are left out besides what exclude names. The report counts entries of
    each kind and bytes of files; its limit is None, or names what stopped the walk, and then levels below are missing.
    """
    ship_package(spark)
    root = os.path.abspath(root.removeprefix("file://"))
    lister = _lister(list(include or []), [*NOISE, *SECRETS, *(exclude or [])], max_depth, max_file_bytes, follow)
    frontier = spark.createDataFrame([(root, "")], "path string, relative_path string")
    seen = spark.createDataFrame([(os.path.realpath(root),)], "real string")
    levels, report, folders = [], {"bytes": 0, "limit": None}, 1
    while folders:
        listed = checkpointed(frontier.repartition(max(1, min(folders, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(lister, ENTRY))
        levels.append(listed)
        counts = listed.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size")).collect()
        for r in counts:
            report[r["kind"]] = report.get(r["kind"], 0) + r["n"]
            report["bytes"] += (r["size"] or 0) if r["kind"] == "file" else 0
        report["entries"] = report.get("entries", 0) + sum(r["n"] for r in counts)
        over = [("max_files", report.get("file", 0), max_files), ("max_bytes", report["bytes"], max_bytes), ("max_entries", report["entries"], max_entries)]
        report["limit"] = next((name for name, have, most in over if most is not None and have > most), None)
        frontier = listed.where("kind = 'folder'")
        if follow:
            # Of several links to one folder the first by path is followed.
            first = frontier.groupBy("real").agg(F.min_by(F.struct("path", "relative_path"), "relative_path").alias("f"))
            fresh = checkpointed(first.join(seen, "real", "left_anti"))
            seen = seen.unionByName(fresh.select("real"))
            frontier = fresh.select("f.*")
        frontier = frontier.select("path", "relative_path")
        folders = 0 if report["limit"] else frontier.count()
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    files = checkpointed(every.where("kind = 'file'").select("path", "relative_path", "size_bytes", "mtime"))
    forget(every)
    return files, report


def texts(files: DataFrame) -> DataFrame:
    """(relative_path, text) of files (path, relative_path, ...), which tasks read; bytes that aren't UTF-8 are replaced.

    A file that is gone or can't be read is left out.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, relative in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(path, "rb") as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([relative]), pa.array([text])], ["relative_path", "text"])

    return files.select("path", "relative_path").mapInArrow(run, "relative_path string, text string")
