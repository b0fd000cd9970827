"""Files as tables: a bounded scan of a folder, JSON items, event logs, and the Parquet export with its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import paths


def scan(spark: SparkSession, root: str, include: str = "*", max_depth: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(relative_path, size_bytes, mtime, content) of a folder's files; pruning comes before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^.*" + root.rstrip("/").replace("file://", "").replace(".", r"\.") + "/", "")
    rows = files.withColumn("relative_path", relative).where(paths.selected(F.col("relative_path"), [], [*paths.SECRETS, "**/.git/**"]))
    if max_depth is not None:
        rows = rows.where(F.size(F.split("relative_path", "/")) - 1 <= max_depth)
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    return rows.select("relative_path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")


def json_items(spark: SparkSession, path: str, items: str, schema: str) -> DataFrame:
    """Items of a listing whose JSON has them in one field."""
    return spark.read.schema(f"{items} array<struct<{schema}>>").option("multiLine", "true").json(path).select(F.inline(items))


def event_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """NDJSON files of a folder, with the file they are from; days sort as their names do."""
    return spark.read.schema(schema).json(folder).withColumn("file", F.input_file_name())


def append_events(events: DataFrame, folder: str, at: str = "ts") -> None:
    events.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(folder)


def export(tables: dict[str, DataFrame], folder: str, compression: str = "zstd") -> DataFrame:
    """Writes each table as Parquet and returns the manifest (table, rows), which is written too."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, table in tables.items():
        table.write.mode("overwrite").option("compression", compression).parquet(f"{folder}/{name}.parquet")
        rows.append((name, spark.read.parquet(f"{folder}/{name}.parquet").count()))
    manifest = spark.createDataFrame(rows, "table_name string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/export.json")
    return manifest
