"""Session helpers: tuned local sessions, shared checkpoint storage, and shipping this package to workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Rows that reach Python at once; texts may be long, so memory wants few.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Spark's setting by which the shuffle files of a query go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, app: str = "strataq", **conf: str) -> SparkSession:
    """A single-machine session with adaptive execution and UTC timestamps."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, once per application, and bound the batches that reach Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strataq-")) / f"strataq-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only a local master may go without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get())
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "strataq-checkpoints")


def checkpointed(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors.

    What the write has shuffled goes when it ends, as its rows are in the table. With by, each value of that column has a
    folder of its own.
    """
    session = df.sparkSession
    path = f"{shared_dir(session).rstrip('/')}/strataq-{uuid.uuid4().hex}"
    before = session.conf.get(DROP_SHUFFLES, "false")
    session.conf.set(DROP_SHUFFLES, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        session.conf.set(DROP_SHUFFLES, before)
    return session.read.schema(df.schema).parquet(path).select(df.columns)


def forget(df: DataFrame, *parts: str) -> None:
    """Deletes a table that checkpointed() wrote, or parts of it (as kind=x), once later tables have replaced it."""
    session = df.sparkSession
    jvm = session.sparkContext._jvm
    roots = {found[0] for name in df.inputFiles() if (found := re.match(r".*/strataq-[0-9a-f]{32}(?=/)", name))}
    for folder in [f"{root}/{part}" for root in roots for part in parts or ("",)]:
        path = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few files over all cores, before work that costs more than a shuffle of them; many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows with a hint to broadcast them, if they are few when counted; else as they are, for a join that shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
