"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # above 8000 bytes of bytecode the JVM does not compile a generated method; such stages run better unfused
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "auditframe") -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))  # one machine, so any folder is shared
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``, else a part of its warehouse."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"


def pin_partitions(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps partitions and their row order, for jobs that number rows by partition."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


# row groups by bytes from the first row on: a reader holds a row group of a batch at once, and 4,096 whole documents are too much
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # from Spark 4.1 on; earlier ones ignore it


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let the writes inside remove their shuffle files when they end, not when the driver's memory happens to be collected.

    A write plans its own execution, so no other one reads these files.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write a step of a loop to the shared folder and read it back.

    The table survives lost executors, later plans start from files, and its real size decides how it is joined.  Tables of large rows
    are written with ``LARGE_ROWS``.
    """
    path = scratch_path(df.sparkSession, "step")
    with freed_shuffles(df.sparkSession):
        df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for a table or text written by a job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
