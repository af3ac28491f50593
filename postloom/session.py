"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("postloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "64")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that outlive an executor.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset (tests, local
    runs) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="postloom-")
        atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, watch: Observation | None = None, *metrics) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read it back.

    Unlike a checkpoint of an RDD this computes the rows once, keeps them compressed and columnar
    and tells the planner their size. ``watch`` gathers ``metrics`` while writing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/postloom/{uuid.uuid4().hex}"
    out = df.observe(watch, *metrics) if watch is not None else df
    out.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written_to"] = path
    for held in _open:
        held.append(table)
    return table


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables that ``cut`` writes within, at the end: for work whose result is stored elsewhere."""
    held: list[DataFrame] = []
    _open.append(held)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not held]
        for table in held:
            release(table)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of every query begun within as soon as it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(table: DataFrame) -> None:
    """Delete the files of a table written by ``cut`` that nothing reads any more; else do nothing."""
    path = table.__dict__.pop("_written_to", None)
    if path:
        jvm = table.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(table: DataFrame) -> bool:
    """True if the files of a table written by ``cut`` are there."""
    path = table.__dict__.get("_written_to")
    if not path:
        return False
    where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(where))


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
