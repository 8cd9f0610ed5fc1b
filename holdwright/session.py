"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from gc import collect

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "holdwright", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A small local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HOLDWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # HotSpot leaves longer methods uncompiled
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's own setting, else a scratch one.

    The fallback exists only for single-machine runs, where driver and
    executors share the disk; it is made once per application.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="holdwright-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scratch: list[list[str]] = []


def written_once(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """A result that several later steps read, written as a table and read back.

    Later steps scan the table instead of repeating the work, and a lost
    executor costs only its own tasks.
    """
    place = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for places in _scratch:
        places.append(place)
    df.write.parquet(place, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def freed(spark: SparkSession) -> None:
    """Ask for the collection that lets Spark remove the shuffle files of finished jobs."""
    collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What `written_once` writes meanwhile goes at the end, and so do shuffle files; nothing read later may stand on it.

    Gives the list of these tables, from which one that is to stay is taken out.
    """
    places: list[str] = []
    _scratch.append(places)
    try:
        yield places
    finally:
        _scratch[:] = [p for p in _scratch if p is not places]
        for name in places:
            place = spark._jvm.org.apache.hadoop.fs.Path(name)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        freed(spark)


def written_alone(spark: SparkSession, made: Callable[[], DataFrame], compression: str = "zstd") -> DataFrame:
    """A result written as a table; the tables written on the way to it and the shuffle files go, so the disks hold one step at a time."""
    with scratch(spark) as places:
        out = written_once(made(), compression)
        places.pop()
    return out
