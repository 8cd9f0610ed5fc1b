"""Tables, written intermediates and digests for the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from gc import collect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright.session import checkpoint_dir

TEXT_BUCKET_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_lists: list[list[str]] = []


@contextmanager
def noted(places: list[str]) -> Iterator[None]:
    """Notes the tables that `stored` writes meanwhile, in every list that is open."""
    _lists.append(places)
    try:
        yield
    finally:
        _lists.pop()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Written to the shared folder and read back: lineage ends here, and a lost executor costs only its own tasks."""
    place = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for places in _lists:
        places.append(place)
    df.write.parquet(place, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def removed(spark: SparkSession, places: list[str]) -> None:
    """Delete noted tables that nothing reads any more, and the shuffle files of finished jobs.

    Spark removes the latter once the driver's garbage collection finds their jobs unreachable, which with a
    large driver may be long after the disks are full; so a collection is asked for.
    """
    while places:
        place = spark._jvm.org.apache.hadoop.fs.Path(places.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def text_buckets(docs: DataFrame, text: str = "text", per_bucket: int = TEXT_BUCKET_CHARS) -> int:
    """Number of buckets of about `per_bucket` characters that hold all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(total // per_bucket) + 1


def checked_broadcast(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """The table with a broadcast hint if it has at most `most_rows` narrow rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most_rows else df
