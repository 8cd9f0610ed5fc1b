"""Parquet tables of a corpus below one root folder.

Facts are written batch by batch and never changed. Small tables whose rows do
change (files, links, queues) are written whole in each batch; readers take the
newest batch. A batch folder is written in overwrite mode, so a batch that runs
again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, batch: int | None = None) -> str:
        return f"{self.root}/{name}" if batch is None else f"{self.root}/{name}/batch={batch}"

    def exists(self, name: str, batch: int | None = None) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, batch))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def write(self, name: str, df: DataFrame, batch: int, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write one batch of a table and return it as read back."""
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.path(name, batch))
        return self.spark.read.schema(df.schema).parquet(self.path(name, batch))

    def facts(self, name: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        """All batches of a fact table, or those before one batch."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(wide).parquet(self.path(name))
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def batches(self, name: str) -> list[int]:
        """Batch numbers present, from folder names alone."""
        if not self.exists(name):
            return []
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        listing = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        names = [status.getPath().getName() for status in listing]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))

    def snapshot(self, name: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        """The newest batch of a table that is rewritten whole."""
        usable = [b for b in self.batches(name) if before is None or b < before]
        if not usable:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name, usable[-1]))

    def expire(self, name: str, keep: int = 1) -> None:
        """Remove all but the newest batches of a table."""
        for batch in self.batches(name)[:-keep]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, batch))
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
