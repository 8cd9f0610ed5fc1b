"""Arriving data as streams: idempotent batches, no state to lose.

Exactly-once comes from keys, not from stream state. A micro-batch that runs
again writes the same batch folder, and rows stored by earlier batches are left
out by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from holdwright.operators.versions import missing_rows
from holdwright.plans.ingest import load_batch
from holdwright.sources.files import registered_by_folder, with_digests
from holdwright.sources.store import Store

LANDING_SCHEMA = "path string, modificationTime timestamp, length long, content binary, layout string, fund string, period string"


def file_stream(spark: SparkSession, landing: str, files_per_batch: int = 1_000) -> DataFrame:
    """New files of a landing folder (layout=…/fund=…/period=…/name.csv)."""
    return (
        spark.readStream.format("binaryFile")
        .schema(LANDING_SCHEMA)
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
    )


def ingest_stream(store: Store, landing: str, versions: DataFrame, taxonomy: DataFrame, progress: str, files_per_batch: int = 1_000) -> StreamingQuery:
    """Load every file present or arriving, batch by batch, then stop when none is left."""

    def load(batch_files: DataFrame, batch_id: int) -> None:
        files = registered_by_folder(with_digests(batch_files))
        load_batch(store, files, versions, taxonomy, batch_id)

    stream = file_stream(store.spark, landing, files_per_batch)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", progress).trigger(availableNow=True).start()


def append_once(store: Store, name: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """Sink that stores each key once, whatever is delivered again."""

    def write(rows: DataFrame, batch_id: int) -> None:
        stored = store.facts(name, rows.schema, before=batch_id)
        store.write(name, missing_rows(rows, stored, key), batch_id)

    return write
