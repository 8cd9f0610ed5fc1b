"""Manifest reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile_files(manifest: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against loaded rows and mapping version of every file, from both sides."""
    left = manifest.withColumn("listed", F.lit(True))
    right = loaded.withColumn("found", F.lit(True))
    both = left.join(right, keys, "full")
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("listed").isNull(), "unlisted")
        .when(F.col("expected_rows") != F.col("observed_rows"), "row_count")
        .otherwise("ok")
    )
    if {"expected_version", "observed_version"} <= set(both.columns):
        other = ~F.col("expected_version").eqNullSafe(F.col("observed_version"))
        status = F.when((status == "ok") & other, "mapping_version").otherwise(status)
    return both.withColumn("status", status).drop("listed", "found")


def reconcile_funds(files: DataFrame, tolerance: int) -> DataFrame:
    """Fund totals of a file reconciliation and whether they are within tolerance."""
    rolled = files.groupBy("fund_code").agg(
        F.count("expected_rows").alias("expected_files"),
        F.count("observed_rows").alias("observed_files"),
        F.coalesce(F.sum("expected_rows"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("observed_rows"), F.lit(0)).alias("observed_rows"),
        F.count_if(F.col("status") != "ok").alias("files_off"),
    )
    delta = F.abs(F.col("expected_rows") - F.col("observed_rows"))
    return rolled.withColumn("row_delta", delta).withColumn("is_within_tolerance", delta <= tolerance)


def manifest_problems(funds: DataFrame, files: DataFrame) -> DataFrame:
    """Funds whose declared file and row totals differ from their own file list."""
    listed = files.groupBy("fund_code").agg(F.count(F.lit(1)).alias("listed_files"), F.sum("expected_rows").alias("listed_rows"))
    joined = funds.join(listed, "fund_code", "left").fillna(0, ["listed_files", "listed_rows"])
    return joined.where((F.col("expected_source_file_count") != F.col("listed_files")) | (F.col("expected_row_count") != F.col("listed_rows")))


def gated_files(manifest: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Every file of a manifest or a landing, and whether a load may publish it.

    manifest: keys, expected_rows, expected_version. landed: keys, ingest_status, observed_rows, observed_version.
    status: listed_twice, landed_twice, missing, unlisted, rejected (it did not load), row_count, mapping_version
    or ok. A key that stands several times on one side is one row, with its least values.
    """
    listed = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("times_listed"), F.min("expected_rows").alias("expected_rows"), F.min("expected_version").alias("expected_version"))
    seen = landed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("times_landed"), F.max("ingest_status").alias("ingest_status"), F.min("observed_rows").alias("observed_rows"), F.min("observed_version").alias("observed_version")
    )
    both = reconcile_files(listed, seen, keys)
    status = (
        F.when(F.col("times_listed") > 1, "listed_twice")
        .when(F.col("times_landed") > 1, "landed_twice")
        .when(F.col("ingest_status") != "loaded", "rejected")
        .when(F.col("times_listed").isNotNull() & F.col("times_landed").isNotNull() & F.col("expected_rows").isNull(), "row_count")
        .otherwise(F.col("status"))
    )
    return both.withColumn("status", status).drop("times_listed", "times_landed", "ingest_status")


def gated_batches(files: DataFrame, declared: DataFrame, batch: list[str]) -> DataFrame:
    """Whether a batch may be published: each of its files is ok, and its totals are the declared ones.

    files: of `gated_files`. declared: batch, expected_source_file_count, expected_row_count, row_count_tolerance.
    A batch nobody declared, or one without files, is not published.
    """
    rolled = files.groupBy(*batch).agg(
        F.count_if(F.col("status") != "ok").alias("files_off"), F.count_if(F.col("status") == "ok").alias("files_ok"), F.coalesce(F.sum("observed_rows"), F.lit(0)).alias("rows_staged")
    )
    both = declared.join(rolled, batch, "full").fillna(0, ["files_off", "files_ok", "rows_staged"])
    delta = F.abs(F.col("rows_staged") - F.col("expected_row_count"))
    good = (F.col("files_off") == 0) & (F.col("files_ok") == F.col("expected_source_file_count")) & (delta <= F.col("row_count_tolerance"))
    return both.withColumn("row_delta", delta).withColumn("is_published", F.coalesce(good, F.lit(False)))
