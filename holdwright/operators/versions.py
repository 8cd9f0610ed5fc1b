"""File registration, version chains and idempotent appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.operators.skew import ordered_positions

SLICE = ["fund_code", "option_code", "reporting_period", "layout_key"]


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the first in `order`, ties broken by the other columns, so every run keeps the same one."""
    rest = [c for c, t in rows.dtypes if c not in {*keys, *order} and "map<" not in t]
    place = F.struct(*order, *rest) if order or rest else F.lit(0)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), place).alias("first_row")).select("first_row.*")


def new_files(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Arrived files whose (fund, layout, checksum) is no current version yet."""
    keys = ["fund_code", "layout_key", "checksum"]
    first = first_of(arrived, keys)
    return first.join(stored.where("is_current").select(*keys), keys, "left_anti")


def version_chain(files: DataFrame, order: Sequence[str], block: Column, keys: Sequence[str] = SLICE, file_id: str = "source_file_id") -> DataFrame:
    """Version number, superseded file and current flag of every loaded file.

    A restatement supersedes the file before it in arrival order, so exactly
    the newest file of a slice is current. Links are derived from the order
    each time, never from earlier state.
    """
    placed = ordered_positions(files, keys, block, order, value=file_id)
    return (
        placed.withColumn("version_number", F.col("position").cast("bigint"))
        .withColumn("supersedes_file_id", F.col("previous"))
        .withColumn("is_current", F.col("following").isNull())
        .drop("position", "previous", "following")
    )


def missing_rows(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Wanted rows whose key is not stored yet, the first of each key."""
    return first_of(wanted, keys, order).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def period_rows(dates: DataFrame) -> DataFrame:
    """Reporting-period rows of the distinct period ends."""
    return dates.select("reporting_period").distinct().select(
        "reporting_period",
        F.date_add("reporting_period", vocab.DISCLOSURE_DUE_DAYS).alias("disclosure_due"),
        F.date_format("reporting_period", "yyyy-MM-dd").alias("label"),
    )


def load_counts(staged: DataFrame, stored: DataFrame, file_id: str = "source_file_id", row_hash: str = "source_row_hash") -> DataFrame:
    """Per file: rows staged, rows an idempotent append inserts, rows it skips."""
    known = stored.select(file_id, row_hash).distinct().withColumn("known", F.lit(True))
    hashes = staged.groupBy(file_id, row_hash).agg(F.count(F.lit(1)).alias("copies"))
    marked = hashes.join(known, [file_id, row_hash], "left")
    return marked.groupBy(file_id).agg(
        F.sum("copies").alias("rows_staged"),
        F.count_if(F.col("known").isNull()).alias("rows_inserted"),
        (F.sum("copies") - F.count_if(F.col("known").isNull())).alias("rows_skipped_existing"),
    )


def rows_to_append(staged: DataFrame, stored: DataFrame | None = None, file_id: str = "source_file_id", row_hash: str = "source_row_hash", row_number: str = "source_row_number") -> DataFrame:
    """Staged rows not stored yet; of rows with one hash the first of the file stays."""
    keys = [file_id, row_hash]
    return first_of(staged, keys, [row_number]) if stored is None else missing_rows(staged, stored, keys, [row_number])
