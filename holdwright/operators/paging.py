"""Ranking and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_pages(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("bigint")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a globally ordered result."""
    if number < 1:
        raise ValueError("page must be at least 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of every group.

    Spark keeps only n rows per group before the shuffle, so a hot group costs
    n rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def page_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The same page of every group."""
    if number < 1:
        raise ValueError("page must be at least 1")
    out = top_of_each(df, keys, order, number * size, rank="position")
    return out.where(F.col("position") > (number - 1) * size)
