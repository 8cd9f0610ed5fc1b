"""The tables every read model works on, and the predicates they share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdwright.functions.text import normalise_name


@dataclass(frozen=True)
class Corpus:
    """One disclosure corpus.

    observations  one row per holding, joined to its file, fund, option, period
                  and class; entity links included, unresolved rows kept
    source_files  one row per registered file version
    """

    observations: DataFrame
    source_files: DataFrame
    entities: DataFrame
    aliases: DataFrame
    identifiers: DataFrame
    overrides: DataFrame
    holding_relations: DataFrame
    entity_relations: DataFrame
    named_slices: DataFrame | None = None  # (fund_code, reporting_period) with a current named row, when cheaper than from rows


def loaded_current(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_current") & (F.col("ingest_status") == "loaded"))


def current_rows(corpus: Corpus) -> DataFrame:
    """Current, loaded, non-aggregate rows."""
    return loaded_current(corpus.observations).where(~F.col("is_aggregate"))


def current_named(corpus: Corpus) -> DataFrame:
    """Current rows that carry a name: the base of every entity and fund view."""
    return current_rows(corpus).where(F.col("has_name"))


def only(df: DataFrame, column: str, values: Sequence[str] | str | None) -> DataFrame:
    """IN filter after trimming and de-duplicating; no values means no filter."""
    wanted = cleaned_values(values)
    return df.where(F.col(column).isin(*wanted)) if wanted else df


def cleaned_values(values: Sequence[str] | str | None) -> list[str]:
    given = [values] if isinstance(values, str) else list(values or [])
    return list(dict.fromkeys(v for v in (str(g).strip() for g in given) if v))


def with_status(df: DataFrame, status: str) -> DataFrame:
    return df if status == "all" else df.where(F.col("status") == status)


def latest_periods(corpus: Corpus) -> DataFrame:
    """Latest and prior observed period of every fund.

    Slices are made distinct first; then only two rows per fund and input
    partition reach the ranking.
    """
    seen = current_named(corpus) if corpus.named_slices is None else corpus.named_slices
    seen = seen.select("fund_code", "reporting_period").distinct()
    recent = Window.partitionBy("fund_code").orderBy(F.desc("reporting_period"))
    ranked = seen.withColumn("recency", F.dense_rank().over(recent)).where(F.col("recency") <= 2)
    return ranked.groupBy("fund_code").agg(
        F.max(F.when(F.col("recency") == 1, F.col("reporting_period"))).alias("latest_period"),
        F.max(F.when(F.col("recency") == 2, F.col("reporting_period"))).alias("prior_period"),
    )


def in_latest_period(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """Keep the rows of each fund's latest period."""
    key = latest.select(F.col("fund_code").alias("latest_fund"), "latest_period")
    on = (F.col("fund_code") == F.col("latest_fund")) & (F.col("reporting_period") == F.col("latest_period"))
    return rows.join(key, on, "left_semi")


def entity_names(corpus: Corpus) -> DataFrame:
    """Every normalised name an entity answers to, once per entity."""
    canonical = corpus.entities.select("entity_id", "entity_type", normalise_name(F.col("canonical_name")).alias("name_key"))
    types = corpus.entities.select("entity_id", "entity_type")
    alias = corpus.aliases.select("entity_id", F.col("alias_normalized").alias("name_key")).join(types, "entity_id")
    return canonical.unionByName(alias).where(F.col("name_key") != "").distinct()
