"""Disclosure corpus as views over the order-processing test tables.

Files are orders, rows are line items, options are customers, funds are
nations, companies and assets are parts, managers are suppliers.
"""

from __future__ import annotations

import dataclasses
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions import rules
from holdwright.functions.numbers import half_year_end
from holdwright.functions.text import lookup, normalise_name
from holdwright.operators.skew import dealt
from holdwright.plans.corpus import Corpus

CLASS_OF_TYPE = {
    "STANDARD": "listed_equity",
    "MEDIUM": "unlisted_equity",
    "ECONOMY": "fixed_income",
    "SMALL": "unlisted_infrastructure",
    "LARGE": "unlisted_property",
    "PROMO": "private_debt",
}
ENTITY_TYPE_OF_TYPE = {"SMALL": "infrastructure_asset", "LARGE": "property_asset", "PROMO": "fund_vehicle"}
EXPIRY_CUTOFF = "2000-01-01"


class DriverTables:
    """Lazy views over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def registered(self) -> DataFrame:
        """Files with their slice, before versions are worked out."""
        orders = self.table("orders").withColumn("received_on", F.col("o_orderdate").cast("date"))
        customers = self.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        nations = self.table("nation").select("n_nationkey", "n_name")
        return (
            orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("source_file_id"),
                F.col("n_name").alias("fund_code"),
                F.concat(F.lit("Fund "), F.col("n_nationkey").cast("string")).alias("fund_name"),
                F.col("c_custkey").cast("string").alias("option_code"),
                F.col("c_name").alias("option_name"),
                F.lower("c_mktsegment").alias("layout_key"),
                half_year_end(F.col("received_on")).alias("reporting_period"),
                "received_on",
                F.when(F.col("o_orderstatus") == "P", "review_required").otherwise("loaded").alias("ingest_status"),
                F.col("o_totalprice").cast(vocab.MONEY).alias("declared_total"),
            )
        )

    @cached_property
    def source_files(self) -> DataFrame:
        """Adds the current flag: the newest loaded file of a slice, or any file not loaded."""
        orders = self.table("orders").where(F.col("o_orderstatus") != "P")
        newest = orders.groupBy("o_custkey", half_year_end(F.col("o_orderdate").cast("date")).alias("half")).agg(
            F.max(F.struct(F.col("o_orderdate"), F.col("o_orderkey"))).alias("newest")
        )
        current = newest.select(F.col("newest.o_orderkey").alias("current_id"))
        files = self.registered.join(current, F.col("source_file_id") == F.col("current_id"), "left")
        flag = F.col("current_id").isNotNull() | (F.col("ingest_status") != "loaded")
        return files.withColumn("is_current", flag).drop("current_id")

    @cached_property
    def current_loaded_files(self) -> DataFrame:
        return self.source_files.where(F.col("is_current") & (F.col("ingest_status") == "loaded"))

    @cached_property
    def lines(self) -> DataFrame:
        """Line items as holdings, no names yet. Only loaded files have rows."""
        return self.table("lineitem").select(*self._line_columns())

    @staticmethod
    def _line_columns() -> list[Column]:
        aggregate = F.col("l_linenumber") == 7
        value = F.when(F.col("l_tax") < 0.07, F.col("l_extendedprice").cast(vocab.MONEY))
        owned = F.when(F.col("l_discount") <= 0.02, F.col("l_discount").cast(vocab.FRACTION))
        units = F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast(vocab.UNITS))
        has_id = F.col("l_quantity") > 40
        part = F.lpad(F.col("l_partkey").cast("string"), 10, "0")
        isin = F.col("l_linenumber") % 2 == 1
        abn = F.concat(F.lit("0"), F.substring(part, 1, 1), F.lit(" "), F.substring(part, 2, 3), F.lit(" "), F.substring(part, 5, 3), F.lit(" "), F.substring(part, 8, 3))
        return [
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyyMMdd")).alias("holding_key"),
            F.col("l_orderkey").alias("source_file_id"),
            F.col("l_linenumber").alias("source_row_number"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_shipdate").cast("date").alias("row_date"),
            (~aggregate).alias("has_name"),
            aggregate.alias("is_aggregate"),
            value.alias("value_aud"),
            owned.alias("ownership_pct"),
            units.alias("units"),
            F.when(F.col("l_returnflag") == "A", "Internally Managed").when(F.col("l_returnflag") == "R", "Externally Managed").alias("source_subclass_raw"),
            F.when(has_id, F.when(isin, "ISIN").otherwise("ABN")).alias("identifier_type"),
            F.when(has_id, F.when(isin, F.concat(F.lit("AU"), part)).otherwise(abn)).alias("identifier_value"),
            F.when(value.isNull() & (F.col("l_discount") >= 0.08), "Band 1").alias("value_band_raw"),
            rules.completeness(
                "flat",
                aggregate=aggregate,
                value=value,
                ownership=owned,
                units=units,
                identifier=F.when(has_id, F.lit("id")),
            ).alias("disclosure_completeness"),
            F.when(F.col("l_quantity") <= 25, F.col("l_partkey") * 2).when(F.col("l_quantity") <= 30, F.col("l_suppkey") * 2 + 1).alias("entity_id"),
            F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") * 2 + 1).alias("manager_entity_id"),
            F.when((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.07), F.col("l_partkey") * 2).alias("issuer_entity_id"),
            # bridge rows of `holding_relations`, one issuer per holding at most
            F.when((F.col("l_linenumber") == 1) & (F.col("l_discount") >= 0.09), F.col("l_partkey") * 2).alias("issuer_bridge_id"),
            F.when(F.col("l_quantity") < 5, "Fund Manager").when(F.col("l_quantity") < 20, F.concat(F.lit("Grade "), F.col("l_linestatus"))).alias("classification_raw"),
            F.col("l_quantity").alias("quantity"),
        ]

    @staticmethod
    def _part_name() -> Column:
        return F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))

    def _with_names(self, rows: DataFrame, kept: list[str]) -> DataFrame:
        """Holdings with their disclosed name in one of three spellings, and class."""
        parts = self.table("part").select("p_partkey", self._part_name().alias("part_name"), "p_type")
        joined = rows.join(parts, F.col("part_id") == F.col("p_partkey"), "left")
        spelling = F.col("source_row_number") % 3
        name = (
            F.when(F.col("is_aggregate"), F.lit(None).cast("string"))
            .when(spelling == 0, F.upper("part_name"))
            .when(spelling == 1, F.concat(F.lit("  "), F.replace("part_name", F.lit(" "), F.lit("  ")), F.lit(" ")))
            .otherwise(F.col("part_name"))
        )
        return joined.select(
            *kept,
            name.alias("raw_name"),
            F.col("p_type").alias("source_asset_class_raw"),
            lookup(CLASS_OF_TYPE, F.col("p_type")).alias("asset_class_code"),
        )

    @cached_property
    def named_lines(self) -> DataFrame:
        return self._with_names(self.lines, self.lines.columns)

    @cached_property
    def observations(self) -> DataFrame:
        """Star join of named holdings and their files, dealt by file in tasks of bounded rows."""
        files = self.source_files.where(F.col("ingest_status") == "loaded").drop("declared_total")
        rows, files = dealt(self.table("lineitem").count(), ["source_file_id"], self.named_lines, files)
        return rows.join(files, "source_file_id")

    @cached_property
    def late_observations(self) -> DataFrame:
        """The same rows, made in another order: line items meet their files as they are stored, numbers and flags for the most part.

        Keys, names and identifiers are texts made of them, several times as wide, so they are made behind the move.
        """
        files = self.source_files.where(F.col("ingest_status") == "loaded").drop("declared_total")
        stored = self.table("lineitem").withColumn("file_id", F.col("l_orderkey"))
        rows, files = dealt(self.table("lineitem").count(), ["file_id"], stored, files.withColumnRenamed("source_file_id", "file_id"))
        of_file = [c for c in files.columns if c != "file_id"]
        joined = rows.join(files, "file_id").select(*self._line_columns(), *of_file)
        named = self._with_names(joined, joined.columns)
        return named.select(*self.observations.columns)

    @cached_property
    def named_slices(self) -> DataFrame:
        """Slices of current files with a named row; needs no names, so no join to parts."""
        named = self.lines.where(~F.col("is_aggregate")).select("source_file_id")
        return self.current_loaded_files.join(named, "source_file_id", "left_semi").select("fund_code", "reporting_period")

    @cached_property
    def entities(self) -> DataFrame:
        parts = self.table("part").select(
            (F.col("p_partkey") * 2).alias("entity_id"),
            F.coalesce(lookup(ENTITY_TYPE_OF_TYPE, F.col("p_type")), F.lit("company")).alias("entity_type"),
            self._part_name().alias("canonical_name"),
            F.lpad((F.col("p_partkey") - F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).cast("string"), 11, "0").alias("abn"),
            F.when(F.col("p_size") <= 10, "seeded").when(F.col("p_size") <= 20, "high").when(F.col("p_size") <= 30, "medium").when(F.col("p_size") <= 40, "low").alias("confidence_tier"),
        )
        suppliers = self.table("supplier").select(
            (F.col("s_suppkey") * 2 + 1).alias("entity_id"),
            F.lit("manager").alias("entity_type"),
            F.col("s_name").alias("canonical_name"),
            F.lit(None).cast("string").alias("abn"),
            F.when(F.col("s_nationkey") < 10, "seeded").when(F.col("s_nationkey") < 15, "high").alias("confidence_tier"),
        )
        return parts.unionByName(suppliers)

    @cached_property
    def aliases(self) -> DataFrame:
        parts = self.table("part")
        short = parts.select((F.col("p_partkey") * 2).alias("entity_id"), F.concat_ws(" ", "p_name", "p_brand").alias("alias"), F.lit(True).alias("is_preferred"))
        loud = parts.select((F.col("p_partkey") * 2).alias("entity_id"), F.upper(self._part_name()).alias("alias"), F.lit(False).alias("is_preferred"))
        managers = self.table("supplier").select((F.col("s_suppkey") * 2 + 1).alias("entity_id"), F.replace("s_name", F.lit("#"), F.lit(" No ")).alias("alias"), F.lit(True).alias("is_preferred"))
        return short.unionByName(loud).unionByName(managers).withColumn("alias_normalized", normalise_name(F.col("alias")))

    @cached_property
    def identifiers(self) -> DataFrame:
        """Registry rows; some identifiers belong to two entities, some to none."""
        parts = self.table("part").select("p_partkey", "p_size")
        own = parts.where(F.col("p_size") > 10).select((F.col("p_partkey") * 2).alias("entity_id"), F.col("p_partkey").alias("n"))
        shared = parts.where(F.col("p_size") > 45).select((F.col("p_partkey") * 2).alias("entity_id"), (F.col("p_partkey") + 1).alias("n"))
        return own.unionByName(shared).select(
            "entity_id", F.lit("isin").alias("identifier_type"), F.concat(F.lit("au "), F.lpad(F.col("n").cast("string"), 10, "0")).alias("identifier_value")
        )

    @cached_property
    def overrides(self) -> DataFrame:
        """Stored match decisions for the larger parts; some have an equal rival, some have expired."""
        parts = self.table("part").where(F.col("p_size") > 35)
        size = F.col("p_size")
        action = F.element_at(F.array(*[F.lit(a) for a in vocab.OVERRIDE_ACTIONS]), (size % 4 + 1).cast("int"))
        base = parts.select(
            F.col("p_partkey").alias("override_id"),
            normalise_name(self._part_name()).alias("name_key"),
            F.when(F.col("p_type").isin("SMALL", "LARGE"), F.concat(F.lit("NATION_"), (size - 36).cast("string"))).alias("fund_code"),
            F.when(F.col("p_type").isin("SMALL", "PROMO", "STANDARD"), F.col("p_type")).alias("asset_class_scope"),
            F.when(size.isin(40, 45, 50), F.coalesce(lookup(ENTITY_TYPE_OF_TYPE, F.col("p_type")), F.lit("company"))).alias("entity_type_scope"),
            action.alias("action"),
            F.when(action.isin("force_match", "redirect_to_parent"), F.col("p_partkey") * 2).alias("matched_entity_id"),
            F.when(size >= 48, F.lit("1999-12-31")).otherwise(F.lit(None)).cast("date").alias("expires_at"),
            size.alias("part_size"),
        )
        rival = base.where(F.col("part_size") > 43).withColumn("override_id", -F.col("override_id")).withColumn("fund_code", F.lit(None).cast("string"))
        return base.unionByName(rival).drop("part_size")

    @cached_property
    def holding_relations(self) -> DataFrame:
        rows = self.lines
        issuer = rows.where(F.col("issuer_bridge_id").isNotNull()).select("holding_key", F.col("issuer_bridge_id").alias("entity_id"), F.lit("issuer").alias("role"))
        asset = rows.where((F.col("source_row_number") == 2) & (F.col("quantity") == 50)).select("holding_key", (F.col("part_id") * 2).alias("entity_id"), F.lit("property_asset_match").alias("role"))
        return issuer.unionByName(asset).withColumn("confidence_score", F.lit("1.00000").cast("decimal(6,5)"))

    @cached_property
    def entity_relations(self) -> DataFrame:
        li = self.table("lineitem").where((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R"))
        return li.select((F.col("l_suppkey") * 2 + 1).alias("from_entity_id"), (F.col("l_partkey") * 2).alias("to_entity_id"), F.lit("manages").alias("relationship_type")).distinct()

    @cached_property
    def corpus(self) -> Corpus:
        return Corpus(
            observations=self.observations,
            source_files=self.source_files,
            entities=self.entities,
            aliases=self.aliases,
            identifiers=self.identifiers,
            overrides=self.overrides,
            holding_relations=self.holding_relations,
            entity_relations=self.entity_relations,
            named_slices=self.named_slices,
        )

    @cached_property
    def late_corpus(self) -> Corpus:
        """The corpus for jobs that move all holdings by other keys than their file."""
        return dataclasses.replace(self.corpus, observations=self.late_observations)
