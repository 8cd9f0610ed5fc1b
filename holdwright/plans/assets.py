"""Matched assets that a corpus keeps: their entities, the holdings linked to them, and the list with coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdwright.operators import assets
from holdwright.plans.corpus import Corpus, current_named
from holdwright.plans.links import schema_of
from holdwright.session import written_once
from holdwright.sources.keyed import KeyedTable, Merge, keyed
from holdwright.sources.store import Store
from holdwright.vocab import GEO

ASSETS = f"name_key string, place_key string, entity_id bigint, entity_type string, canonical_name string, confidence_tier string, geo_lat {GEO}, geo_lng {GEO}, origin string, run int"
ASSET_LINKS = "holding_key string, entity_id bigint, role string, confidence_score decimal(6,5), source string, run int"
ROLE = "property_asset_match"
SOURCE = "asset_coordinates"


class Assets:
    """The asset tables of a store."""

    def __init__(self, store: Store, buckets: int = 16):
        self.assets: KeyedTable = keyed(store, "assets/entities", schema_of(ASSETS), assets.KEY, buckets)
        self.links: KeyedTable = keyed(store, "assets/links", schema_of(ASSET_LINKS), ["holding_key"], buckets)

    def entities(self, base: DataFrame) -> DataFrame:
        """Given entities and those created for assets."""
        made = self.assets.rows().where(F.col("origin") == "created").select("entity_id", "entity_type", "canonical_name", F.lit(None).cast("string").alias("abn"), "confidence_tier")
        return base.unionByName(made.select(*base.columns))

    def run(self, corpus: Corpus, run: int) -> tuple[DataFrame, dict[str, Merge]]:
        """Make the assets that current holdings show and link the holdings; every asset row with its outcome.

        A holding keeps its first asset, an asset its first coordinates. A second run over the same holdings writes nothing.
        """
        rows = written_once(assets.asset_rows(current_named(corpus)))
        keys = written_once(assets.new_assets(rows, self.assets.rows(), corpus.entities))
        fresh = keys.where(F.col("entity_id").isNotNull())
        wrote = {"assets": self.assets.merge(fresh.withColumn("confidence_tier", F.lit("seeded")).withColumn("origin", F.col("status")).withColumn("run", F.lit(run)))}
        refused = keys.where(F.col("entity_id").isNull() & (F.col("status") != "known"))
        done = written_once(assets.asset_matches(rows, self.assets.rows(), refused, self.links.rows()))
        link = done.where(F.col("outcome") == "linked").select(
            "holding_key", F.col("asset_entity_id").alias("entity_id"), F.lit(ROLE).alias("role"), F.lit(1).cast("decimal(6,5)").alias("confidence_score"), F.lit(SOURCE).alias("source"), F.lit(run).alias("run")
        )
        return done, {**wrote, "links": self.links.merge(link)}

    def matched(self, corpus: Corpus) -> DataFrame:
        """Current holdings of matched assets with the coordinates and provenance of each."""
        rows = current_named(corpus).select(
            "holding_key", "fund_code", "fund_name", "option_code", "option_name", "reporting_period", "asset_class_code", "source_asset_class_raw", "source_subclass_raw", "disclosure_completeness",
            "ownership_pct", "value_band_raw", "classification_raw", "address_raw", "location_raw", "geo_lat", "geo_lng", "source_file_id", "source_row_number",
        )
        names = self.assets.rows().groupBy("entity_id").agg(F.min("canonical_name").alias("asset_name"), F.min("entity_type").alias("entity_type"))
        links = self.links.rows().where(F.col("role") == ROLE).select("holding_key", F.col("entity_id").alias("asset_entity_id"), "confidence_score", F.col("source").alias("relationship_source"))
        return rows.join(links, "holding_key").join(names.withColumnRenamed("entity_id", "asset_entity_id"), "asset_entity_id")
