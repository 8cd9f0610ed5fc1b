"""Assets: entities made from holdings that show where a property or a plant stands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright.functions.identifiers import stable_id
from holdwright.functions.text import lookup, normalise_name
from holdwright.operators.skew import skewed_lookup

KEY = ["name_key", "place_key"]
ASSET_TYPES = {"unlisted_property": "property_asset", "unlisted_infrastructure": "infrastructure_asset"}


def coordinate_problem(lat: Column, lng: Column) -> Column:
    """Why a pair of coordinates cannot be shown, or NULL."""
    return (
        F.when(lat.isNull() & lng.isNull(), "no_coordinates")
        .when(lat.isNull() | lng.isNull(), "half_a_pair")
        .when(~lat.between(-90, 90) | ~lng.between(-180, 180), "out_of_range")
    )


def asset_rows(rows: DataFrame, types: Mapping[str, str] = ASSET_TYPES) -> DataFrame:
    """Holdings of asset classes under their asset key, with what keeps a row from being matched.

    The place is the address, else the location, else the pair itself; without any of these a row has no key and its problem says so.
    """
    text = lambda c: F.nullif(normalise_name(F.col(c)), F.lit(""))
    pair = F.when(F.col("geo_lat").isNotNull() & F.col("geo_lng").isNotNull(), F.concat_ws(",", F.format_number("geo_lat", 8), F.format_number("geo_lng", 8)))
    kept = rows.where(F.col("asset_class_code").isin(*types)).withColumn("entity_type", lookup(dict(types), F.col("asset_class_code")))
    named = kept.withColumn("name_key", text("raw_name")).withColumn("place_key", F.coalesce(text("address_raw"), text("location_raw"), pair))
    problem = F.when(F.col("name_key").isNull(), "no_name").otherwise(coordinate_problem(F.col("geo_lat"), F.col("geo_lng")))
    return named.withColumn("problem", problem)


def new_assets(rows: DataFrame, stored: DataFrame, entities: DataFrame) -> DataFrame:
    """What becomes of every asset key that has a row without problem.

    status: known (stored before), conflicting_coordinates, conflicting_types, several_entities (the name has more
    than one), other_type (its entity is of another type), several_places (the name has one entity, but more than one place),
    adopted (that entity becomes the asset) or created. Least and greatest of a key reduce before the shuffle, so a name with
    a third of all rows costs one row a task.
    """
    pair = F.struct("geo_lat", "geo_lng")
    sound = rows.where(F.col("problem").isNull())
    keyed = sound.groupBy(*KEY).agg(
        F.min(pair).alias("pair"), F.max(pair).alias("last_pair"), F.min("entity_type").alias("entity_type"), F.max("entity_type").alias("last_type"),
        F.min_by("raw_name", "holding_key").alias("canonical_name"), F.count(F.lit(1)).alias("row_count"),
    )
    held = stored.select(*KEY, F.lit(True).alias("is_known"))
    # entities made for assets are among the entities too and do not stand for a name of their own
    given = entities.join(stored.where(F.col("origin") == "created").select("entity_id"), "entity_id", "left_anti")
    named = given.select(normalise_name(F.col("canonical_name")).alias("name_key"), "entity_id", F.col("entity_type").alias("given_type"))
    named = named.groupBy("name_key").agg(F.count(F.lit(1)).alias("given_count"), F.min("entity_id").alias("given_id"), F.min("given_type").alias("given_type"))
    places = keyed.select(*KEY).union(stored.select(*KEY)).distinct().groupBy("name_key").agg(F.count(F.lit(1)).alias("place_count"))
    both = keyed.join(held, KEY, "left").join(named, "name_key", "left").join(places, "name_key")
    status = (
        F.when(F.col("is_known"), "known")
        .when(F.col("last_type") != F.col("entity_type"), "conflicting_types")
        .when(F.col("last_pair") != F.col("pair"), "conflicting_coordinates")
        .when(F.col("given_count") > 1, "several_entities")
        .when(F.col("given_type") != F.col("entity_type"), "other_type")
        .when(F.col("given_count").isNotNull() & (F.col("place_count") > 1), "several_places")
        .when(F.col("given_count").isNotNull(), "adopted")
        .otherwise("created")
    )
    made = F.when(status == "created", stable_id(F.lit("asset"), *[F.col(k) for k in KEY])).when(status == "adopted", F.col("given_id"))
    return both.select(*KEY, status.alias("status"), made.alias("entity_id"), "entity_type", "canonical_name", F.col("pair.geo_lat").alias("geo_lat"), F.col("pair.geo_lng").alias("geo_lng"), "row_count")


def asset_matches(rows: DataFrame, assets: DataFrame, refused: DataFrame, links: DataFrame) -> DataFrame:
    """Every asset row with its outcome.

    outcome: the row's own problem, the reason its key was refused, other_coordinates (the asset stands elsewhere),
    other_asset (the holding is linked to another one already), present or linked.
    """
    known = assets.select(*KEY, F.col("entity_id").alias("asset_entity_id"), F.col("geo_lat").alias("asset_lat"), F.col("geo_lng").alias("asset_lng"))
    told = known.join(refused.select(*KEY, F.col("status").alias("refusal")), KEY, "full")
    seen = skewed_lookup(rows, told, KEY, ["holding_key"])
    seen = skewed_lookup(seen, links.select("holding_key", F.col("entity_id").alias("held_by")), ["holding_key"], ["holding_key"])
    elsewhere = (F.col("geo_lat") != F.col("asset_lat")) | (F.col("geo_lng") != F.col("asset_lng"))
    outcome = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("asset_entity_id").isNull(), F.col("refusal"))
        .when(elsewhere, "other_coordinates")
        .when(F.col("held_by").isNull(), "linked")
        .when(F.col("held_by") != F.col("asset_entity_id"), "other_asset")
        .otherwise("present")
    )
    return seen.withColumn("outcome", outcome).drop("asset_lat", "asset_lng", "refusal", "held_by")
