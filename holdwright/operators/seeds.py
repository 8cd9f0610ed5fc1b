"""Reference-data upserts and derived relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright.functions.identifiers import business_number, stable_id


def compared_columns(entities: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Existing and expected value of every reference column, one row each.

    outcome: filled (was NULL), kept (equal), conflict (both set and different,
    or the entity has another type), created (no such entity yet).
    """
    expected = reference.select(F.col("canonical_name").alias("r_name"), F.col("entity_type").alias("r_type"), *[F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    joined = expected.join(entities, F.col("r_name") == F.col("canonical_name"), "left")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("existing"), F.col(f"r_{c}").alias("expected")) for c in columns
    ])
    long = joined.select("entity_id", F.col("r_name").alias("canonical_name"), (F.col("entity_type") != F.col("r_type")).alias("other_type"), F.inline(cells))
    same = F.when(F.col("column_name") == "abn", business_number(F.col("existing")) == business_number(F.col("expected"))).otherwise(F.col("existing") == F.col("expected"))
    outcome = (
        F.when(F.col("entity_id").isNull(), "created")
        .when(F.coalesce("other_type", F.lit(False)), "conflict")
        .when(F.col("expected").isNull(), "kept")
        .when(F.col("existing").isNull(), "filled")
        .when(F.coalesce(same, F.lit(False)), "kept")
        .otherwise("conflict")
    )
    return long.withColumn("outcome", outcome).drop("other_type")


def upsert_entities(entities: DataFrame, reference: DataFrame, columns: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Entities after a seed run: NULLs filled, missing entities created.

    With `overwrite` the reference wins. Otherwise an entity with any conflict
    stays as it was; the conflicts are rows of `compared_columns`.
    """
    ref = reference.select(F.col("canonical_name").alias("r_name"), F.col("entity_type").alias("r_type"), *[F.col(c).alias(f"r_{c}") for c in columns])
    both = entities.join(ref, (F.col("canonical_name") == F.col("r_name")) & (F.col("entity_type") == F.col("r_type")), "left")
    clash = F.lit(False)
    for c in columns:
        differs = business_number(F.col(c)) != business_number(F.col(f"r_{c}")) if c == "abn" else F.col(c) != F.col(f"r_{c}")
        clash = clash | F.coalesce(differs, F.lit(False))
    both = both.withColumn("clash", F.lit(False) if overwrite else clash)
    for c in columns:
        pick = F.coalesce(f"r_{c}", c) if overwrite else F.coalesce(c, f"r_{c}")
        both = both.withColumn(c, F.when(F.col("clash"), F.col(c)).otherwise(pick))
    kept = both.select(*entities.columns)
    fresh = reference.join(entities.select("canonical_name"), "canonical_name", "left_anti").withColumn("entity_id", stable_id(F.lit("entity"), F.col("canonical_name")))
    return kept.unionByName(fresh.select(*[c for c in entities.columns if c in fresh.columns]), allowMissingColumns=True)


def new_aliases(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.dropDuplicates(["entity_id", "alias"]).join(stored.select("entity_id", "alias"), ["entity_id", "alias"], "left_anti")


def derive_unique_relations(rows: DataFrame, keys: Sequence[str], stored: DataFrame, role: str) -> DataFrame:
    """A relation for every key that picks exactly one holding.

    status: linked (new), present (already stored), conflict (the holding has
    this role for another entity), not_unique (several holdings fit).
    """
    fits = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("fitting_rows"), F.min("holding_key").alias("holding_key"))
    held = stored.where(F.col("role") == role).groupBy("holding_key").agg(F.min("entity_id").alias("held_by"))
    joined = fits.join(held, "holding_key", "left")
    status = (
        F.when(F.col("fitting_rows") > 1, "not_unique")
        .when(F.col("held_by").isNull(), "linked")
        .when(F.col("held_by") == F.col("entity_id"), "present")
        .otherwise("conflict")
    )
    return joined.withColumn("status", status).drop("held_by")


def check_targets(rows: DataFrame, targets: DataFrame, keys: Sequence[str], fields: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Target rows against the holdings they name.

    One row per target: ok, missing, duplicate, or changed with the names of
    the fields that differ (or are required and empty).
    """
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("found_rows"), F.min("holding_key").alias("holding_key"), *[F.min_by(f, "holding_key").alias(f"actual_{f}") for f in (*fields, *required)]
    )
    joined = targets.join(found, list(keys), "left")
    wrong = [F.when(~F.col(f"actual_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]
    wrong += [F.when(F.col(f"actual_{f}").isNull(), F.lit(f)) for f in required]
    changed = F.array_compact(F.array(*wrong))
    status = F.when(F.col("found_rows").isNull(), "missing").when(F.col("found_rows") > 1, "duplicate").when(F.size(changed) > 0, "changed").otherwise("ok")
    return joined.withColumn("status", status).withColumn("changed_fields", F.when(F.col("status") == "changed", F.concat_ws(",", changed)).otherwise("")).drop(*[f"actual_{f}" for f in (*fields, *required)])


def register_url(acn: Column, prefix: str) -> Column:
    """Record address built from the digits of a company number."""
    return F.concat(F.lit(prefix), F.regexp_replace(acn, "[^0-9]", ""))
