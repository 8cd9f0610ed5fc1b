"""Read models: every public query, computed for all funds or entities at once.

A single fund or entity is the same DataFrame with a filter, which Catalyst
pushes to the scans. Lists inside a page (names, members, candidates) are rows
of a child result, so no group is ever gathered into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions import rules
from holdwright.functions.text import fold, lookup, normalise_name
from holdwright.operators.paging import page, page_of_each, top_of_each, total_pages
from holdwright.operators.skew import join_in_blocks
from holdwright.plans.corpus import (
    Corpus,
    current_named,
    current_rows,
    entity_names,
    in_latest_period,
    latest_periods,
    loaded_current,
    only,
)
from holdwright.session import written_once

LINKS = ["entity_id", "manager_entity_id", "issuer_entity_id", "issuer_bridge_id"]


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(vocab.TOTAL)


# --- files -------------------------------------------------------------------


def file_list(corpus: Corpus) -> DataFrame:
    """Every file version with its loaded row count; files without rows show 0."""
    counts = corpus.observations.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("rows_loaded"))
    files = corpus.source_files.select(
        "source_file_id", "fund_code", "fund_name", "layout_key", "ingest_status", "reporting_period", "received_on", "is_current"
    )
    return files.join(counts, "source_file_id", "left").withColumn("rows_loaded", F.coalesce("rows_loaded", F.lit(0)))


def file_list_order() -> list[Column]:
    return [F.desc("received_on"), F.desc("source_file_id")]


def file_profile(corpus: Corpus) -> DataFrame:
    """Row counts of each file by disclosure state and by asset class."""
    facets = F.array(
        F.struct(F.lit("completeness").alias("facet"), F.col("disclosure_completeness").alias("facet_value")),
        F.struct(F.lit("asset_class").alias("facet"), F.col("asset_class_code").alias("facet_value")),
    )
    long = corpus.observations.select("source_file_id", F.inline(facets))
    return long.groupBy("source_file_id", "facet", "facet_value").agg(F.count(F.lit(1)).alias("row_count"))


def file_page(corpus: Corpus, number: int, size: int) -> DataFrame:
    """The same page of every file's rows, with the file's totals."""
    rows = corpus.observations.select(
        "source_file_id", "source_row_number", "holding_key", "disclosure_completeness", "value_aud", "ownership_pct"
    )
    order = [F.asc("source_row_number"), F.asc("holding_key")]
    picked = page_of_each(rows, ["source_file_id"], order, number, size)
    totals = rows.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("total_rows"))
    totals = totals.withColumn("total_pages", total_pages(F.col("total_rows"), size))
    return picked.join(totals, "source_file_id")


# --- corpus statistics -------------------------------------------------------


def corpus_stats(corpus: Corpus) -> DataFrame:
    """Home-page counters in one row. Each source gives partial counters; one sum joins them."""
    names = ["funds_loaded", "source_files_loaded", "holding_rows_loaded", "reviewed_companies", "reviewed_managers"]

    def part(df: DataFrame, **counters: Column) -> DataFrame:
        return df.agg(*[counters.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    files = part(loaded_current(corpus.source_files), funds_loaded=F.count_distinct("fund_code"), source_files_loaded=F.count(F.lit(1)))
    rows = part(loaded_current(corpus.observations), holding_rows_loaded=F.count(F.lit(1)))
    linked = current_rows(corpus).where(F.col("entity_id").isNotNull()).select("entity_id").distinct()
    seeded = corpus.entities.where(F.col("confidence_tier") == "seeded").select("entity_id", "entity_type")
    reviewed = part(
        linked.join(seeded, "entity_id"),
        reviewed_companies=F.count_if(F.col("entity_type") == "company"),
        reviewed_managers=F.count_if(F.col("entity_type") == "manager"),
    )
    return files.unionByName(rows).unionByName(reviewed).agg(*[F.sum(n).alias(n) for n in names])


def period_counts(corpus: Corpus) -> DataFrame:
    """Distinct funds, companies and managers per period, with the change on the prior one."""
    funds = loaded_current(corpus.source_files).groupBy("reporting_period").agg(F.count_distinct("fund_code").alias("fund_count"))
    seen = current_rows(corpus).where(F.col("entity_id").isNotNull()).select("reporting_period", "entity_id").distinct()
    linked = seen.join(corpus.entities.select("entity_id", "entity_type"), "entity_id").groupBy("reporting_period").agg(
        F.count_if(F.col("entity_type") == "company").alias("company_count"),
        F.count_if(F.col("entity_type") == "manager").alias("manager_count"),
    )
    out = funds.join(linked, "reporting_period", "left").fillna(0, ["company_count", "manager_count"])
    by_period = Window.orderBy("reporting_period")  # one row per period by now
    for c in ("fund", "company", "manager"):
        out = out.withColumn(f"{c}_note", rules.trend_note(F.col(f"{c}_count"), F.lag(f"{c}_count").over(by_period)))
    return out


def latest_prior_period(corpus: Corpus) -> DataFrame:
    return latest_periods(corpus)


# --- funds -------------------------------------------------------------------


def asset_mix(corpus: Corpus) -> DataFrame:
    """Latest-period mix of each option by class and disclosure state."""
    rows = in_latest_period(current_named(corpus), latest_periods(corpus))
    return (
        rows.groupBy("fund_code", "option_code", "reporting_period", "asset_class_code", "disclosure_completeness")
        .agg(
            F.count(F.lit(1)).alias("observation_count"),
            F.count("value_aud").alias("precise_rows"),
            _total("value_aud").alias("value_total"),
        )
        .withColumn("state_rank", rules.completeness_rank(F.col("disclosure_completeness")).cast("bigint"))
    )


def fund_exposures(corpus: Corpus, limit: int = vocab.TOP_EXPOSURE_LIMIT) -> DataFrame:
    """Top rows of each option's exposure buckets in the fund's latest period."""
    rows = in_latest_period(current_named(corpus), latest_periods(corpus))
    kinds = corpus.entities.select("entity_id", "entity_type", "confidence_tier")
    rows = rows.join(kinds, "entity_id", "left")
    kind = rules.fund_view_kind(
        F.col("entity_type"), F.col("disclosure_completeness"), F.col("ownership_pct"), F.col("source_subclass_raw"), F.col("classification_raw")
    )
    bucketed = rows.withColumn("observation_kind", kind).select(
        "fund_code",
        "option_code",
        F.explode(rules.exposure_buckets(F.col("observation_kind"), F.col("asset_class_code"), F.col("value_band_raw"))).alias("bucket"),
        "observation_kind",
        "holding_key",
        "raw_name",
        "value_aud",
        "ownership_pct",
        F.when(F.col("entity_type").isNull(), F.lit("Unresolved")).otherwise(rules.tier_label(F.col("confidence_tier"))).alias("confidence_label"),
    )
    order = rules.exposure_order(F.col("value_aud"), F.col("ownership_pct"), F.col("raw_name")) + [F.asc("holding_key")]
    return top_of_each(bucketed, ["fund_code", "option_code", "bucket"], order, limit)


# --- entities ----------------------------------------------------------------


def _explorer_rows(corpus: Corpus, states, funds, classes) -> DataFrame:
    rows = current_rows(corpus).withColumn("class_value", F.coalesce("asset_class_code", "source_asset_class_raw"))
    rows = only(rows, "disclosure_completeness", states)
    rows = only(rows, "fund_code", funds)
    return only(rows, "class_value", classes)


def entity_explorer(
    corpus: Corpus,
    entity_type: str = "all",
    states: Sequence[str] | None = None,
    funds: Sequence[str] | None = None,
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Roll-up of current rows over the three link columns; a row counts once per entity.

    Measures are summed per (entity, fund, option) first, so a much-held entity
    is spread over its slices before the last shuffle, and entity attributes
    are joined to the roll-up instead of to the rows.
    """
    if entity_type not in ("all", *vocab.ENTITY_TYPES):
        raise ValueError(f"unknown entity type {entity_type!r}")
    ids = F.array_distinct(F.array_compact(F.array("entity_id", "manager_entity_id", "issuer_entity_id")))
    rows = _explorer_rows(corpus, states, funds, classes).select(
        F.explode(ids).alias("entity_id"), "fund_code", "option_code", "value_aud", "ownership_pct", "disclosure_completeness"
    )
    mix = [s for s in vocab.COMPLETENESS_ORDER if s != "aggregate_total"]
    slices = rows.groupBy("entity_id", "fund_code", "option_code").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("value_aud").alias("value_aud"),
        F.count("ownership_pct").alias("ownership_count"),
        *[F.count_if(F.col("disclosure_completeness") == s).alias(f"{s}_count") for s in mix],
        *[F.sum(F.when(F.col("disclosure_completeness") == s, F.col("value_aud"))).alias(f"{s}_value") for s in mix[:2]],
    )
    rolled = slices.groupBy("entity_id").agg(
        F.count_distinct("fund_code").alias("fund_count"),
        F.count(F.lit(1)).alias("option_count"),
        F.sum("row_count").alias("row_count"),
        _total("value_aud").alias("total_value_aud"),
        F.sum("ownership_count").alias("ownership_count"),
        *[F.sum(f"{s}_count").alias(f"{s}_count") for s in mix],
        *[_total(f"{s}_value").alias(f"{s}_value") for s in mix[:2]],
    )
    entities = corpus.entities.select("entity_id", "entity_type", F.col("canonical_name").alias("entity_name"))
    entities = entities if entity_type == "all" else entities.where(F.col("entity_type") == entity_type)
    return rolled.join(entities, "entity_id")


def explorer_order(sort: str) -> list[Column]:
    if sort not in vocab.EXPLORER_SORTS:
        raise ValueError(f"unknown explorer sort {sort!r}")
    return [F.desc(vocab.EXPLORER_SORTS[sort]), fold(F.col("entity_name")).asc(), F.asc("entity_id")]


def entity_explorer_page(corpus: Corpus, sort: str = "value_aud_desc", number: int = 1, size: int = 50, **filters) -> DataFrame:
    return page(entity_explorer(corpus, **filters), explorer_order(sort), number, size)


def explorer_facets(corpus: Corpus) -> DataFrame:
    """Distinct filter values: funds with a current file, classes with current rows."""
    funds = loaded_current(corpus.source_files).select(
        F.lit("fund").alias("facet"), F.col("fund_code").alias("facet_value"), F.concat("fund_name", F.lit(" ("), "fund_code", F.lit(")")).alias("label")
    )
    labels = {code: label for code, label, _ in vocab.ASSET_CLASSES}
    value = F.coalesce("asset_class_code", "source_asset_class_raw")
    classes = current_rows(corpus).select(
        F.lit("asset_class").alias("facet"), value.alias("facet_value"), F.coalesce(lookup(labels, F.col("asset_class_code")), F.col("source_asset_class_raw")).alias("label")
    )
    return funds.unionByName(classes).where(F.col("facet_value") != "").groupBy("facet", "facet_value").agg(F.min("label").alias("label"))


def _named_counts(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows counted per (name, dims), whoever they are linked to."""
    return rows.groupBy("name_key", *dims).agg(F.count(F.lit(1)).alias("rows"))


def _linked_counts(rows: DataFrame, dims: Sequence[str], links: Sequence[str]) -> DataFrame:
    """Rows counted per (linked entity, name, dims); a row counts once per entity."""
    ids = F.array_distinct(F.array_compact(F.array(*links)))
    return rows.select("name_key", *dims, F.explode(ids).alias("entity_id")).groupBy("entity_id", "name_key", *dims).agg(F.count(F.lit(1)).alias("rows"))


def _typed_names(corpus: Corpus, entity_type: str | None) -> DataFrame:
    names = entity_names(corpus)
    return (names if entity_type is None else names.where(F.col("entity_type") == entity_type)).select("entity_id", "name_key")


def name_only_slices(rows: DataFrame, corpus: Corpus, dims: Sequence[str], links: Sequence[str], entity_type: str | None = None) -> DataFrame:
    """Rows that belong to an entity by name alone: all rows of its names less those of them that are linked to it.

    Links are no part of the counts that meet the entities of a name, so a hot name costs one row per
    (entity, dims), however many links its rows have.
    """
    keyed = rows.withColumn("name_key", normalise_name(F.col("raw_name")))
    names = _typed_names(corpus, entity_type)
    every = join_in_blocks(_named_counts(keyed, dims), names, ["name_key"]).select("entity_id", *dims, "rows")
    linked = _linked_counts(keyed, dims, links).join(names, ["entity_id", "name_key"], "left_semi").select("entity_id", *dims, (-F.col("rows")).alias("rows"))
    return every.unionByName(linked).groupBy("entity_id", *dims).agg(F.sum("rows").alias("rows")).where("rows > 0")


def entity_slices(corpus: Corpus, dims: Sequence[str], links: Sequence[str] = LINKS, entity_type: str | None = None) -> DataFrame:
    """Row counts per entity and dimensions: rows of its names, and rows linked to it under other names.

    Every holding counts once per entity: the link columns are de-duplicated per row, and
    linked rows of the entity's own names are in the counts of these names already.
    """
    keyed = written_once(current_named(corpus).select(normalise_name(F.col("raw_name")).alias("name_key"), *dims, *links))
    names = written_once(_typed_names(corpus, entity_type))
    named = join_in_blocks(_named_counts(keyed, dims), names, ["name_key"]).select("entity_id", *dims, "rows")
    linked = _linked_counts(keyed, dims, links).join(names, ["entity_id", "name_key"], "left_anti")
    if entity_type is not None:
        linked = linked.join(corpus.entities.where(F.col("entity_type") == entity_type).select("entity_id"), "entity_id", "left_semi")
    return named.unionByName(linked.select("entity_id", *dims, "rows"))


def entity_fund_periods(corpus: Corpus) -> DataFrame:
    """Observations per entity, fund and period, by direct link or by name."""
    return (
        entity_slices(corpus, ["fund_code", "fund_name", "reporting_period"], links=["entity_id"])
        .groupBy("entity_id", "fund_code", "fund_name", "reporting_period")
        .agg(F.sum("rows").alias("observation_count"))
    )


def cross_layout_by_entity(corpus: Corpus) -> DataFrame:
    """How widely each entity is observed across funds and file layouts."""
    return (
        entity_slices(corpus, ["fund_code", "layout_key"], links=["entity_id"])
        .groupBy("entity_id")
        .agg(
            F.sum("rows").alias("observation_count"),
            F.count_distinct("fund_code").alias("fund_count"),
            F.count_distinct("layout_key").alias("layout_count"),
        )
    )


def cross_layout_by_name(corpus: Corpus, name: str) -> DataFrame:
    """Current observations of one name across layouts."""
    if not name.strip():
        raise ValueError("name must not be blank")
    rows = corpus.observations
    rows = loaded_current(rows).where(F.col("has_name"))
    return rows.where(normalise_name(F.col("raw_name")) == normalise_name(F.lit(name)))


def company_periods(corpus: Corpus) -> DataFrame:
    """Company history: observations, funds and holder slices per period."""
    return (
        entity_slices(corpus, ["reporting_period", "fund_code", "option_code"], entity_type="company")
        .groupBy("entity_id", "reporting_period", "fund_code", "option_code")
        .agg(F.sum("rows").alias("rows"))
        .groupBy("entity_id", "reporting_period")
        .agg(
            F.sum("rows").alias("observation_count"),
            F.count_distinct("fund_code").alias("fund_count"),
            F.count(F.lit(1)).alias("holder_slices"),
        )
    )


def disclosure_summary(corpus: Corpus) -> DataFrame:
    """Observations of each entity by disclosure state, labelled and ranked."""
    return (
        entity_slices(corpus, ["disclosure_completeness"])
        .groupBy("entity_id", "disclosure_completeness")
        .agg(F.sum("rows").alias("observation_count"))
        .withColumn("label", rules.completeness_label(F.col("disclosure_completeness")))
        .withColumn("state_rank", rules.completeness_rank(F.col("disclosure_completeness")).cast("bigint"))
    )


def owner_observations(corpus: Corpus, entity_type: str) -> DataFrame:
    """Linked rows of every manager or company with the roles each row plays for it.

    A manager also plays its role through an entity link that is a roll-up; a
    company only through the manager link. `first_role` is the section a
    holding is listed under: manager before direct before issuer.
    """
    rows = current_named(corpus)
    ids = F.array_distinct(F.array_compact(F.array(*LINKS)))
    out = rows.select(
        F.explode(ids).alias("owner_id"), "holding_key", *LINKS, "fund_code", "fund_name", "option_code", "option_name", "reporting_period",
        "value_aud", "ownership_pct", "value_band_raw", "disclosure_completeness", "source_subclass_raw", "classification_raw", "raw_name", "asset_class_code",
    )
    owners = corpus.entities.where(F.col("entity_type") == entity_type).select(F.col("entity_id").alias("owner_id"), "canonical_name", rules.tier_label(F.col("confidence_tier")).alias("entity_label"))
    out = out.join(owners, "owner_id")
    owner = F.col("owner_id")
    same = lambda c: F.coalesce(F.col(c) == owner, F.lit(False))
    kind = rules.manager_view_kind(
        owner, F.col("manager_entity_id"), F.col("issuer_entity_id"), F.col("disclosure_completeness"), F.col("ownership_pct"),
        F.col("source_subclass_raw"), F.col("classification_raw"),
    )
    out = out.withColumn("observation_kind", kind)
    rollup = same("entity_id") & (F.col("observation_kind") == "manager_rollup") if entity_type == "manager" else F.lit(False)
    out = out.withColumn("is_manager_role", same("manager_entity_id") | rollup)
    out = out.withColumn("is_direct", same("entity_id")).withColumn("is_issuer", same("issuer_entity_id") | same("issuer_bridge_id"))
    first = F.when(F.col("is_manager_role"), "manager").when(F.col("is_direct"), "direct").otherwise("issuer")
    out = out.withColumn("is_non_precise", F.col("value_aud").isNull() & F.col("ownership_pct").isNull()).withColumn("is_value_band", F.col("value_band_raw").isNotNull())
    return out.withColumn("first_role", first).drop(*LINKS)


def manager_observations(corpus: Corpus) -> DataFrame:
    return owner_observations(corpus, "manager")


def with_row_confidence(observations: DataFrame, corpus: Corpus) -> DataFrame:
    """Confidence label of each listed row: its link, else how well its name is known."""
    known = entity_names(corpus).select(F.col("entity_id").alias("owner_id"), "name_key", F.lit(True).alias("is_known"))
    rows = observations.withColumn("name_key", normalise_name(F.col("raw_name"))).join(known, ["owner_id", "name_key"], "left")
    label = rules.row_confidence(F.col("is_direct"), F.coalesce("is_known", F.lit(False)), F.col("raw_name"), F.col("canonical_name"), F.col("entity_label"))
    return rows.withColumn("confidence_label", label).drop("is_known", "name_key")


def entity_detail(corpus: Corpus, entity_id: int) -> DataFrame:
    """Current rows of one entity, by any link or by name, with how each matched."""
    names = entity_names(corpus).where(F.col("entity_id") == entity_id).select(F.col("name_key").alias("own_name"))
    rows = current_named(corpus).withColumn("name_key", normalise_name(F.col("raw_name")))
    linked = F.lit(False)
    for c in LINKS:
        linked = linked | F.coalesce(F.col(c) == entity_id, F.lit(False))
    by_link = rows.where(linked).withColumn("matched_by", F.lit("link"))
    by_name = rows.where(~linked).join(names, F.col("name_key") == F.col("own_name"), "left_semi").withColumn("matched_by", F.lit("name"))
    return by_link.unionByName(by_name).drop("name_key")


def manager_role_groups(corpus: Corpus) -> DataFrame:
    """Fund totals and option totals of each manager's role rows."""
    rows = manager_observations(corpus).where(F.col("is_manager_role"))
    options = rows.groupBy("owner_id", "fund_code", "option_code").agg(F.count(F.lit(1)).alias("rows"), F.sum("value_aud").alias("value_aud"))
    return (
        options.groupingSets([["owner_id", "fund_code"], ["owner_id", "fund_code", "option_code"]], "owner_id", "fund_code", "option_code")
        .agg(
            F.sum("rows").alias("row_count"),
            _total("value_aud").alias("value_total"),
            F.when(F.grouping("option_code") == 1, "fund").otherwise("option").alias("level"),
        )
        .withColumnRenamed("owner_id", "entity_id")
    )


def manager_roles(corpus: Corpus) -> DataFrame:
    """Which roles each manager plays, and the totals of its manager role."""
    rows = manager_observations(corpus)
    manager_value = F.when(F.col("is_manager_role"), F.col("value_aud"))
    slices = rows.groupBy("owner_id", "fund_code", "option_code").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_or("is_manager_role").alias("manager"),
        F.bool_or("is_issuer").alias("issuer"),
        F.bool_or("is_direct").alias("direct"),
        F.bool_or(F.col("is_direct") & ((F.col("observation_kind") == "direct_holding") | F.col("ownership_pct").isNotNull())).alias("owner"),
        F.sum(manager_value).alias("manager_value"),
    )
    by_link = slices.select(F.col("owner_id").alias("entity_id"), "fund_code", "rows", "manager", "issuer", "direct", "owner", "manager_value")
    # rows matched by name alone are listed as direct; their kind ignores links
    kind = (F.col("ownership_pct").isNotNull() | (F.col("disclosure_completeness") == "fully_disclosed")).alias("owned")
    named = current_named(corpus).select("*", kind)
    by_name = name_only_slices(named, corpus, ["fund_code", "owned"], LINKS, "manager").select(
        "entity_id", "fund_code", "rows", F.lit(False).alias("manager"), F.lit(False).alias("issuer"), F.lit(True).alias("direct"),
        F.col("owned").alias("owner"), F.lit(None).cast("decimal(34,9)").alias("manager_value"),
    )
    flag = lambda c: F.bool_or(c).cast("int")
    return (
        by_link.unionByName(by_name)
        .groupBy("entity_id")
        .agg(
            F.sum("rows").alias("observation_count"),
            F.count_distinct("fund_code").alias("fund_count"),
            F.bool_or("manager").alias("has_manager_role"),
            F.bool_or("issuer").alias("has_issuer_role"),
            F.bool_or("owner").alias("has_ownership_role"),
            (flag("manager") + flag("direct") + flag("issuer")).cast("bigint").alias("active_role_groups"),
            F.count_distinct(F.when(F.col("manager"), F.col("fund_code"))).alias("manager_fund_count"),
            F.count_if("manager").alias("manager_option_count"),
            _total("manager_value").alias("manager_value_total"),
        )
    )


def name_sets(corpus: Corpus) -> DataFrame:
    """Names of each entity in listing order: canonical, preferred alias, alias, disclosed spelling."""
    canonical = corpus.entities.select("entity_id", F.col("canonical_name").alias("name"), F.lit(0).alias("place"))
    alias = corpus.aliases.select("entity_id", F.col("alias").alias("name"), F.when(F.col("is_preferred"), 1).otherwise(2).alias("place"))
    seen = current_named(corpus).where(F.col("entity_id").isNotNull()).select("entity_id", F.col("raw_name").alias("name"), F.lit(3).alias("place"))
    return canonical.unionByName(alias).unionByName(seen).groupBy("entity_id", "name").agg(F.min("place").cast("bigint").alias("place"))


def observations_by_name(corpus: Corpus) -> DataFrame:
    """All-version observations of every disclosed name, compared without case."""
    rows = corpus.observations.where(F.col("has_name") & ~F.col("is_aggregate"))
    states = [s for s in vocab.COMPLETENESS_ORDER if s != "aggregate_total"]
    return rows.groupBy(fold(F.col("raw_name")).alias("lookup_name")).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.max("reporting_period").alias("latest_period"),
        F.count_distinct("raw_name").alias("spellings"),
        *[F.count_if(F.col("disclosure_completeness") == s).alias(f"{s}_count") for s in states],
    )


def one_hop_edges(corpus: Corpus) -> DataFrame:
    """Every relation seen from both of its ends."""
    edges = corpus.entity_relations
    out = edges.select(F.col("from_entity_id").alias("entity_id"), F.col("to_entity_id").alias("other_id"), "relationship_type", F.lit("from").alias("side"))
    into = edges.select(F.col("to_entity_id").alias("entity_id"), F.col("from_entity_id").alias("other_id"), "relationship_type", F.lit("to").alias("side"))
    return out.unionByName(into)


def issuer_linked(corpus: Corpus) -> DataFrame:
    """Current rows that an issuer relation points at."""
    issuers = corpus.holding_relations.where(F.col("role") == "issuer").select("holding_key")
    rows = current_named(corpus).select("holding_key", "fund_code", "asset_class_code", "value_aud")
    return rows.join(issuers, "holding_key", "left_semi")


def matched_assets(corpus: Corpus, role: str = "property_asset_match") -> DataFrame:
    """Asset relations with the holding and the entity they join."""
    links = corpus.holding_relations.where(F.col("role") == role).select("holding_key", F.col("entity_id").alias("asset_entity_id"), "confidence_score")
    rows = current_named(corpus).select("holding_key", "fund_code", "option_code", "reporting_period", "asset_class_code", "disclosure_completeness", "ownership_pct")
    names = corpus.entities.select(F.col("entity_id").alias("asset_entity_id"), F.col("canonical_name").alias("asset_name"), "entity_type")
    return links.join(rows, "holding_key").join(names, "asset_entity_id")


def name_in_corpus(corpus: Corpus, name: str) -> bool:
    """Whether a name occurs in current disclosures, whole or as a part."""
    wanted = name.strip()
    if not wanted:
        return False
    lead = wanted.lower().split()[0]
    key = normalise_name(F.lit(wanted))
    rows = loaded_current(corpus.observations).where(F.col("has_name")).where(F.lower("raw_name").contains(lead))
    hit = normalise_name(F.col("raw_name")).contains(key) | fold(F.col("raw_name")).contains(fold(F.lit(wanted)))
    return not rows.where(hit).limit(1).isEmpty()


def resolution_queue(corpus: Corpus, items: DataFrame) -> DataFrame:
    """Queue items with the holding, fund, option and period they are about."""
    about = corpus.observations.select("holding_key", "source_file_id", "fund_name", "option_name", "reporting_period", "identifier_type", "identifier_value")
    own = ["holding_key", "group_kind", "group_key", "candidate_count", "top_candidate_score", "status", "raw_name"]
    # an item has the name and fund of its holding, so they do not move a second time
    joined = items.select(*own, "fund_code").join(about, "holding_key")
    return joined.select(*own, "source_file_id", "fund_code", "fund_name", "option_name", "reporting_period", "identifier_type", "identifier_value")


# --- search ------------------------------------------------------------------


def search_subjects(corpus: Corpus) -> DataFrame:
    """Everything that can be found: one row per candidate text."""
    funds = corpus.source_files.select("fund_code", "fund_name").distinct()
    nothing = F.lit(None).cast("bigint")
    by_fund = [
        funds.select(
            F.lit("fund").alias("kind"), F.col("fund_name").alias("title"), nothing.alias("entity_id"), "fund_code",
            F.lit(source).alias("matched_on"), F.col(source).alias("candidate"), F.lit(place).alias("place"),
        )
        for place, source in enumerate(("fund_code", "fund_name"))
    ]
    entities = corpus.entities.where(F.col("entity_type").isin("company", "manager"))
    heads = entities.select(F.col("entity_type").alias("kind"), F.col("canonical_name").alias("title"), "entity_id", F.lit(None).cast("string").alias("fund_code"))
    canonical = heads.select("*", F.lit("canonical_name").alias("matched_on"), F.col("title").alias("candidate"), F.lit(0).alias("place"))
    alias = corpus.aliases.select("entity_id", F.col("alias").alias("candidate"), F.when(F.col("is_preferred"), 1).otherwise(2).alias("place"))
    aliased = heads.join(alias, "entity_id").select("kind", "title", "entity_id", "fund_code", F.lit("alias").alias("matched_on"), "candidate", "place")
    out = by_fund[0].unionByName(by_fund[1])
    return out.unionByName(canonical).unionByName(aliased)


def search_matches(corpus: Corpus, query: str) -> DataFrame:
    """Best match of every subject that matches at all."""
    text = query.strip()
    if not text:
        raise ValueError("query must not be blank")
    folded, key = text.casefold(), " ".join(text.casefold().split())
    priority = lookup(vocab.SEARCH_PRIORITY, F.col("matched_on"))
    scored = search_subjects(corpus).withColumn("score", rules.search_score(priority, F.col("candidate"), folded, key))
    scored = scored.where(F.col("score").isNotNull())
    best = F.min_by(F.struct("score", "matched_on", F.col("candidate").alias("matched_value")), F.struct(-F.col("score"), "place", "candidate"))
    return scored.groupBy("kind", "title", "entity_id", "fund_code").agg(best.alias("best")).select("kind", "title", "entity_id", "fund_code", "best.*")


def search(corpus: Corpus, query: str, limit: int = 20, kind: str = "all") -> DataFrame:
    if kind not in ("all", *vocab.SEARCH_KIND_ORDER):
        raise ValueError(f"unknown search kind {kind!r}")
    found = search_matches(corpus, query)
    found = found if kind == "all" else found.where(F.col("kind") == kind)
    order = [F.desc("score"), lookup(vocab.SEARCH_KIND_ORDER, F.col("kind")).asc(), fold(F.col("title")).asc(), fold(F.col("matched_value")).asc(), F.asc_nulls_first("entity_id")]
    return found.orderBy(*order).limit(limit)


def search_facets(corpus: Corpus, query: str) -> DataFrame:
    """Match counts per kind, with a row for all kinds."""
    counts = search_matches(corpus, query).groupBy("kind").agg(F.count(F.lit(1)).alias("result_count"))
    total = counts.agg(F.lit("all").alias("kind"), F.coalesce(F.sum("result_count"), F.lit(0)).alias("result_count"))
    return counts.unionByName(total)
