"""Registered queries: library jobs bound to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright.plans import read_models as rm
from holdwright.plans import registered_functions, registered_governance, registered_ingest, registered_layouts, registered_links, registered_loads, registered_resolution
from holdwright.plans.binding import DriverTables

Query = Callable[[SparkSession, str], DataFrame]
SEARCH_TEXT = "large r"


def _on_corpus(job) -> Query:
    return lambda spark, sf: job(DriverTables(spark, sf).corpus)


def _longs(df: DataFrame) -> DataFrame:
    """Integer results as BIGINT, so both engines show one type."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _owner_rows(corpus, entity_type: str) -> DataFrame:
    rows = rm.with_row_confidence(rm.owner_observations(corpus, entity_type), corpus)
    return rows.select("owner_id", "holding_key", "observation_kind", "is_manager_role", "is_direct", "is_issuer", "first_role", "is_non_precise", "is_value_band", "confidence_label")


READ_MODELS: dict[str, Query] = {
    "asset_mix_by_disclosure": _on_corpus(rm.asset_mix),
    "file_list_counts": _on_corpus(rm.file_list),
    "file_profile": _on_corpus(rm.file_profile),
    "file_page": _on_corpus(lambda c: _longs(rm.file_page(c, 2, 3))),
    "corpus_stats": _on_corpus(rm.corpus_stats),
    "period_counts_trend": _on_corpus(rm.period_counts),
    "latest_prior_period": _on_corpus(rm.latest_prior_period),
    "fund_top10_buckets": _on_corpus(lambda c: _longs(rm.fund_exposures(c))),
    "entity_explorer": _on_corpus(rm.entity_explorer),
    "entity_explorer_page": _on_corpus(lambda c: rm.entity_explorer_page(c, "fund_count_desc", 2, 50)),
    "entity_explorer_filtered": _on_corpus(
        lambda c: rm.entity_explorer(c, "company", ["fully_disclosed", "value_only"], ["NATION_1", "NATION_2", " NATION_1 "], ["listed_equity", "fixed_income"])
    ),
    "explorer_facets": _on_corpus(rm.explorer_facets),
    "entity_fund_period_counts": _on_corpus(rm.entity_fund_periods),
    "company_period_history": _on_corpus(rm.company_periods),
    "disclosure_summary": _on_corpus(rm.disclosure_summary),
    "manager_observations": _on_corpus(lambda c: _owner_rows(c, "manager")),
    "company_observations": _on_corpus(lambda c: _owner_rows(c, "company")),
    "manager_role_groups": _on_corpus(rm.manager_role_groups),
    "role_classes": _on_corpus(rm.manager_roles),
    "name_sets": _on_corpus(rm.name_sets),
    "observations_by_name": _on_corpus(rm.observations_by_name),
    "cross_layout_by_entity": _on_corpus(rm.cross_layout_by_entity),
    "one_hop_edges": _on_corpus(rm.one_hop_edges),
    "issuer_semi": _on_corpus(rm.issuer_linked),
    "matched_assets": _on_corpus(rm.matched_assets),
    "search_ranked": _on_corpus(lambda c: _longs(rm.search(c, SEARCH_TEXT))),
    "search_facets": _on_corpus(lambda c: rm.search_facets(c, SEARCH_TEXT)),
}


def all_queries() -> dict[str, Query]:
    return {**READ_MODELS, **registered_resolution.QUERIES, **registered_links.QUERIES, **registered_loads.QUERIES, **registered_layouts.QUERIES, **registered_governance.QUERIES, **registered_functions.QUERIES, **registered_ingest.QUERIES}
