"""Fixed values shared by every job: codes, labels, orders and decimal types."""

from __future__ import annotations

# Decimal types of the stored measures.
MONEY = "decimal(24,9)"
FRACTION = "decimal(18,9)"
UNITS = "decimal(30,12)"
GEO = "decimal(12,8)"
TOTAL = "decimal(38,9)"

# Disclosure states in display order, with their labels.
COMPLETENESS_ORDER = {
    "fully_disclosed": 0,
    "value_only": 1,
    "ownership_only": 2,
    "name_only": 3,
    "aggregate_total": 4,
}
COMPLETENESS_LABELS = {
    "fully_disclosed": "Direct",
    "value_only": "Value only",
    "ownership_only": "Ownership only",
    "name_only": "Name only",
    "aggregate_total": "Section total",
}
UNKNOWN_ORDER = 999

# Canonical asset classes: code, label, parent.
ASSET_CLASSES = [
    ("listed_equity", "Listed Equity", None),
    ("unlisted_equity", "Unlisted Equity", None),
    ("listed_property", "Listed Property", None),
    ("unlisted_property", "Unlisted Property", None),
    ("listed_infrastructure", "Listed Infrastructure", None),
    ("unlisted_infrastructure", "Unlisted Infrastructure", None),
    ("fixed_income", "Fixed Income", None),
    ("private_debt", "Private Debt", "fixed_income"),
    ("cash", "Cash", None),
    ("derivatives", "Derivatives", None),
    ("alternatives", "Alternatives", None),
    ("multi_asset_other", "Multi-Asset / Other", None),
]
PRIVATE_CLASSES = ["private_debt", "unlisted_equity", "unlisted_infrastructure", "unlisted_property"]

# Identifier registry types; only these resolve a holding besides ABN.
REGISTRY_TYPES = ["ASX", "ISIN", "CUSIP", "LEI"]
ABN_TYPE = "ABN"

# Search: subject kinds in rank order, match-source priority, match strength.
SEARCH_KIND_ORDER = {"fund": 0, "company": 1, "manager": 2}
SEARCH_PRIORITY = {"fund_code": 240, "canonical_name": 200, "fund_name": 180, "alias": 160}
SEARCH_STRENGTH = {
    "equal_normalised": 400,
    "equal": 380,
    "prefix_normalised": 300,
    "prefix": 280,
    "contains_normalised": 200,
    "contains": 180,
}

# Explorer sort keys and the column each one ranks by.
EXPLORER_SORTS = {
    "value_aud_desc": "total_value_aud",
    "fund_count_desc": "fund_count",
    "option_count_desc": "option_count",
    "row_count_desc": "row_count",
    "ownership_count_desc": "ownership_count",
}
ENTITY_TYPES = ["company", "manager", "asset", "fund_vehicle", "property_asset", "infrastructure_asset"]

# Entity confidence tiers with a label of their own.
TIER_LABELS = {
    "seeded": "Reviewed",
    "high": "High Confidence",
    "medium": "Medium Confidence",
    "low": "Low Confidence",
}

# Override actions and queue scores.
OVERRIDE_ACTIONS = ["force_match", "force_no_match", "force_new_entity", "redirect_to_parent"]
IDENTIFIER_SCORE = "1.00000"
NAME_SCORE = "0.97000"

# Scope phrases of the block layouts and their canonical form.
SCOPE_PHRASES = {
    "Held directly or by associated entities or by PSTs": "held_direct_or_associated_or_psts",
    "Held directly or by associated entity or by PSTs": "held_direct_or_associated_or_psts",
    "Held directly or by associated entities or PSTs": "held_direct_or_associated_or_psts",
}

DISCLOSURE_DUE_DAYS = 90
SAMPLE_ROW_LIMIT = 20
TAXONOMY_REPORT_LIMIT = 10
TOP_EXPOSURE_LIMIT = 10
