"""Disclosure rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions.text import fold, lookup, normalise_name, title_words


def completeness(
    rule: str,
    *,
    aggregate: Column,
    value: Column,
    ownership: Column,
    units: Column | None = None,
    identifier: Column | None = None,
    name: Column | None = None,
    band: Column | None = None,
    address: Column | None = None,
    classification: Column | None = None,
    latitude: Column | None = None,
    weighting: Column | None = None,
    managed: Column | None = None,
    value_only_block: Column | None = None,
) -> Column:
    """Disclosure state of a row under one of five rule sets.

    flat        value with ownership, identifier or units is full
    banded      flat, but a band without value is name-only, and address or
                classification also make a value full
    shared      banded, but managed rows with a value are value-only
    weighted    value is full only with a weighting and an identifier or units
    block       value is full only with ownership, outside value-only tables
    """
    no = F.lit(False)
    has = lambda c: no if c is None else c.isNotNull()
    v, o, u, i, b = has(value), has(ownership), has(units), has(identifier), has(band)
    out = F.when(aggregate, F.lit("aggregate_total"))
    if rule in ("banded", "shared"):
        out = out.when(b & ~v, F.lit("name_only"))
    if rule == "shared":
        out = out.when(v & managed, F.lit("value_only"))
    if rule == "flat":
        full = v & (o | i | u)
    elif rule == "banded":
        full = v & (o | i | u | has(address) | has(classification))
    elif rule == "shared":
        full = v & (o | i | u | has(address) | has(classification) | has(latitude))
    elif rule == "weighted":
        full = v & has(weighting) & (i | u)
    elif rule == "block":
        full = v & o & ~(no if value_only_block is None else value_only_block)
    else:
        raise ValueError(f"unknown completeness rule {rule!r}")
    named = F.lit(True) if name is None or rule in ("banded", "shared", "block") else name.isNotNull()
    return (
        out.when(full, F.lit("fully_disclosed"))
        .when(v, F.lit("value_only"))
        .when(o, F.lit("ownership_only"))
        .when(named, F.lit("name_only"))
    )


def quality_flags(value: Column, ownership: Column, weighting: Column) -> Column:
    """Flags for odd but accepted rows."""
    return F.array_compact(
        F.array(
            F.when(weighting.isNotNull() & value.isNull(), F.lit("weighting_without_value")),
            F.when(ownership == 0, F.lit("zero_ownership_pct")),
            F.when(value < 0, F.lit("negative_value_aud")),
        )
    )


def out_of_range(fraction: Column, low: int, high: int) -> Column:
    return F.coalesce((fraction < low) | (fraction > high), F.lit(False))


def _mentions_manager(classification: Column) -> Column:
    return F.coalesce(fold(classification).contains("manager"), F.lit(False))


def _subclass_is(subclass: Column, text: str) -> Column:
    return F.coalesce(normalise_name(subclass) == text, F.lit(False))


def holding_scope(
    manager_entity: Column, issuer_entity: Column, ownership: Column, subclass: Column, classification: Column
) -> Column:
    """Entity type a holding can only mean, or NULL when it may mean any."""
    words = F.split(normalise_name(classification), " ")
    return (
        F.when(manager_entity.isNotNull(), F.lit("manager"))
        .when(issuer_entity.isNotNull(), F.lit("company"))
        .when(ownership.isNotNull(), F.lit(None).cast("string"))
        .when(_subclass_is(subclass, "externally managed"), F.lit("manager"))
        .when(_subclass_is(subclass, "internally managed"), F.lit("company"))
        .when(F.coalesce(F.array_contains(words, "manager"), F.lit(False)), F.lit("manager"))
    )


def manager_view_kind(
    entity: Column,
    manager_entity: Column,
    issuer_entity: Column,
    state: Column,
    ownership: Column,
    subclass: Column,
    classification: Column,
) -> Column:
    """What an observation is from the point of view of one entity."""
    same = lambda c: F.coalesce(c == entity, F.lit(False))
    return (
        F.when(same(manager_entity), F.lit("manager_rollup"))
        .when(same(issuer_entity), F.lit("direct_holding"))
        .when(ownership.isNotNull() | (state == "fully_disclosed"), F.lit("direct_holding"))
        .when(_subclass_is(subclass, "externally managed"), F.lit("manager_rollup"))
        .when(_mentions_manager(classification), F.lit("manager_rollup"))
        .otherwise(F.lit("unknown"))
    )


def fund_view_kind(
    entity_type: Column, state: Column, ownership: Column, subclass: Column, classification: Column
) -> Column:
    """What an observation is from the point of view of the disclosing fund."""
    return (
        F.when(ownership.isNotNull() | (state == "fully_disclosed"), F.lit("direct_holding"))
        .when(F.coalesce(entity_type == "manager", F.lit(False)), F.lit("manager_rollup"))
        .when(_mentions_manager(classification), F.lit("manager_rollup"))
        .when((state == "value_only") & _subclass_is(subclass, "externally managed"), F.lit("manager_rollup"))
        .otherwise(F.lit("unknown"))
    )


def exposure_buckets(kind: Column, asset_class: Column, band: Column) -> Column:
    """Every fund-page bucket an observation belongs to."""
    private = asset_class.isin(*vocab.PRIVATE_CLASSES)
    unknown = private & (kind == "unknown")
    return F.array_compact(
        F.array(
            F.when(private & (kind == "direct_holding"), F.lit("top_direct_private")),
            F.when(kind == "manager_rollup", F.lit("manager_level")),
            F.when(unknown, F.lit("named_private")),
            F.when(unknown & band.isNotNull(), F.lit("value_band")),
            F.when(unknown & band.isNull(), F.lit("other_named_private")),
        )
    )


def exposure_order(value: Column, ownership: Column, name: Column) -> list[Column]:
    """Rank order inside a bucket: larger disclosed measures first, then name."""
    zero = F.lit(0)
    return [
        F.when(value.isNotNull(), 0).otherwise(1).asc(),
        F.coalesce(value, zero).desc(),
        F.when(ownership.isNotNull(), 0).otherwise(1).asc(),
        F.coalesce(ownership, zero).desc(),
        fold(name).asc(),
    ]


def completeness_rank(state: Column) -> Column:
    return F.coalesce(lookup(vocab.COMPLETENESS_ORDER, state), F.lit(vocab.UNKNOWN_ORDER))


def completeness_label(state: Column) -> Column:
    return F.coalesce(lookup(vocab.COMPLETENESS_LABELS, state), title_words(state))


def tier_label(tier: Column) -> Column:
    """Entity confidence label of a stored tier."""
    key = fold(F.trim(tier))
    return (
        F.when(tier.isNull() | (key == ""), F.lit("Linked"))
        .otherwise(F.coalesce(lookup(vocab.TIER_LABELS, key), title_words(tier)))
    )


def row_confidence(linked: Column, alias_known: Column, raw_name: Column, canonical: Column, entity_label: Column) -> Column:
    return (
        F.when(linked, entity_label)
        .when(alias_known & (raw_name != canonical), F.lit("Observed Alias"))
        .when(alias_known, F.lit("Linked"))
        .otherwise(F.lit("Unresolved"))
    )


def trend_note(current: Column, prior: Column) -> Column:
    delta = current - prior
    return (
        F.when(prior.isNull(), F.lit("No prior loaded period yet"))
        .when(delta > 0, F.concat(F.lit("Up "), delta.cast("string"), F.lit(" vs prior")))
        .when(delta < 0, F.concat(F.lit("Down "), (-delta).cast("string"), F.lit(" vs prior")))
        .otherwise(F.lit("Flat vs prior"))
    )


def search_score(source_priority: Column, value: Column, query: str, query_normalised: str) -> Column:
    """Rank of one candidate text for a query; NULL when it does not match."""
    text = fold(F.trim(value))
    norm = normalise_name(value)
    s = vocab.SEARCH_STRENGTH
    strength = (
        F.when(norm == "", F.lit(None).cast("int"))
        .when(norm == query_normalised, s["equal_normalised"])
        .when(text == query, s["equal"])
        .when(norm.startswith(query_normalised), s["prefix_normalised"])
        .when(text.startswith(query), s["prefix"])
        .when(norm.contains(query_normalised), s["contains_normalised"])
        .when(text.contains(query), s["contains"])
    )
    return source_priority + strength


def expired(expires_at: Column, now: Column) -> Column:
    return F.coalesce(expires_at <= now, F.lit(False))


def variant_shape(asset_class: Column, qualifier: Column, sub_qualifier: Column) -> Column:
    """(class, qualifier, canonical code, style) of the class/filter/sub-filter layout.

    Listed and unlisted rows of the four split classes follow one pattern, so
    the rule is built per class; unknown combinations give NULL.
    """
    managed = ("internally managed", "externally managed")
    style = F.coalesce(
        F.when(fold(sub_qualifier).isin(*managed), sub_qualifier),
        F.when(fold(qualifier).isin(*managed), qualifier),
    )
    nothing = F.lit(None).cast("string")

    def shape(name, qual, code, mgmt=nothing) -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            as_col(name).alias("asset_class"),
            as_col(qual).alias("qualifier"),
            as_col(code).alias("code"),
            mgmt.alias("style"),
        )

    or_else = lambda c, text: F.when(c != "", c).otherwise(F.lit(text))
    debt = "Fixed Income Private Debt"
    out = (
        F.when(asset_class == "Cash", shape("Cash", "All Assets", "cash"))
        .when((asset_class == "Fixed Income") & (sub_qualifier == debt), shape("Private Debt", debt, "private_debt", style))
        .when(asset_class == "Fixed Income", shape("Fixed Income", or_else(qualifier, "All Assets"), "fixed_income", style))
        .when(
            (asset_class == "Equity") & (qualifier == "Unlisted") & (sub_qualifier == "Private Equity"),
            shape("Private Equity", "Private Equity", "unlisted_equity"),
        )
    )
    for name, stem in (("Equity", "equity"), ("Infrastructure", "infrastructure"), ("Property", "property"), ("Alternatives", None)):
        listed, unlisted = (f"listed_{stem}", f"unlisted_{stem}") if stem else ("alternatives", "alternatives")
        is_class = asset_class == name
        out = out.when(is_class & (qualifier == "Listed"), shape(f"Listed {name}", "Listed", listed))
        out = out.when(
            is_class & (qualifier == "Unlisted"),
            shape(f"Unlisted {name}", or_else(sub_qualifier, "Unlisted"), unlisted, style),
        )
    return out
