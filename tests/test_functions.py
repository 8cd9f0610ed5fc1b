"""Scalar rules on the cases SQL engines disagree about."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from holdwright.functions import identity, numbers, rules, text


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_normalise_name(spark):
    got = values(spark, ["  Big  Bank LTD ", "Straße", "ΟΔΟΣ", "\x1fA\x1cB", None], text.normalise_name)
    assert got == ["big bank ltd", "strasse", "οδοσ", "a b", None]


def test_clean(spark):
    assert values(spark, ["  a b　\n", "", "﻿x"], text.clean) == ["a b", "", "﻿x"]
    assert values(spark, ["﻿x"], text.strip_bom) == ["x"]
    assert values(spark, ["a b "], text.clean_nbsp) == ["a b"]


def test_slugs_and_scopes(spark):
    assert values(spark, ["High & Low (Tide)!"], lambda c: text.slug(c, "P_")) == ["P_HIGH_LOW_TIDE"]
    assert values(spark, ["Held directly, by 2 trusts."], lambda c: text.scope_code(c, {})) == ["held_directly_by_2_trusts"]


@pytest.mark.parametrize(
    ("style", "raw", "value", "failed"),
    [
        (numbers.NumberStyle(("",), commas=False), "3.1e-06", Decimal("0.0000031").quantize(Decimal("0.000000001")), False),
        (numbers.NumberStyle(("",), commas=False), "7,300", None, True),
        (numbers.NumberStyle(("", "-"), dollar="required"), "-$8,052.75", Decimal("-8052.75"), False),
        (numbers.NumberStyle(("", "-"), dollar="required"), "8,052.75", None, True),
        (numbers.NumberStyle(("", "-"), dollar="optional", inner_spaces=True), "  - 6 071.25", Decimal("-6071.25"), False),
        (numbers.NumberStyle(("", "n/a", "nan"), parentheses=True), "(5,608)", Decimal("-5608"), False),
        (numbers.NumberStyle(("", "n/a", "nan"), parentheses=True), "(5,608", None, True),
        (numbers.NumberStyle(("", "n/a", "nan")), "NaN", None, False),
        (numbers.NumberStyle(("",)), "-", None, True),
    ],
)
def test_numbers(spark, style, raw, value, failed):
    parsed = numbers.parse_number(F.lit(raw), style)
    got = spark.range(1).select(parsed.value, parsed.failed).first()
    assert (got[0], got[1]) == (value, failed)


@pytest.mark.parametrize(
    ("style", "raw", "value", "failed"),
    [
        (numbers.PercentStyle(("",), low=0, high=1), "62.50%", Decimal("0.625"), False),
        (numbers.PercentStyle(("",), low=0, high=1), "175%", Decimal("1.75"), True),
        (numbers.PercentStyle(("",)), "85", None, True),
        (numbers.PercentStyle(("", "-"), plus=True), "+3.5%", Decimal("0.035"), False),
        (numbers.PercentStyle(("",), sign="optional"), "1.5 %", Decimal("0.015"), False),
        (numbers.PercentStyle(("",), sign="points", low=-1, high=1), "12.62", Decimal("0.1262"), False),
        (numbers.PercentStyle(("",), sign="points", low=-1, high=1), "-101", Decimal("-1.01"), True),
        (numbers.PercentStyle(("",), sign="fraction"), "0.18", Decimal("0.18"), False),
    ],
)
def test_percents(spark, style, raw, value, failed):
    parsed = numbers.parse_percent(F.lit(raw), style)
    got = spark.range(1).select(parsed.value, parsed.failed).first()
    assert (got[0], got[1]) == (value, failed)


def test_dates(spark):
    assert [str(v) for v in values(spark, ["31/12/2025", "2025-12-31", "31 December 2025", "12/31/2025", "1/2/25"], numbers.parse_any_date)] == ["2025-12-31"] * 3 + ["None"] * 2


def test_money_labels_round_half_even(spark):
    got = [r[0] for r in spark.sql("SELECT * FROM VALUES (12450.0), (12350.0), (0.5), (1.5), (-2500000000.0), (0.0), (NULL) AS t(x)").select(numbers.money_label(F.col("x").cast("decimal(24,9)"))).collect()]
    assert got == ["$12.4k", "$12.4k", "$0", "$2", "-$2.5b", "$0", "—"]


def test_tiers(spark):
    assert values(spark, ["seeded", " HIGH ", "very_sure", "", None], rules.tier_label) == ["Reviewed", "High Confidence", "Very Sure", "Linked", "Linked"]


def test_identity_needs_one_side(spark):
    def fund(url, *options):
        names = F.array(*[F.lit(o) for o in options]) if options else F.array().cast("array<string>")
        return tuple(spark.range(1).select(identity.identity(F.lit(url), names).alias("i")).select("i.fund_code", "i.confidence").first())

    assert fund("https://www.australiansuper.com/files/x.csv") == ("australiansuper", "high")
    assert fund("x.csv", "ART Tide") == ("art", "medium")
    assert fund("https://www.australiansuper.com/x.csv", "ART Tide") == (None, "conflicted")
    assert fund("x.csv") == (None, "unknown")


def test_known_fingerprint_of_the_schedule_layout(spark):
    """The digest of a known profile, computed the way profiles are hashed."""
    from holdwright.plans import ingest

    row = ("schedule14", "d", ["CASH", "FIXED INCOME", "FIXED INCOME (PRIVATE DEBT)", "LISTED EQUITY", "TOTAL INVESTMENT ITEMS", "UNLISTED EQUITY", "UNLISTED PROPERTY"],
           ["EXTERNALLY", "INTERNALLY"], ["ASSETS", "DERIVATIVES", "DERIVATIVES BY ASSET CLASS", "DERIVATIVES BY CURRENCY"], ["1", "2", "3", "4"], [], [], [], [], [])
    a = "array<string>"
    df = spark.createDataFrame([row], f"layout_key string, first_line_digest string, p_asset_classes {a}, p_internal_external {a}, p_section_labels {a}, p_tables {a}, p_filters {a}, p_name_types {a}, p_option_names {a}, p_option_codes {a}, p_header_rows {a}")
    assert df.select(ingest._fingerprint()).first()[0] == "0221ce01b8fb64d5b1ef06efaf5b70d8ffaf35cb2e0e163c5c0f4a54b4523139"


def test_small_governance_helpers(spark):
    from holdwright.operators import governance, seeds

    row = spark.range(1).select(
        F.concat_ws(",", governance.missing_keys(["a", "b", "c"], F.array(F.lit("b")))), seeds.register_url(F.lit("123 456 789"), "https://register.example/?acn=")
    ).first()
    assert tuple(row) == ("a,c", "https://register.example/?acn=123456789")
    stored = spark.createDataFrame([("v1",)], "mapping_version_id string")
    approved = spark.createDataFrame([("v1", 1), ("v2", 2)], "mapping_version_id string, n int")
    assert [r.mapping_version_id for r in governance.seed_versions(stored, approved).collect()] == ["v2"]


def test_payload_shapes(spark):
    from holdwright.functions.payload import tagged_entries

    shapes = ['["a","b"]', '[["a"],["b"],["c"]]', '[{"source_row_number":4,"payload":["a"]},{"payload":["b"]}]', "[]", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, s string")
    got = [[(e.source_row_number, e.payload) for e in r[0]] for r in df.orderBy("i").select(tagged_entries(F.col("s"), F.lit(2), F.array(F.lit(9)))).collect()]
    assert got == [[(2, ["a", "b"])], [(2, ["a"]), (9, ["b"]), (2, ["c"])], [(4, ["a"]), (2, ["b"])], [], []]


def test_intermediate_tables_go_to_the_named_folder(spark):
    from holdwright.session import checkpoint_dir, written_once

    table = written_once(spark.range(5))
    assert table.count() == 5
    folder = checkpoint_dir(spark).removeprefix("file:")
    assert all(f.removeprefix("file://").startswith(f"{folder}/table-") for f in table.inputFiles())
