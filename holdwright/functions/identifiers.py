"""Security-identifier and business-number expressions, and row hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions.text import clean, collapse

# Identifier shapes.
ISIN = r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
ASX_WITH_SUFFIX = r"^[A-Z0-9]{2,6}\s+AU$"
SEDOL = r"^[A-Z0-9]{7}$"
TWELVE = r"^[A-Z0-9]{12}$"

IDENTIFIER_RULES = {
    "isin": [(ISIN, "ISIN")],
    "isin_asx": [(ISIN, "ISIN"), (ASX_WITH_SUFFIX, "ASX_CODE")],
    "isin_sedol": [(ISIN, "ISIN"), (SEDOL, "SEDOL")],
    "twelve": [(TWELVE, "ISIN")],
}


def identifier_type(value: Column, rule: str) -> Column:
    """Type of a non-empty identifier by shape; UNKNOWN when no shape fits."""
    text = clean(value)
    out = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for shape, name in IDENTIFIER_RULES[rule]:
        out = out.when(text.rlike(shape), F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))


def business_number(value: Column) -> Column:
    """Digits only; NULL unless there are exactly eleven."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) == 11, digits)


def registry_type(value: Column) -> Column:
    text = F.upper(collapse(value))
    return F.when(text == "ASX_CODE", F.lit("ASX")).when(text != "", text)


def registry_value(kind: Column, value: Column) -> Column:
    """Registry form: no white space, upper case; ABN reduced to its digits."""
    packed = F.upper(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", ""))
    return F.when(kind == vocab.ABN_TYPE, business_number(packed)).when(packed != "", packed)


def json_digest(value: Column) -> Column:
    """SHA-256 of the compact JSON of a value; the provenance hash of a row."""
    return F.sha2(F.to_json(value), 256)


def stable_id(*parts: Column) -> Column:
    """Positive BIGINT key derived from the parts, the same on every run."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
