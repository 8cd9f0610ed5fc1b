"""Text cleaning and normalisation as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separators Python also strips.
_SPACE = r"[\s\x1c-\x1f]"
WHITE = " \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NBSP = "\u00a0"
REPLACEMENT = "\ufffd"


def clean(c: Column) -> Column:
    """Strip white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def clean_nbsp(c: Column) -> Column:
    return clean(F.replace(c, F.lit(NBSP), F.lit(" ")))


def fold(c: Column) -> Column:
    """Case-insensitive form: lower case, sharp s and final sigma folded."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space, ends stripped."""
    return F.trim(F.regexp_replace(c, rf"(?U){_SPACE}+", " "))


def normalise_name(c: Column) -> Column:
    return fold(collapse(c))


def optional_text(c: Column, null_tokens: Iterable[str]) -> Column:
    """NULL for the layout's null tokens (compared without case), else the clean text."""
    cleaned = clean(c)
    return F.when(~F.lower(cleaned).isin(*null_tokens), cleaned)


def is_forbidden_token(c: Column, tokens: Iterable[str]) -> Column:
    return F.lower(clean(c)).isin(*tokens)


def slug(c: Column, prefix: str = "") -> Column:
    """Upper-case code with every other run of characters turned into `_`."""
    return F.concat(F.lit(prefix), F.btrim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), F.lit("_")))


def lower_slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), F.lit("_"))


def scope_code(c: Column, approved: Mapping[str, str]) -> Column:
    """Canonical scope phrase, or a slug for one nobody has approved."""
    return F.coalesce(lookup(approved, c), lower_slug(c))


def lookup(mapping: Mapping, key: Column) -> Column:
    """Literal dictionary as an expression; unknown keys give NULL.

    The dictionary is one constant-folded map literal: no join, and a plan that
    does not grow with the number of entries.
    """
    kind = "string" if all(isinstance(v, str) for v in mapping.values()) else "boolean" if all(isinstance(v, bool) for v in mapping.values()) else "int"
    table = F.from_json(F.lit(json.dumps(dict(mapping), ensure_ascii=False)), f"map<string,{kind}>")
    return F.try_element_at(table, key)


def title_words(c: Column) -> Column:
    """`some_code` to `Some Code`."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def tidy_optional(c: Column) -> Column:
    return blank_to_null(clean(c))


def replacement_count(c: Column) -> Column:
    """How many bytes were replaced while decoding."""
    return F.length(c) - F.length(F.replace(c, F.lit(REPLACEMENT), F.lit("")))


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^\\uFEFF", "")
