"""Money, number, percent and date parsing. Bad input gives NULL, never an error.

Each parser also says whether a non-empty input failed, so callers can turn
failures into issue rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions.text import clean, optional_text

_WIDE = "decimal(28,16)"


@dataclass(frozen=True)
class Parsed:
    """A parse in three steps: clean text, its value, whether it failed.

    `value` and `failed` spell the steps out in one expression. Callers with a
    DataFrame at hand name each step as a column instead, so no step runs twice.
    """

    text: Column
    to_value: Callable[[Column], Column]
    to_failed: Callable[[Column, Column], Column]

    @property
    def value(self) -> Column:
        return self.to_value(self.text)

    @property
    def failed(self) -> Column:
        return self.to_failed(self.text, self.value)


@dataclass(frozen=True)
class Named:
    """A parse whose steps are columns already."""

    value: Column
    failed: Column


def add_parsed(df: DataFrame, parses: Mapping[str, Parsed]) -> tuple[DataFrame, dict[str, Named]]:
    """Columns <name>_text, <name> and <name>_failed of several parses."""
    out = df.withColumns({f"{n}_text": p.text for n, p in parses.items()})
    out = out.withColumns({n: p.to_value(F.col(f"{n}_text")) for n, p in parses.items()})
    out = out.withColumns({f"{n}_failed": p.to_failed(F.col(f"{n}_text"), F.col(n)) for n, p in parses.items()})
    return out, {n: Named(F.col(n), F.col(f"{n}_failed")) for n in parses}


@dataclass(frozen=True)
class NumberStyle:
    """How one layout writes numbers."""

    null_tokens: tuple[str, ...] = ("",)
    commas: bool = True          # thousands separators are removed
    dollar: str = "none"         # none | required | optional
    parentheses: bool = False    # (x) means -x
    inner_spaces: bool = False   # spaces inside the number are removed


@dataclass(frozen=True)
class PercentStyle:
    """How one layout writes percentages; the result is a fraction."""

    null_tokens: tuple[str, ...] = ("",)
    sign: str = "required"       # required | optional | points | fraction
    commas: bool = True
    inner_spaces: bool = False
    plus: bool = False           # a leading + is allowed
    low: int | None = None
    high: int | None = None


def _digits(text: Column, commas: bool, spaces: bool) -> Column:
    if commas and spaces:
        return F.translate(text, ", ", "")
    if commas or spaces:
        return F.translate(text, "," if commas else " ", "")
    return text


def _after(text: Column, n: int) -> Column:
    return F.substr(text, F.lit(n + 1))


def parse_number(c: Column, style: NumberStyle, to: str = vocab.MONEY) -> Parsed:
    def value(present: Column) -> Column:
        text = _digits(present, style.commas, style.inner_spaces)
        if style.dollar != "none":
            bare = F.when(text.startswith("$"), _after(text, 1)).when(text.startswith("-$"), F.concat(F.lit("-"), _after(text, 2)))
            text = bare.otherwise(text) if style.dollar == "optional" else bare
        if style.parentheses:
            inside = text.startswith("(") & text.endswith(")")
            number = F.translate(text, "()", "").try_cast(to)
            return F.when(inside, -number).when(~text.startswith("("), text.try_cast(to)).try_cast(to)
        return text.try_cast(to)

    return Parsed(optional_text(c, style.null_tokens), value, lambda text, number: text.isNotNull() & number.isNull())


def parse_percent(c: Column, style: PercentStyle, to: str = vocab.FRACTION) -> Parsed:
    def value(present: Column) -> Column:
        text = present
        marked = text.endswith("%")
        bare = F.substr(text, F.lit(1), F.length(text) - 1)
        if style.sign == "required":
            text = F.when(marked, bare)
        elif style.sign == "optional":
            text = F.when(marked, F.rtrim(bare)).otherwise(text)
        text = _digits(text, style.commas, style.inner_spaces)
        if style.plus:
            text = F.when(text.startswith("+"), _after(text, 1)).otherwise(text)
        number = text.try_cast(_WIDE)
        return (number if style.sign == "fraction" else number / F.lit(100)).try_cast(to)

    def failed(text: Column, fraction: Column) -> Column:
        bad = text.isNotNull() & fraction.isNull()
        for limit, beyond in ((style.low, lambda x: x < style.low), (style.high, lambda x: x > style.high)):
            if limit is not None:
                bad = bad | F.coalesce(beyond(fraction), F.lit(False))
        return bad

    return Parsed(optional_text(c, style.null_tokens), value, failed)


DATE_STYLES = {
    "day_first": (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    "month_first": (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    "iso": (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    "long": (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
}


def parse_date(c: Column, style: str) -> Column:
    """DATE in one fixed notation; any other notation gives NULL."""
    shape, fmt = DATE_STYLES[style]
    text = clean(c)
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)).cast("date"))


def parse_any_date(c: Column) -> Column:
    """The three notations a file-level date may use: ISO, d/M/yyyy, d MMMM yyyy."""
    return F.coalesce(parse_date(c, "iso"), parse_date(c, "day_first"), parse_date(c, "long"))


def _strip_zeros(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def money_label(value: Column) -> Column:
    """Short money text: $1.25b, $3.4m, $12k, $950; half-even rounding."""
    size = F.abs(value)

    def scaled(divisor: int, places: int) -> Column:
        digits = F.bround((size / F.lit(divisor)).cast("decimal(38,15)"), places)
        return _strip_zeros(digits.cast(f"decimal(30,{places})").cast("string"))

    sign = F.when(value < 0, F.lit("-$")).otherwise(F.lit("$"))
    return (
        F.when(value.isNull(), F.lit("—"))
        .when(value == 0, F.lit("$0"))
        .when(size >= 1_000_000_000, F.concat(sign, scaled(1_000_000_000, 2), F.lit("b")))
        .when(size >= 1_000_000, F.concat(sign, scaled(1_000_000, 1), F.lit("m")))
        .when(size >= 1_000, F.concat(sign, scaled(1_000, 1), F.lit("k")))
        .otherwise(F.concat(sign, scaled(1, 0)))
    )


def percent_label(fraction: Column) -> Column:
    """Fraction as a two-decimal percentage; values beyond ±1 are shown as they are."""
    percent = F.bround((fraction * F.lit(100)).cast("decimal(30,9)"), 2).cast("decimal(30,2)")
    return (
        F.when(fraction.isNull(), F.lit("—"))
        .when((fraction > 1) | (fraction < -1), _strip_zeros(fraction.cast(vocab.FRACTION).cast("string")))
        .otherwise(F.concat(percent.cast("string"), F.lit("%")))
    )


def half_year_end(d: Column) -> Column:
    """Last day of the half-year a date falls in."""
    return F.when(F.month(d) <= 6, F.make_date(F.year(d), F.lit(6), F.lit(30))).otherwise(
        F.make_date(F.year(d), F.lit(12), F.lit(31))
    )
