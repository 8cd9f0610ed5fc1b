"""Which fund a file belongs to, judged from its address and option names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdwright.functions.text import fold, normalise_name


@dataclass(frozen=True)
class FundSignals:
    """What points at one fund."""

    code: str
    domains: Sequence[str] = ()
    path_tokens: Sequence[str] = ()
    option_names: Sequence[str] = ()
    option_prefixes: Sequence[str] = ()


# Signals of the two funds that publish the shared 24-column schema.
SHARED_SCHEMA_FUNDS = (
    FundSignals(
        "australiansuper",
        domains=("australiansuper.com",),
        path_tokens=("australiansuper",),
        option_names=("socially aware", "member direct", "conservative balanced"),
    ),
    FundSignals(
        "art",
        domains=("australianretirementtrust.com.au", "art.com.au"),
        path_tokens=("australianretirementtrust", "australian-retirement-trust", "art_sunsuper", "art-sunsuper"),
        option_prefixes=("art ",),
    ),
)


def host(url: Column) -> Column:
    """Folded host of an http(s) address, else NULL."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", fold(found))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def signal_hits(url: Column, options: Column, fund: FundSignals) -> list[Column]:
    """(domain, path, option) evidence for one fund."""
    domain = _any([host(url).contains(d) for d in fund.domains])
    path = _any([fold(url).contains(t) for t in fund.path_tokens])
    names = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: normalise_name(o))
    option = F.exists(names, lambda n: _any([n == o for o in fund.option_names] + [n.startswith(p) for p in fund.option_prefixes]))
    return [domain, path, option]


def identity(url: Column, options: Column, funds: Sequence[FundSignals] = SHARED_SCHEMA_FUNDS) -> Column:
    """(fund, confidence, reasons): domain and path count two, an option name one.

    Evidence for two funds is a conflict and names none.
    """
    scores, reasons = [], []
    for f in funds:
        domain, path, option = signal_hits(url, options, f)
        two, one, zero = F.lit(2), F.lit(1), F.lit(0)
        scores.append(F.when(domain, two).otherwise(zero) + F.when(path, two).otherwise(zero) + F.when(option, one).otherwise(zero))
        for label, hit in (("domain", domain), ("path", path), ("option", option)):
            reasons.append(F.when(hit, F.lit(f"{f.code}:{label}")))
    positive = [F.when(s > 0, 1).otherwise(0) for s in scores]
    sides = sum(positive[1:], positive[0])
    fund = F.coalesce(*[F.when((sides == 1) & (s > 0), F.lit(f.code)) for f, s in zip(funds, scores, strict=True)])
    confidence = F.when(sides > 1, "conflicted").when(F.greatest(*scores) >= 2, "high").when(sides == 1, "medium").otherwise("unknown")
    return F.struct(fund.alias("fund_code"), confidence.alias("confidence"), F.array_compact(F.array(*reasons)).alias("reasons"))


def identity_problem(declared: Column, probable: Column) -> Column:
    """Review text when the declared fund is not the one the signals name."""
    name = fold(declared)
    return F.when(probable.isNull(), F.concat(F.lit("unverified:"), name)).when(name != probable, F.concat_ws(":", F.lit("disagrees"), name, probable))


def allowed_source(url: Column, fund: Column, hosts: Sequence[str], path_prefix: str, funds: Sequence[str]) -> Column:
    """Issue text when an http(s) source is off the allow-list; local paths pass."""
    remote = url.rlike("^https?://")
    wrong = ~F.coalesce(host(url).isin(*hosts), F.lit(False)) | ~url_path(url).startswith(path_prefix)
    return F.when(fund.isNotNull() & ~fold(fund).isin(*funds), "fund_identity_mismatch").when(remote & wrong, "source_domain_mismatch")
