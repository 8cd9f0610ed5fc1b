"""Registered queries of the scalar rules, with SQL that states the result another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions import identifiers, identity, numbers, payload, rules, text
from holdwright.plans.binding import DriverTables
from holdwright.plans.oracle_base import LINES, norm, with_ctes

PHRASES = list(vocab.SCOPE_PHRASES) + ["Held directly: by others (trusts)"]


def _key() -> list:
    return [F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyyMMdd")).alias("holding_key")]


SQL_KEY = "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS holding_key"


def parse_money_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Money, plain, bracketed and percent texts written from the measures, read back."""
    li = DriverTables(spark, sf).table("lineitem")
    money = F.col("l_extendedprice").cast("decimal(20,2)")
    grouped = F.format_number(money, 2)
    n = F.col("l_linenumber")
    pct = (F.col("l_discount").cast("decimal(10,2)") * 100).cast("decimal(10,2)").cast("string")
    texts = li.select(
        *_key(),
        F.when(n == 1, F.concat(F.lit("-$"), grouped)).when(n == 2, grouped).when(n == 3, F.lit("n/a")).when(n == 4, F.lit("$oops")).otherwise(F.concat(F.lit(" $"), grouped)).alias("dollar"),
        F.when(n == 1, F.concat(F.lit("("), grouped, F.lit(")"))).when(n == 2, F.lit("NaN")).otherwise(grouped).alias("bracket"),
        F.when(n == 5, F.lit("5.7e-07")).otherwise(F.concat(F.lit("- "), F.translate(grouped, ",", " "))).alias("spaced"),
        F.when(n == 6, pct).when(n == 7, F.lit("140.0%")).otherwise(F.concat(F.lit("+"), pct, F.lit("%"))).alias("percent"),
    )
    out, parsed = numbers.add_parsed(texts, {
        "p_dollar": numbers.parse_number(F.col("dollar"), numbers.NumberStyle(("", "n/a"), dollar="required")),
        "p_bracket": numbers.parse_number(F.col("bracket"), numbers.NumberStyle(("", "n/a", "nan"), parentheses=True)),
        "p_spaced": numbers.parse_number(F.col("spaced"), numbers.NumberStyle(("", "-"), dollar="optional", inner_spaces=True), vocab.UNITS),
        "p_percent": numbers.parse_percent(F.col("percent"), numbers.PercentStyle(("", "-"), plus=True, low=0, high=1)),
        "p_points": numbers.parse_percent(F.col("percent"), numbers.PercentStyle(("", "-"), sign="optional", plus=True)),
    })
    dollar, bracket, percent = (parsed[f"p_{n}"] for n in ("dollar", "bracket", "percent"))
    return out.select(
        "holding_key", dollar.value.alias("dollar_value"), dollar.failed.alias("dollar_failed"), bracket.value.alias("bracket_value"), bracket.failed.alias("bracket_failed"),
        parsed["p_spaced"].value.alias("spaced_value"), percent.value.alias("percent_value"), percent.failed.alias("percent_failed"), parsed["p_points"].value.alias("optional_percent_value"),
    )


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in four notations, each read with every style."""
    li = DriverTables(spark, sf).table("lineitem")
    d, n = F.col("l_shipdate"), F.col("l_linenumber")
    written = (
        F.when(n == 1, F.date_format(d, "d/M/yyyy")).when(n == 2, F.date_format(d, "MM/dd/yyyy")).when(n == 3, F.date_format(d, "yyyy-MM-dd"))
        .when(n == 4, F.concat(F.lit(" "), F.date_format(d, "d MMMM yyyy"), F.lit(" "))).when(n == 5, F.date_format(d, "d/M/yy")).otherwise(F.lit("31/02/2001"))
    )
    return li.select(*_key(), written.alias("t")).select(
        "holding_key", *[numbers.parse_date(F.col("t"), s).alias(s) for s in ("day_first", "month_first", "iso", "long")], numbers.parse_any_date(F.col("t")).alias("any_style"),
        numbers.half_year_end(numbers.parse_date(F.col("t"), "iso")).alias("half_end"),
    )


def identifier_types(spark: SparkSession, sf: str) -> DataFrame:
    """Identifier texts of several shapes under every inference rule and the registry forms."""
    li = DriverTables(spark, sf).table("lineitem")
    part, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    shaped = (
        F.when(n == 1, F.concat(F.lit("AU"), F.lpad(part, 10, "0"))).when(n == 2, F.concat(F.lpad(part, 5, "A"), F.lit("  AU")))
        .when(n == 3, F.lpad(part, 7, "B")).when(n == 4, F.lpad(part, 12, "X")).when(n == 5, F.concat(F.lit("au "), part)).when(n == 6, F.lit(" ")).otherwise(F.lpad(part, 11, "0"))
    )
    rows = li.select(*_key(), shaped.alias("t"), n.alias("n"))
    kind = F.when(F.col("n") == 2, " asx_code ").when(F.col("n") == 7, "abn").when(F.col("n") != 6, "Isin")
    out = rows.select(
        "holding_key", *[identifiers.identifier_type(F.col("t"), r).alias(f"by_{r}") for r in identifiers.IDENTIFIER_RULES],
        identifiers.business_number(F.col("t")).alias("abn"), identifiers.registry_type(kind).alias("registry_type"), identifiers.registry_value(identifiers.registry_type(kind), F.col("t")).alias("registry_value"),
    )
    return out


def completeness_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Disclosure state of every line under the five rule sets."""
    lines = DriverTables(spark, sf).lines
    q = F.col("quantity")
    ident = F.when(q > 40, F.lit("id"))
    shared = dict(
        aggregate=F.col("is_aggregate"), value=F.col("value_aud"), ownership=F.col("ownership_pct"), units=F.col("units"), identifier=ident, name=F.lit("n"), band=F.col("value_band_raw"),
        classification=F.col("classification_raw"), address=F.when(q == 30, F.lit("a")), latitude=F.when(q == 31, F.lit(1)), weighting=F.when(q > 10, F.lit(1)),
        managed=F.col("source_subclass_raw").isNotNull(), value_only_block=q < 10,
    )
    return lines.select("holding_key", *[rules.completeness(r, **shared).alias(f"by_{r}") for r in ("flat", "banded", "shared", "weighted", "block")])


def slug_and_scope(spark: SparkSession, sf: str) -> DataFrame:
    customers = DriverTables(spark, sf).table("customer")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("c_nationkey") % len(PHRASES) + 1).cast("int"))
    return customers.select(
        F.col("c_custkey").alias("customer"),
        text.slug(F.concat(F.lit(" ("), "c_name", F.lit(") & "), "c_mktsegment", F.lit("!")), "OPTION_").alias("option_code"),
        text.scope_code(phrase, vocab.SCOPE_PHRASES).alias("scope"), phrase.isin(*vocab.SCOPE_PHRASES).alias("is_approved"),
    )


def labels_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Short money and percent texts, labels and period texts of every line."""
    li = DriverTables(spark, sf).table("lineitem")
    cents = F.col("l_extendedprice").cast("decimal(24,9)")
    scale = F.element_at(F.array(*[F.lit(x).cast("decimal(12,4)") for x in ("0.01", "1", "-1", "100", "50000", "0", "0.5")]), F.col("l_linenumber"))
    money = (cents * scale).cast("decimal(24,9)")
    share = (F.col("l_discount").cast("decimal(18,9)") * F.when(F.col("l_linenumber") == 7, F.lit(25)).otherwise(F.lit(1))).cast("decimal(18,9)")
    return li.select(
        *_key(), numbers.money_label(money).alias("money"), numbers.percent_label(share).alias("percent"), F.date_format("l_shipdate", "dd MMM yyyy").alias("period_label"),
        rules.tier_label(F.when(F.col("l_returnflag") == "A", " Seeded ").when(F.col("l_returnflag") == "R", "very_high")).alias("tier"),
        text.title_words(F.when(F.col("l_linestatus") == "O", "manager_rollup").otherwise("direct_holding")).alias("kind"),
    )


SIGNALS = (
    identity.FundSignals("left", domains=("example.com",), path_tokens=("blog.",), option_names=("red plate",)),
    identity.FundSignals("right", domains=("example.org",), path_tokens=("/de/", "/es/"), option_prefixes=("small ",)),
)


def fund_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Fund signals of every page address, and the allow-list check."""
    pages = DriverTables(spark, sf).table("pages")
    options = F.when(F.col("page_id") % 3 == 0, F.array(F.lit(" Red  Plate"))).when(F.col("page_id") % 3 == 1, F.array(F.lit("Small Ring"), F.lit("x")))
    found = identity.identity(F.col("url"), options, SIGNALS)
    declared = F.when(F.col("page_id") % 2 == 0, "LEFT").otherwise("right")
    return pages.select(F.col("page_id").alias("page_id"), "url", found.alias("i"), declared.alias("declared")).select(
        F.col("page_id").cast("bigint").alias("page_id"), identity.host(F.col("url")).alias("host"), F.col("i.fund_code").alias("fund_code"), F.col("i.confidence").alias("confidence"), F.concat_ws(",", "i.reasons").alias("reasons"),
        identity.identity_problem(F.col("declared"), F.col("i.fund_code")).alias("problem"),
        identity.allowed_source(F.col("url"), F.col("declared"), ["m.ththth.example.net", "ththre.example.com"], "/en/", ["left", "right"]).alias("source_issue"),
    )


def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Row flags and range checks of every line."""
    lines = DriverTables(spark, sf).lines
    value = F.when(F.col("source_row_number") == 3, -F.col("value_aud")).otherwise(F.col("value_aud"))
    weighting = F.when(F.col("quantity") > 25, F.col("quantity") / 40)
    flags = rules.quality_flags(value, F.col("ownership_pct"), weighting)
    return lines.select("holding_key", F.concat_ws(",", flags).alias("flags"), rules.out_of_range(weighting, 0, 1).alias("weighting_off_range"))


def normalise_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents normalised; NUL marks stand in for undecodable bytes."""
    docs = DriverTables(spark, sf).table("documents")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(text.normalise_name(F.col("text")), 256).alias("normalised_hash"), F.length(text.clean(F.col("text"))).cast("bigint").alias("clean_length"),
        text.replacement_count(F.translate("text", "e", text.REPLACEMENT)).cast("bigint").alias("replaced"),
    )


def payload_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Stored payloads of the three shapes, one row per tagged entry."""
    li = DriverTables(spark, sf).table("lineitem")
    part, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    record = F.concat(F.lit('["'), part, F.lit('","x"]'))
    stored = (
        F.when(n <= 2, record).when(n <= 4, F.concat(F.lit("["), record, F.lit(',["y"],["z"]]')))
        .when(n <= 6, F.concat(F.lit('[{"source_row_number":77,"payload":'), record, F.lit('},{"payload":["w"]}]')))
    )
    rows = li.select(*_key(), stored.alias("stored"), n.alias("n"))
    entries = payload.tagged_entries(F.col("stored"), F.col("n"), F.array(F.lit(90)))
    out = rows.select("holding_key", F.posexplode(entries).alias("place", "e"))
    return out.select("holding_key", F.col("place").cast("bigint").alias("place"), F.col("e.source_row_number").cast("bigint").alias("source_row_number"), F.concat_ws("|", "e.payload").alias("payload"))


QUERIES = {
    "payload_entries": payload_entries,
    "parse_money_percent": parse_money_percent,
    "parse_dates": parse_dates,
    "identifier_types": identifier_types,
    "completeness_rules": completeness_rules,
    "slug_and_scope": slug_and_scope,
    "labels_compact": labels_compact,
    "fund_identity": fund_identity,
    "quality_flags": quality_flags,
    "normalise_texts": normalise_texts,
}

_V = "CAST(l_extendedprice AS DECIMAL(24,9))"
_D = "CAST(l_discount AS DECIMAL(18,9))"


def _even(cents_per_unit: str) -> str:
    """Half-even rounding of `a` (whole cents) to units of that many cents."""
    return f"(a // {cents_per_unit} + CASE WHEN (a % {cents_per_unit}) * 2 > {cents_per_unit} OR ((a % {cents_per_unit}) * 2 = {cents_per_unit} AND (a // {cents_per_unit}) % 2 = 1) THEN 1 ELSE 0 END)"


def _trim(x: str, places: int) -> str:
    return rf"regexp_replace(CAST(CAST({x} AS DECIMAL(20,{places})) / 1 AS VARCHAR), '\.?0+$', '')" if places else f"CAST({x} AS VARCHAR)"


SQL = {
    "payload_entries": f"""WITH b AS (SELECT {SQL_KEY}, l_linenumber AS n, CAST(l_partkey AS VARCHAR) || '|x' AS p FROM lineitem)
SELECT holding_key, CAST(0 AS BIGINT) AS place, CAST(CASE WHEN n <= 4 THEN n ELSE 77 END AS BIGINT) AS source_row_number, p AS payload FROM b WHERE n <= 6
UNION ALL SELECT holding_key, 1, 90, 'y' FROM b WHERE n IN (3, 4) UNION ALL SELECT holding_key, 2, n, 'z' FROM b WHERE n IN (3, 4) UNION ALL SELECT holding_key, 1, n, 'w' FROM b WHERE n IN (5, 6)""",
    "parse_money_percent": f"""SELECT {SQL_KEY}, CAST(CASE WHEN l_linenumber = 1 THEN -{_V} WHEN l_linenumber IN (2, 3, 4) THEN NULL ELSE {_V} END AS DECIMAL(24,9)) AS dollar_value, l_linenumber IN (2, 4) AS dollar_failed,
  CAST(CASE WHEN l_linenumber = 1 THEN -{_V} WHEN l_linenumber = 2 THEN NULL ELSE {_V} END AS DECIMAL(24,9)) AS bracket_value, false AS bracket_failed,
  CASE WHEN l_linenumber = 5 THEN CAST(0.00000057 AS DECIMAL(30,12)) ELSE CAST(-CAST(l_extendedprice AS DECIMAL(24,2)) AS DECIMAL(30,12)) END AS spaced_value,
  CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN CAST(1.4 AS DECIMAL(18,9)) ELSE {_D} END AS percent_value, l_linenumber IN (6, 7) AS percent_failed,
  CASE WHEN l_linenumber = 7 THEN CAST(1.4 AS DECIMAL(18,9)) ELSE {_D} END AS optional_percent_value FROM lineitem""",
    "parse_dates": f"""SELECT {SQL_KEY}, CASE WHEN l_linenumber = 1 THEN d WHEN l_linenumber = 2 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END AS day_first,
  CASE WHEN l_linenumber = 2 THEN d WHEN l_linenumber = 1 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END AS month_first, CASE WHEN l_linenumber = 3 THEN d END AS iso, CASE WHEN l_linenumber = 4 THEN d END AS long,
  CASE WHEN l_linenumber IN (1, 3, 4) THEN d WHEN l_linenumber = 2 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END AS any_style,
  CASE WHEN l_linenumber = 3 THEN CASE WHEN month(d) <= 6 THEN make_date(year(d), 6, 30) ELSE make_date(year(d), 12, 31) END END AS half_end
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem)""",
    "identifier_types": f"""SELECT {SQL_KEY}, CASE WHEN t = ' ' THEN NULL WHEN regexp_full_match(t, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN 'ISIN' ELSE 'UNKNOWN' END AS by_isin,
  CASE WHEN t = ' ' THEN NULL WHEN regexp_full_match(t, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN 'ISIN' WHEN regexp_full_match(t, '[A-Z0-9]{{2,6}}\\s+AU') THEN 'ASX_CODE' ELSE 'UNKNOWN' END AS by_isin_asx,
  CASE WHEN t = ' ' THEN NULL WHEN regexp_full_match(t, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN 'ISIN' WHEN regexp_full_match(t, '[A-Z0-9]{{7}}') THEN 'SEDOL' ELSE 'UNKNOWN' END AS by_isin_sedol,
  CASE WHEN t = ' ' THEN NULL WHEN regexp_full_match(t, '[A-Z0-9]{{12}}') THEN 'ISIN' ELSE 'UNKNOWN' END AS by_twelve,
  CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) = 11 THEN regexp_replace(t, '[^0-9]', '', 'g') END AS abn,
  CASE WHEN l_linenumber = 2 THEN 'ASX' WHEN l_linenumber = 7 THEN 'ABN' WHEN l_linenumber <> 6 THEN 'ISIN' END AS registry_type, CASE WHEN l_linenumber <> 6 THEN upper(replace(t, ' ', '')) END AS registry_value
FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 'AU' || lpad(p, 10, '0') WHEN 2 THEN lpad(p, 5, 'A') || '  AU' WHEN 3 THEN lpad(p, 7, 'B') WHEN 4 THEN lpad(p, 12, 'X') WHEN 5 THEN 'au ' || p WHEN 6 THEN ' ' ELSE lpad(p, 11, '0') END AS t
  FROM (SELECT *, CAST(l_partkey AS VARCHAR) AS p FROM lineitem))""",
    "completeness_rules": with_ctes(LINES, query="""SELECT holding_key, disclosure_completeness AS by_flat,
  CASE WHEN is_aggregate THEN 'aggregate_total' WHEN b AND NOT v THEN 'name_only' WHEN v AND (o OR i OR u OR c OR quantity = 30) THEN 'fully_disclosed' WHEN v THEN 'value_only' WHEN o THEN 'ownership_only' ELSE 'name_only' END AS by_banded,
  CASE WHEN is_aggregate THEN 'aggregate_total' WHEN b AND NOT v THEN 'name_only' WHEN v AND source_subclass_raw IS NOT NULL THEN 'value_only' WHEN v AND (o OR i OR u OR c OR quantity IN (30, 31)) THEN 'fully_disclosed' WHEN v THEN 'value_only' WHEN o THEN 'ownership_only' ELSE 'name_only' END AS by_shared,
  CASE WHEN is_aggregate THEN 'aggregate_total' WHEN v AND quantity > 10 AND (i OR u) THEN 'fully_disclosed' WHEN v THEN 'value_only' WHEN o THEN 'ownership_only' ELSE 'name_only' END AS by_weighted,
  CASE WHEN is_aggregate THEN 'aggregate_total' WHEN v AND o AND quantity >= 10 THEN 'fully_disclosed' WHEN v THEN 'value_only' WHEN o THEN 'ownership_only' ELSE 'name_only' END AS by_block
FROM (SELECT *, value_aud IS NOT NULL AS v, ownership_pct IS NOT NULL AS o, units IS NOT NULL AS u, quantity > 40 AS i, value_band_raw IS NOT NULL AS b, classification_raw IS NOT NULL AS c FROM lines)"""),
    "slug_and_scope": """SELECT c_custkey AS customer, 'OPTION_CUSTOMER_' || substr(c_name, 10) || '_' || c_mktsegment AS option_code,
  CASE WHEN c_nationkey % 4 = 3 THEN 'held_directly_by_others_trusts' ELSE 'held_direct_or_associated_or_psts' END AS scope, c_nationkey % 4 <> 3 AS is_approved FROM customer""",
    "labels_compact": f"""SELECT {SQL_KEY}, CASE WHEN l_linenumber = 6 THEN '$0' ELSE CASE WHEN l_linenumber = 3 THEN '-$' ELSE '$' END || CASE
      WHEN a >= 1000000000000000 THEN {_trim(_even('10000000000000') + ' / 100.0', 2)} || 'b' WHEN a >= 1000000000000 THEN {_trim(_even('100000000000') + ' / 10.0', 1)} || 'm'
      WHEN a >= 1000000000 THEN {_trim(_even('100000000') + ' / 10.0', 1)} || 'k' ELSE {_trim(_even('1000000'), 0)} END END AS money,
  CASE WHEN l_linenumber = 7 AND l_discount * 25 > 1 THEN regexp_replace(CAST(CAST({_D} * 25 AS DECIMAL(18,9)) AS VARCHAR), '\\.?0+$', '') ELSE CAST(CAST({_D} * 100 * CASE WHEN l_linenumber = 7 THEN 25 ELSE 1 END AS DECIMAL(18,2)) AS VARCHAR) || '%' END AS percent,
  strftime(l_shipdate, '%d %b %Y') AS period_label, CASE l_returnflag WHEN 'A' THEN 'Reviewed' WHEN 'R' THEN 'Very High' ELSE 'Linked' END AS tier, CASE l_linestatus WHEN 'O' THEN 'Manager Rollup' ELSE 'Direct Holding' END AS kind
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber WHEN 1 THEN 100 WHEN 2 THEN 10000 WHEN 3 THEN 10000 WHEN 4 THEN 1000000 WHEN 5 THEN 500000000 WHEN 6 THEN 0 ELSE 5000 END AS a FROM lineitem)""",
    "fund_identity": """SELECT page_id, host, CASE WHEN l > 0 AND r = 0 THEN 'left' WHEN r > 0 AND l = 0 THEN 'right' END AS fund_code,
  CASE WHEN l > 0 AND r > 0 THEN 'conflicted' WHEN greatest(l, r) >= 2 THEN 'high' WHEN greatest(l, r) = 1 THEN 'medium' ELSE 'unknown' END AS confidence,
  concat_ws(',', CASE WHEN ld THEN 'left:domain' END, CASE WHEN lp THEN 'left:path' END, CASE WHEN lo THEN 'left:option' END, CASE WHEN rd THEN 'right:domain' END, CASE WHEN rp THEN 'right:path' END, CASE WHEN ro THEN 'right:option' END) AS reasons,
  CASE WHEN (l > 0) = (r > 0) THEN 'unverified:' || dec WHEN dec <> CASE WHEN l > 0 THEN 'left' ELSE 'right' END THEN 'disagrees:' || dec || ':' || CASE WHEN l > 0 THEN 'left' ELSE 'right' END END AS problem,
  CASE WHEN host NOT IN ('m.ththth.example.net', 'ththre.example.com') OR NOT starts_with(path, '/en/') THEN 'source_domain_mismatch' END AS source_issue
FROM (SELECT *, ld::INT * 2 + lp::INT * 2 + lo::INT AS l, rd::INT * 2 + rp::INT * 2 + ro::INT AS r FROM (
  SELECT CAST(page_id AS BIGINT) AS page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN page_id % 2 = 0 THEN 'left' ELSE 'right' END AS dec,
    contains(regexp_extract(url, '^https?://([^/?#:]+)', 1), 'example.com') AS ld, contains(lower(url), 'blog.') AS lp, page_id % 3 = 0 AS lo,
    contains(regexp_extract(url, '^https?://([^/?#:]+)', 1), 'example.org') AS rd, contains(lower(url), '/de/') OR contains(lower(url), '/es/') AS rp, page_id % 3 = 1 AS ro FROM pages))""",
    "quality_flags": with_ctes(LINES, query="""SELECT holding_key, concat_ws(',', CASE WHEN quantity > 25 AND value_aud IS NULL THEN 'weighting_without_value' END, CASE WHEN ownership_pct = 0 THEN 'zero_ownership_pct' END,
  CASE WHEN source_row_number = 3 AND value_aud > 0 THEN 'negative_value_aud' END) AS flags, quantity > 40 AS weighting_off_range FROM lines"""),
    "normalise_texts": f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256({norm('text')}) AS normalised_hash, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS clean_length, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS replaced FROM documents""",
}
