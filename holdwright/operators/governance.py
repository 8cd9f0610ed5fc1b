"""Approved mappings: structural drift, taxonomy checks and review decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright import vocab
from holdwright.functions.text import tidy_optional
from holdwright.operators.paging import top_of_each

# Profile properties compared always, and those compared only when a version expects them.
ALWAYS = ["headers", "section_labels", "tables", "internal_external", "asset_classes", "filters", "name_types"]
WHEN_EXPECTED = ["option_codes", "option_names"]


def drifted_properties(always: Sequence[str] = ALWAYS, optional: Sequence[str] = WHEN_EXPECTED, fingerprint: bool = True) -> Column:
    """Names of the properties whose observed and expected values differ (NULL equals NULL)."""
    differs = [F.when(~F.col(f"observed_{p}").eqNullSafe(F.col(f"expected_{p}")), F.lit(p)) for p in always]
    for p in optional:
        changed = F.col(f"expected_{p}").isNotNull() & ~F.col(f"observed_{p}").eqNullSafe(F.col(f"expected_{p}"))
        differs.append(F.when(changed, F.lit(p)))
    if fingerprint:
        differs.insert(0, F.when(F.col("schema_fingerprint") != F.col("expected_fingerprint"), F.lit("schema_fingerprint")))
    return F.array_compact(F.array(*differs))


def drift_score(properties: Column) -> Column:
    """Severity: every drifted property counts itself and its expected and actual entries."""
    return F.size(properties) * 3


def _shown(values: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def _compared(always: Sequence[str], optional: Sequence[str], fingerprint: bool) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(name, file column, version column) of the properties that must be equal, and of those a version may leave open."""
    named = lambda ps: [(p, f"observed_{p}", f"expected_{p}") for p in ps]
    return named(always), [*([("schema_fingerprint", "schema_fingerprint", "expected_fingerprint")] if fingerprint else []), *named(optional)]


def profile_classes(profiles: DataFrame, always: Sequence[str] = ALWAYS, optional: Sequence[str] = WHEN_EXPECTED, fingerprint: bool = True) -> DataFrame:
    """Profiles with the class of files that show the same: `profile_class`."""
    fixed, opened = _compared(always, optional, fingerprint)
    return profiles.withColumn("profile_class", F.sha2(_shown({"layout": F.col("layout_key"), **{n: F.col(c) for n, c, _ in (*fixed, *opened)}}), 256))


def mapping_candidates(
    profiles: DataFrame, versions: DataFrame, file_id: str = "source_file_id", always: Sequence[str] = ALWAYS, optional: Sequence[str] = WHEN_EXPECTED, fingerprint: bool = True,
) -> DataFrame:
    """The versions that matter for each file: all without drift, or else the least drifted one, with `drift` and its score.

    Files that show the same are one class, and only classes meet versions. First by one key: all
    properties of the class, with and without each one a version may leave open. Classes that no version
    fits ask an index of (layout, property, value) for the versions that share a value with them; the one with most
    agreeing properties is nearest, the earlier seed on ties. A version that shares no value can be nearest only by the number of
    properties it leaves open, so one of these per layout is enough. A file's fingerprint must not be NULL.
    """
    fixed, opened = _compared(always, optional, fingerprint)
    classed = profile_classes(profiles, always, optional, fingerprint)
    shows = ["layout_key", *[c for _, c, _ in (*fixed, *opened)]]
    kinds = classed.select("profile_class", *shows).dropDuplicates(["profile_class"])
    expected = [c for *_, c in (*fixed, *opened)]
    known = versions.select("layout_key", "mapping_version_id", "seed_position", *expected)

    def key(of: int, masked: Sequence[Column]) -> Column:
        values = {"layout": F.col("layout_key"), **{p[0]: F.col(p[of]) for p in fixed}}
        for (name, *_), p, is_open in zip(opened, opened, masked):
            values[name] = F.when(~is_open, F.col(p[of]))
            values[f"{name}_open"] = is_open
        return F.sha2(_shown(values), 256)

    masks = [[F.lit(bool(k >> j & 1)) for j in range(len(opened))] for k in range(1 << len(opened))]
    asked = kinds.select("profile_class", F.explode(F.array(*[key(1, m) for m in masks])).alias("all_of_it"))
    kept = known.select("mapping_version_id", "seed_position", key(2, [F.col(c).isNull() for *_, c in opened]).alias("all_of_it"))
    exact = asked.join(kept, "all_of_it").select("profile_class", "mapping_version_id", "seed_position")

    drifted = kinds.join(exact.select("profile_class").distinct(), "profile_class", "left_anti")
    text = lambda name, value: F.concat_ws("\u0001", F.col("layout_key"), F.lit(name), F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("")))
    ask = F.explode(F.array(*[text(n, F.col(c)) for n, c, _ in (*fixed, *opened)]))
    posts = F.array_compact(F.array(*[text(n, F.col(c)) for n, _, c in fixed], *[F.when(F.col(c).isNotNull(), text(n, F.col(c))) for n, _, c in opened]))
    left_open = sum((F.col(c).isNull().cast("int") for *_, c in opened), F.lit(0))
    index = known.select("mapping_version_id", "seed_position", left_open.alias("left_open"), F.explode(posts).alias("shown"))
    shared = drifted.select("profile_class", ask.alias("shown")).join(index, "shown").groupBy("profile_class", "mapping_version_id", "seed_position", "left_open").agg(F.count(F.lit(1)).alias("agreeing"))
    openest = known.groupBy("layout_key").agg(F.min_by(F.struct("mapping_version_id", "seed_position", left_open.alias("left_open")), F.struct(-left_open, "seed_position")).alias("v")).select("layout_key", "v.*")
    alone = drifted.select("profile_class", "layout_key").join(openest, "layout_key").select("profile_class", "mapping_version_id", "seed_position", "left_open", F.lit(0).cast("bigint").alias("agreeing"))
    best = F.min_by(F.struct("mapping_version_id", "seed_position"), F.struct(-(F.col("agreeing") + F.col("left_open")), "seed_position")).alias("v")
    nearest = shared.unionByName(alone).groupBy("profile_class").agg(best).select("profile_class", "v.*")

    chosen = exact.unionByName(nearest).join(known.drop("seed_position", "layout_key"), "mapping_version_id").join(kinds, "profile_class")
    judged = chosen.withColumn("drift", drifted_properties(always, optional, fingerprint)).withColumn("drift_score", drift_score(F.col("drift")))
    return classed.select(file_id, "profile_class").join(judged.select("profile_class", "mapping_version_id", "seed_position", "drift", "drift_score"), "profile_class").drop("profile_class")


def nearest_version(candidates: DataFrame, file_id: str = "source_file_id") -> DataFrame:
    """Least drifted version of each file; the earlier seed wins a tie."""
    best = F.min_by(F.struct("mapping_version_id", "drift", "drift_score"), F.struct("drift_score", "seed_position"))
    return candidates.groupBy(file_id).agg(best.alias("best")).select(file_id, "best.*")


def taxonomy_matches(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rows joined to the taxonomy row of their version (null-safe on the nullable keys)."""
    t = taxonomy.select(
        F.col("mapping_version_id").alias("t_version"), F.col("source_asset_class_raw").alias("t_class"), F.col("source_filter_raw").alias("t_filter"),
        F.col("source_section_raw").alias("t_section"), F.col("is_aggregate_default").alias("t_aggregate"), F.col("canonical_asset_class_code").alias("t_code"),
        F.col("disclosure_completeness_default").alias("t_state"), F.lit(True).alias("t_known"),
    )
    on = (
        (F.col("mapping_version_id") == F.col("t_version"))
        & (F.col("source_asset_class_raw") == F.col("t_class"))
        & F.col("source_subclass_raw").eqNullSafe(F.col("t_filter"))
        & F.col("source_section_raw").eqNullSafe(F.col("t_section"))
        & (F.col("is_aggregate") == F.col("t_aggregate"))
    )
    return rows.join(t, on, "left")


def taxonomy_issues(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row per mismatch: missing mapping, other class, other disclosure state."""
    joined = taxonomy_matches(rows, taxonomy)
    known = F.coalesce("t_known", F.lit(False))
    nothing = F.lit(None).cast("string")
    issue = lambda reason, expected, actual: F.struct(F.lit(reason).alias("reason"), expected.alias("expected"), actual.alias("actual"))
    found = F.array_compact(
        F.array(
            F.when(~known, issue("missing_mapping", nothing, nothing)),
            F.when(known & (F.col("t_code") != F.col("asset_class_code")), issue("canonical_asset_class_mismatch", F.col("t_code"), F.col("asset_class_code"))),
            F.when(
                known & (F.coalesce("t_state", F.lit("")) != "") & (F.col("t_state") != F.col("disclosure_completeness")),
                issue("disclosure_completeness_mismatch", F.col("t_state"), F.col("disclosure_completeness")),
            ),
        )
    )
    return joined.select(*rows.columns, F.posexplode(found).alias("issue_position", "issue")).select("*", "issue.*").drop("issue")


def reported_issues(issues: DataFrame, file_id: str, order: Sequence[Column], limit: int = vocab.TAXONOMY_REPORT_LIMIT) -> DataFrame:
    return top_of_each(issues, [file_id], [*order, F.asc("issue_position")], limit)


def enforce(profiles: DataFrame, versions: DataFrame, rows: DataFrame, taxonomy: DataFrame, **compare) -> DataFrame:
    """Mapping decision of every file.

    The first version (in seed order) without drift and without taxonomy
    mismatch approves the file. Otherwise the near miss with the fewest
    problems is named, taxonomy ahead of drift, and the file goes to review.
    Rows are reduced to their distinct taxonomy keys before they meet the
    versions that fit. A layout without approved versions passes.
    """
    candidates = mapping_candidates(profiles, versions, **compare)
    shape = ["source_asset_class_raw", "source_subclass_raw", "source_section_raw", "is_aggregate", "asset_class_code", "disclosure_completeness"]
    keys = rows.groupBy("source_file_id", *shape).agg(F.count(F.lit(1)).alias("copies"))
    clean = candidates.where(F.col("drift_score") == 0).select("source_file_id", "mapping_version_id")
    issues = taxonomy_issues(keys.join(clean, "source_file_id"), taxonomy)
    counted = issues.groupBy("source_file_id", "mapping_version_id").agg(F.sum("copies").alias("mismatches"))
    judged = candidates.join(counted, ["source_file_id", "mapping_version_id"], "left").withColumn("mismatches", F.coalesce("mismatches", F.lit(0)))
    taxonomy_score = F.lit(1) + F.col("mismatches")
    stage = F.when(F.col("drift_score") > 0, 2).when(F.col("mismatches") > 0, 1).otherwise(0)
    score = F.when(stage == 2, F.col("drift_score")).when(stage == 1, taxonomy_score).otherwise(0)
    judged = judged.withColumn("stage", stage).withColumn("score", score.cast("bigint"))
    best = F.min_by(F.struct("mapping_version_id", "stage", "score", "drift"), F.struct("stage", "score", "seed_position"))
    decided = judged.groupBy("source_file_id").agg(best.alias("d")).select("source_file_id", "d.*")
    reason = F.when(F.col("stage") == 1, "unapproved_taxonomy_mapping").when(F.col("stage") == 2, "schema_drift")
    out = profiles.join(decided, "source_file_id", "left").withColumn("review_reason", reason)
    return out.withColumn("ingest_status", F.when(F.col("review_reason").isNull(), "loaded").otherwise("review_required"))


DETAIL = "source_file_id bigint, mapping_version_id string, review_reason string, position int, property string, expected string, actual string, source_row_number int"


def review_details(
    decided: DataFrame, versions: DataFrame, rows: DataFrame, taxonomy: DataFrame, order: Sequence[str] = ("source_row_number",),
    always: Sequence[str] = ALWAYS, optional: Sequence[str] = WHEN_EXPECTED, fingerprint: bool = True, limit: int = vocab.TAXONOMY_REPORT_LIMIT,
) -> DataFrame:
    """What made a file wait, one row per difference: expected and actual value, and the row where there is one.

    Drift: every property of the nearest version that differs, in the order of comparison. Taxonomy: the first
    `limit` mismatching rows of the file against its version.
    """
    fixed, opened = _compared(always, optional, fingerprint)
    properties = [*[p for p in opened if p[0] == "schema_fingerprint"], *fixed, *[p for p in opened if p[0] != "schema_fingerprint"]]
    told = versions.select("mapping_version_id", *[F.col(c) for *_, c in properties])
    one = lambda c: F.col(c).cast("string") if c.endswith("fingerprint") else F.array_join(c, "|")
    cells = F.array(*[F.struct(F.lit(n).alias("property"), one(wanted).alias("expected"), one(seen).alias("actual")) for n, seen, wanted in properties])
    drifted = decided.where(F.col("review_reason") == "schema_drift").join(told, "mapping_version_id")
    differing = F.filter(cells, lambda x: F.array_contains("drift", x["property"]))
    listed = drifted.select("source_file_id", "mapping_version_id", "review_reason", F.posexplode(differing).alias("at", "x"))
    nowhere = F.lit(None).cast("int").alias("source_row_number")
    shown = listed.select("source_file_id", "mapping_version_id", "review_reason", (F.col("at") + 1).alias("position"), "x.property", "x.expected", "x.actual", nowhere)
    waiting = decided.where(F.col("review_reason") == "unapproved_taxonomy_mapping").select("source_file_id", "mapping_version_id", "review_reason")
    found = reported_issues(taxonomy_issues(rows.join(waiting, "source_file_id"), taxonomy), "source_file_id", [F.asc(c) for c in order], limit)
    rows_of = found.select("source_file_id", "mapping_version_id", "review_reason", F.col("rank").cast("int").alias("position"), F.col("reason").alias("property"), "expected", "actual", F.col("source_row_number").cast("int").alias("source_row_number"))
    return shown.unionByName(rows_of)


def missing_keys(required: Sequence[str], present: Column) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in required]), present)


def taxonomy_from_classes(version_id: str, class_rows: DataFrame) -> DataFrame:
    """Taxonomy rows of a new version, derived from a layout's class rules."""
    return class_rows.select(
        F.lit(version_id).alias("mapping_version_id"), "source_asset_class_raw", "source_filter_raw", "source_section_raw", "is_aggregate_default",
        "canonical_asset_class_code", F.when(F.col("is_aggregate_default"), "aggregate_total").alias("disclosure_completeness_default"),
    ).distinct()


def seed_versions(stored: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved versions not stored yet."""
    return approved.join(stored.select("mapping_version_id"), "mapping_version_id", "left_anti")


def apply_review_decisions(items: DataFrame, decisions: DataFrame, stored_versions: DataFrame | None = None, taxonomy: DataFrame | None = None) -> DataFrame:
    """Status of every review item after its decisions.

    decisions: item_id, action (resolve | reject | approve), mapping_version_id,
    approved_by, decided_at. The first decision on an open item counts. An
    approval needs a version id nobody used before, an approver, an observed
    fingerprint, and (with `taxonomy`) at least one row and no duplicate scope.
    """
    first = decisions.groupBy("item_id").agg(F.min_by(F.struct("action", "mapping_version_id", "approved_by", "decided_at"), "decided_at").alias("d"))
    out = items.join(first, "item_id", "left").select("*", "d.action", tidy_optional(F.col("d.mapping_version_id")).alias("wanted_version"),
                                                     tidy_optional(F.col("d.approved_by")).alias("approved_by"), "d.decided_at").drop("d")
    approves = (F.col("action") == "approve") & (F.col("status") == "open")
    claims = out.where(approves & F.col("wanted_version").isNotNull()).groupBy("wanted_version").agg(
        F.min(F.struct("decided_at", "item_id")).alias("claim")
    )
    out = out.join(claims.select(F.col("wanted_version").alias("claim_version"), F.col("claim.item_id").alias("claim_item")), F.col("wanted_version") == F.col("claim_version"), "left")
    allowed = approves & (F.col("claim_item") == F.col("item_id")) & F.col("approved_by").isNotNull() & F.col("schema_fingerprint").isNotNull()
    if stored_versions is not None:
        used = stored_versions.select(F.col("mapping_version_id").alias("used_version")).distinct()
        out = out.join(used, F.col("wanted_version") == F.col("used_version"), "left")
        allowed = allowed & F.col("used_version").isNull()
    if taxonomy is not None:
        scope = ["source_asset_class_raw", "source_filter_raw", "source_section_raw", "is_aggregate_default"]
        sound = taxonomy.groupBy("mapping_version_id", *scope).count().groupBy("mapping_version_id").agg(F.max("count").alias("copies"))
        sound = sound.where(F.col("copies") == 1).select(F.col("mapping_version_id").alias("sound_version"))
        out = out.join(sound, F.col("wanted_version") == F.col("sound_version"), "left")
        allowed = allowed & F.col("sound_version").isNotNull()
    allowed = F.coalesce(allowed, F.lit(False))
    is_open = F.col("status") == "open"
    status = (
        F.when(~is_open | F.col("action").isNull(), F.col("status"))
        .when(F.col("action") == "resolve", "resolved")
        .when(F.col("action") == "reject", "rejected")
        .when(allowed, "resolved")
        .otherwise(F.col("status"))
    )
    return out.withColumn("new_status", status).withColumn("approved_version", F.when(allowed, F.col("wanted_version"))).drop("claim_version", "claim_item", "used_version", "sound_version")
