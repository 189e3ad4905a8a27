"""Change operators: a base table and a set of changes give a new table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions.text import text
from panelmark.operators import slices

# Legacy column -> the column it mirrors
LEGACY_COLUMNS = {
    "rule_category": "product_category",
    "statutory_reference": "regulation",
    "target_parameter": "field_name",
    "compliance_condition": "explanation",
    "violation_condition": "error_message",
}


def latest_change(changes: DataFrame, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """One change per key: the last one by ``order`` (an aggregate, no window).

    Without an order, or between changes that tie, the greatest row counts, so
    that the result does not depend on the order of reading.
    """
    keys = [key] if isinstance(key, str) else list(key)
    row = F.struct(*[F.col(c) for c in changes.columns])
    plain = [c for c, kind in changes.dtypes if not kind.startswith("map")]
    rank = F.struct(*[F.col(c) for c in ([order] if order else []) + plain])
    return changes.groupBy(*keys).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def _old(df: DataFrame, name: str, kind: str) -> Column:
    """A column of the ledger, null if the ledger has none of the name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def usable_overrides(overrides: DataFrame, order: str | None = None) -> DataFrame:
    """The last override of each inspection among those with a reason."""
    return latest_change(overrides.where(F.trim(text("note")) != ""), "inspection_id", order)


def rule_upsert(base: DataFrame, incoming: DataFrame, now: datetime, key: str = "rule_id") -> DataFrame:
    """Updates the given columns, inserts new rows, syncs the legacy columns."""
    given = [c for c in incoming.columns if c != key and c in base.columns]
    right = incoming.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = base.join(right, base[key] == right["_key"], "full_outer")
    changed = F.col("_key").isNotNull()
    columns = {key: F.coalesce(F.col(key), F.col("_key"))}
    for name in base.columns:
        if name in given:
            columns[name] = F.coalesce(F.col(f"_new_{name}"), F.col(name))
        elif name != key:
            columns[name] = F.col(name)
    for legacy, source in LEGACY_COLUMNS.items():
        if legacy in base.columns and source in columns:
            columns[legacy] = F.when(changed, F.coalesce(columns[source], F.col(legacy))).otherwise(F.col(legacy))
    if "updated_at" in base.columns:
        columns["updated_at"] = F.when(changed, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    action = F.when(F.col("_key").isNull(), "KEEP").when(F.col(key).isNull(), "INSERT").otherwise("UPDATE")
    return joined.select(*[columns[c].alias(c) for c in base.columns], action.alias("action"))


def upsert_split(base: DataFrame, incoming: DataFrame, key: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    keys = base.select(key)
    return incoming.join(keys, key, "left_semi"), incoming.join(keys, key, "left_anti")


def rule_delete(rules: DataFrame, doomed: DataFrame, key: str = "rule_id") -> DataFrame:
    return rules.join(doomed.select(key), key, "left_anti")


def version_bump(rules: DataFrame, version: str, chosen: DataFrame | None = None) -> DataFrame:
    """New version on the chosen rules (all if none are named); adds ``bumped``."""
    if chosen is None:
        return rules.withColumn("version", F.lit(version)).withColumn("bumped", F.lit(True))
    marks = chosen.select("rule_id").distinct().withColumn("_hit", F.lit(True))
    joined = rules.join(marks, "rule_id", "left").withColumn("bumped", F.coalesce("_hit", F.lit(False)))
    return joined.withColumn("version", F.when(F.col("bumped"), version).otherwise(F.col("version"))).drop("_hit")


def officer_sign_off(insp: DataFrame, decisions: DataFrame, now: datetime, order: str | None = None) -> DataFrame:
    """Sets decision, comments, officer, time and status where one was made; the last decision by ``order`` counts."""
    d = latest_change(decisions, "inspection_id", order).select(
        F.col("inspection_id").alias("_id"), F.col("decision").alias("_decision"), F.col("comments").alias("_comments"),
        F.col("officer_id").alias("_officer"),
    )
    joined = insp.join(d, F.col("inspection_id") == F.col("_id"), "left")
    signed = F.col("_id").isNotNull()
    decision = F.coalesce("_decision", F.lit("7A COMPLIANT"))
    return joined.withColumns(
        {
            "officer_decision": F.when(signed, decision).otherwise(F.col("officer_decision")),
            "overall_status": F.when(signed, decision).otherwise(F.col("overall_status")),
            "officer_id": F.when(signed, F.col("_officer")).otherwise(F.col("officer_id")),
            "officer_comments": F.when(signed, F.coalesce("_comments", F.lit("Officer confirmed"))).otherwise(
                _old(insp, "officer_comments", "string")),
            "verified_at": F.when(signed, F.lit(now).cast("timestamp_ntz")).otherwise(_old(insp, "verified_at", "timestamp_ntz")),
        }
    ).drop("_id", "_decision", "_comments", "_officer")


def normal_verdict(raw: Column) -> Column:
    """Any text with COMPLIANT in it counts as compliant, NON-COMPLIANT too."""
    upper = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return (
        F.when(upper.contains("7A") | upper.contains("COMPLIANT"), "7A COMPLIANT")
        .when(upper.contains("7B") | upper.contains("VIOLATION"), "7B VIOLATION")
        .when(upper == "", "7A COMPLIANT")
        .otherwise(upper)
    )


def override_apply(insp: DataFrame, overrides: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Applies officer overrides to the ledger; unjustified or unknown ones are rejected.

    Of several overrides of an inspection the last by ``order`` counts.

    ``overrides``: inspection_id, verdict, note, officer_id, and the maps
    declarations (field -> value) and rule_statuses (rule -> status).
    """
    right = usable_overrides(overrides, order).select(
        F.col("inspection_id").alias("_id"), normal_verdict(F.col("verdict")).alias("_verdict"), F.trim("note").alias("_note"),
        F.col("officer_id").alias("_officer"),
    )
    joined = insp.join(right, F.col("inspection_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    old = F.coalesce(F.nullif("officer_decision", F.lit("")), F.nullif("overall_status", F.lit("")), F.lit("PENDING"))
    routed = F.when(F.col("_verdict") == "7A COMPLIANT", False).when(F.col("_verdict") == "7B VIOLATION", True)
    applied = joined.withColumn("previous_verdict", F.when(hit, old)).withColumns(
        {
            "overall_status": F.when(hit, F.col("_verdict")).otherwise(F.col("overall_status")),
            "officer_decision": F.when(hit, F.col("_verdict")).otherwise(F.col("officer_decision")),
            "officer_id": F.when(hit, F.col("_officer")).otherwise(F.col("officer_id")),
            "route_7b_triggered": F.when(hit, F.coalesce(routed, F.col("route_7b_triggered"))).otherwise(F.col("route_7b_triggered")),
            "officer_comments": F.when(hit, F.col("_note")).otherwise(_old(insp, "officer_comments", "string")),
            "overridden": hit,
        }
    )
    known = overrides.join(insp.select("inspection_id"), "inspection_id", "left_anti").withColumn("reason", F.lit("unknown inspection"))
    silent = overrides.where(F.trim(text("note")) == "").withColumn("reason", F.lit("justification is missing"))
    rejects = silent.unionByName(known.where(F.trim(text("note")) != "")).select("inspection_id", "reason")
    return applied.drop("_id", "_verdict", "_note", "_officer"), rejects


def override_declarations(decl: DataFrame, overrides: DataFrame, order: str | None = None) -> DataFrame:
    """Declarations with the officer's values put in, full confidence."""
    entered = usable_overrides(overrides, order).select(
        "inspection_id", F.explode("declarations").alias("field_name", "_value")
    )
    joined = decl.join(entered, ["inspection_id", "field_name"], "full_outer")
    manual = F.col("_value").isNotNull()
    return joined.withColumns(
        {
            "previous_value": F.when(manual, F.col("value")),
            "value": F.coalesce("_value", "value"),
            "confidence": F.when(manual, 100.0).otherwise(F.col("confidence")),
            "source": F.when(manual, "MANUAL_REVIEWER_OVERRIDE"),
        }
    ).drop("_value")


def override_checks(checks: DataFrame, overrides: DataFrame, order: str | None = None) -> DataFrame:
    """Rule statuses set by the officer; an unknown rule becomes a new check."""
    entered = usable_overrides(overrides, order).select(
        F.col("inspection_id").alias("_id"), F.explode("rule_statuses").alias("_rule", "_status")
    )
    good = F.upper(F.trim("_status")).isin(C.COMPLIANT_WORDS)
    joined = checks.join(
        entered, (F.col("inspection_id") == F.col("_id")) & ((F.col("rule_id") == F.col("_rule"))), "full_outer"
    )
    manual = F.col("_rule").isNotNull()
    new = F.when(good, "COMPLIANT").otherwise("VIOLATION")
    old = F.when(F.col("rule_id").isNull(), "UNKNOWN").when(F.col("status").isin("PASS", "COMPLIANT"), "COMPLIANT").otherwise("VIOLATION")
    return joined.select(
        F.coalesce("inspection_id", "_id").alias("inspection_id"),
        F.coalesce("rule_id", "_rule").alias("rule_id"),
        F.when(manual, old).alias("previous_status"),
        F.when(manual, new).otherwise(F.col("status")).alias("status"),
        manual.alias("overridden"),
    )


def override_violations(violations: DataFrame, checks: DataFrame, overrides: DataFrame, order: str | None = None) -> DataFrame:
    """(inspection_id, rule_id) of the violations that stay after the overrides.

    A verdict of compliance clears them; if single rules were set too, the
    checks that still fail are the violations. Other verdicts leave them.
    """
    cleared = usable_overrides(overrides, order).where(normal_verdict(F.col("verdict")) == "7A COMPLIANT")
    some = cleared.where(F.coalesce(F.size("rule_statuses"), F.lit(0)) > 0).select("inspection_id")
    failing = override_checks(checks, overrides, order).where(~F.coalesce(F.col("status").isin("PASS", "COMPLIANT"), F.lit(False)))
    kept = violations.join(cleared.select("inspection_id"), "inspection_id", "left_anti").select("inspection_id", "rule_id")
    return kept.unionByName(failing.join(some, "inspection_id", "left_semi").select("inspection_id", "rule_id"))


def _as_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value).cast("string"))))
    return rows.groupBy("inspection_id").agg(F.map_from_entries(pairs).alias(name))


def override_amendments(
    insp: DataFrame, decl: DataFrame, checks: DataFrame, violations: DataFrame, overrides: DataFrame, now: datetime,
    order: str | None = None,
) -> DataFrame:
    """One amendment row per applied override, with the states before and after and what differs, as JSON.

    ``decl`` (inspection_id, field_name, value) and ``checks`` (inspection_id,
    rule_id, status) have each key once.
    """
    applied = override_apply(insp, overrides, order)[0].where("overridden")
    last = usable_overrides(overrides, order).select("inspection_id", F.trim("note").alias("note"))
    before_route = insp.select("inspection_id", F.col("route_7b_triggered").alias("_route"))
    new_decl = override_declarations(decl, overrides, order)
    new_checks = override_checks(checks, overrides, order)
    rules = lambda df: df.groupBy("inspection_id").agg(F.array_sort(F.collect_list("rule_id")).alias("_list"))
    rows = applied.join(last, "inspection_id").join(before_route, "inspection_id")
    for part, name in (
        (_as_map(decl, "field_name", "value", "_d0"), "_d0"), (_as_map(new_decl, "field_name", "value", "_d1"), "_d1"),
        (_as_map(checks, "rule_id", "status", "_c0"), "_c0"), (_as_map(new_checks, "rule_id", "status", "_c1"), "_c1"),
        (rules(violations).withColumnRenamed("_list", "_v0"), "_v0"),
        (rules(override_violations(violations, checks, overrides, order)).withColumnRenamed("_list", "_v1"), "_v1"),
    ):
        rows = rows.join(part, "inspection_id", "left")
    changed = new_checks.where("overridden").select(
        "inspection_id", "rule_id", F.struct(F.col("previous_status").alias("from"), F.col("status").alias("to")).alias("d"))
    rows = rows.join(
        changed.groupBy("inspection_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "d")))).alias("_rules")),
        "inspection_id", "left")
    none = F.create_map().cast("map<string,string>")
    state = lambda verdict, n, route: F.to_json(F.struct(
        F.col(verdict).alias("verdict"), F.coalesce(f"_d{n}", none).alias("declarations"), F.coalesce(f"_c{n}", none).alias("checks"),
        F.coalesce(f"_v{n}", F.array().cast("array<string>")).alias("violations"), F.col(route).alias("route_7b_triggered")))
    diff = F.to_json(F.struct(
        F.struct(F.col("previous_verdict").alias("from"), F.col("overall_status").alias("to")).alias("verdict"),
        map_diff(F.coalesce("_d0", none), F.coalesce("_d1", none)).alias("modified_declarations"),
        F.col("_rules").alias("modified_rules"), F.col("note").alias("justification")))
    return rows.select(
        "inspection_id", F.col("officer_id").alias("amended_by"), "previous_verdict", F.col("overall_status").alias("new_verdict"),
        F.col("note").alias("justification_note"), state("previous_verdict", 0, "_route").alias("previous_state"),
        state("overall_status", 1, "route_7b_triggered").alias("updated_state"), diff.alias("diff_summary"),
        F.lit(now).cast("timestamp_ntz").alias("amended_at"))


def map_diff(before: Column, after: Column) -> Column:
    """Entries of two maps that differ, as {key: (from, to)}."""
    both = F.map_zip_with(
        before, after, lambda k, a, b: F.struct(a.alias("from"), b.alias("to"))
    )
    return F.map_filter(both, lambda k, v: ~v["from"].eqNullSafe(v["to"]))


def override_notice(amend: DataFrame) -> DataFrame:
    """Alert when the verdict flips between compliant and violation."""
    old, new = F.coalesce("previous_verdict", F.lit("")), F.col("new_verdict")
    flips = (old.contains("VIOLATION") & new.contains("COMPLIANT")) | (old.contains("COMPLIANT") & new.contains("VIOLATION"))
    return amend.withColumn("severity", F.when(flips, "ALERT").otherwise("WARNING")).withColumn(
        "message",
        F.concat(F.lit("Inspection "), F.col("inspection_id"), F.lit(": '"), old, F.lit("' -> '"), new, F.lit("'")),
    )


def mark_read(notifications: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    if ids is None:
        return notifications.withColumn("is_read", F.lit(True))
    marks = ids.select("notification_id").distinct().withColumn("_hit", F.lit(True))
    joined = notifications.join(marks, "notification_id", "left")
    return joined.withColumn("is_read", F.col("is_read") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def role_change(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid changes with old and new role, and the rejected ones with a reason."""
    joined = changes.join(users.select("user_id", F.col("role").alias("old_role")), "user_id", "left")
    reason = F.when(~F.col("role").isin(C.ROLES), "invalid role").when(F.col("old_role").isNull(), "unknown user")
    judged = joined.withColumn("reason", reason)
    return (
        judged.where("reason IS NULL").select("user_id", "old_role", F.col("role").alias("new_role")),
        judged.where("reason IS NOT NULL").select("user_id", "role", "reason"),
    )


def user_load(users: DataFrame, incoming: DataFrame, prefix: str = "USR-NEW-") -> tuple[DataFrame, DataFrame]:
    """New users: valid role, e-mail not taken (also not by an earlier row), id made up if missing."""
    first = incoming.groupBy("email").agg(F.min("row_no").alias("row_no")).withColumn("_first", F.lit(True))
    taken = users.select("email").distinct().withColumn("_taken", F.lit(True))
    judged = incoming.join(first, ["email", "row_no"], "left").join(taken, "email", "left").withColumn(
        "reason",
        F.when(~F.col("role").isin(C.ROLES), "invalid role")
        .when(F.coalesce("_taken", F.lit(False)), "e-mail exists")
        .when(F.col("_first").isNull(), "e-mail repeated"),
    ).drop("_first", "_taken")
    accepted = slices.running_position(judged.where("reason IS NULL").drop("reason"), [], [F.col("row_no")], "_n")
    made = F.concat(F.lit(prefix), F.col("_n").cast("string"))
    return (
        accepted.withColumn("user_id", F.coalesce("user_id", made)).drop("_n"),
        judged.where("reason IS NOT NULL").select("row_no", "email", "reason"),
    )


def assign_work(insp: DataFrame, users: DataFrame, work: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Puts assignees on inspections; unknown users and inspections are reported.

    An inspection can have both roles assigned; of several assignments of a
    role the last by ``order`` counts.
    """
    named = work.join(users.select("user_id", F.col("name").alias("_name")), "user_id", "left")
    exists = insp.select("inspection_id").withColumn("_known", F.lit(True))
    judged = named.join(exists, "inspection_id", "left").withColumn(
        "reason", F.when(F.col("_name").isNull(), "unknown user").when(F.col("_known").isNull(), "unknown inspection")
    )
    good = latest_change(judged.where("reason IS NULL"), ["inspection_id", "assignment_type"], order)
    who = lambda role: F.max(F.when(F.col("assignment_type") == role, F.struct("user_id", "_name")))
    roles = good.groupBy(F.col("inspection_id").alias("_id")).agg(
        who("officer_review").alias("_officer"), who("inspector_dispatch").alias("_inspector"))
    joined = insp.join(roles, F.col("inspection_id") == F.col("_id"), "left")
    result = joined.withColumns(
        {
            f"{role}_{column}": F.when(F.col(f"_{role}").isNotNull(), F.col(f"_{role}.{source}")).otherwise(F.col(f"{role}_{column}"))
            for role in ("officer", "inspector") for column, source in (("id", "user_id"), ("name", "_name"))
        }
    ).drop("_id", "_officer", "_inspector")
    return result, judged.where("reason IS NOT NULL").select("inspection_id", "user_id", "reason")


# ------------------------------------------------------------ merging of reads


def merge_declarations(decl: DataFrame, key: str = "field_name") -> DataFrame:
    """Across images the valued, then more confident declaration wins; ties keep the earlier image."""
    valued = (text("value") != "").cast("int")
    rank = F.struct((-valued).alias("v"), F.when(valued == 1, -F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).alias("c"), F.col("image_index"))
    row = F.struct(*[F.col(c) for c in decl.columns])
    return decl.groupBy("inspection_id", key).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def merge_dates(dates: DataFrame) -> DataFrame:
    rank = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("image_index"))
    row = F.struct(*[F.col(c) for c in dates.columns])
    return dates.groupBy("inspection_id", "type").agg(F.min_by(row, rank).alias("_row")).select("_row.*")
