"""Questions asked of the inspection ledger, the audit trail and the users."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmark import constants as C
from panelmark.operators import slices

VIOLATION_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("rule_id", T.StringType()),
            T.StructField("target_parameter", T.StringType()),
            T.StructField("detected_issue", T.StringType()),
        ]
    )
)


def _upper_status() -> Column:
    return F.upper(F.coalesce("overall_status", F.lit("")))


def is_compliant() -> Column:
    """Loose bucket: NON-COMPLIANT counts as compliant too (it holds the word)."""
    return _upper_status().contains("7A") | _upper_status().contains("COMPLIANT")


def is_violation() -> Column:
    return _upper_status().contains("7B") | _upper_status().contains("VIOLATION")


def is_signed() -> Column:
    return F.coalesce("officer_decision", F.lit("")) != ""


def _routed() -> Column:
    return F.coalesce("route_7b_triggered", F.lit(False))


def _any_contains(columns: list[str], text: str) -> Column:
    found = F.lit(False)
    for name in columns:
        found = found | F.lower(F.coalesce(name, F.lit(""))).contains(text.lower())
    return found


def _round1(value: Column) -> Column:
    return F.round(value, 1)


# ------------------------------------------------------------------ filters


def status_flags(insp: DataFrame) -> DataFrame:
    status = F.col("overall_status")
    return insp.select(
        "inspection_id",
        status.like("%7A%").alias("is_7a"),
        status.like("%7B%").alias("is_7b"),
        (status == "PENDING").alias("is_pending"),
        _routed().alias("is_routed"),
        F.col("officer_decision").isNotNull().alias("is_signed"),
    )


def status_buckets(insp: DataFrame) -> DataFrame:
    return insp.select(
        "inspection_id",
        "overall_status",
        is_compliant().alias("in_compliant"),
        is_violation().alias("in_violation"),
    )


def search(insp: DataFrame, text: str = "", status: str = "ALL", category: str = "ALL") -> DataFrame:
    result = insp
    if text:
        columns = ["inspection_id", "product_name", "location", "inspector_name", "category"]
        result = result.where(_any_contains(columns, text))
    if status != "ALL":
        result = result.where(F.coalesce("overall_status", F.lit("")).contains(status))
    if category != "ALL":
        result = result.where(F.col("category") == category)
    return result


def _tab_tests() -> dict[str, Column]:
    status = _upper_status()
    return {
        "pending": ~is_signed() & (status.contains("7B") | (status == "PENDING") | _routed()),
        "violations": is_violation(),
        "compliant": is_compliant(),
        "signed": is_signed(),
    }


def review_tab(insp: DataFrame, tab: str) -> DataFrame:
    tests = _tab_tests()
    return insp.where(tests[tab]) if tab in tests else insp


def with_review_tabs(insp: DataFrame) -> DataFrame:
    """One row per inspection and tab it shows up in, from one scan."""
    tabs = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in _tab_tests().items()]))
    return insp.withColumn("tab", F.explode(tabs))


def dispatch(insp: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    kind = {"pending": "pending", "compliant": "compliant", "violations": "violations"}
    result = review_tab(insp, kind[status]) if status in kind else insp
    if text:
        result = result.where(_any_contains(["inspection_id", "product_name", "inspector_name"], text))
    return result


def role_scope(insp: DataFrame, role: str, user_id: str, user_name: str | None = None) -> DataFrame:
    if role != "inspector":
        return insp
    own = F.col("inspector_id") == user_id
    if user_name is not None:
        own = own | (F.col("inspector_name") == user_name)
    return insp.where(own)


def unread(notifications: DataFrame, unread_only: bool, limit: int = 50) -> DataFrame:
    shown = notifications.where(~F.col("is_read")) if unread_only else notifications
    return shown.orderBy(F.desc("created_at"), F.desc("notification_id")).limit(limit)


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count_if(~F.col("is_read")).alias("unread_count"))


def audit_search(audit: DataFrame, group: str = "ALL", text: str = "") -> DataFrame:
    result = audit
    if group in C.AUDIT_GROUPS:
        result = result.where(F.col("action").isin(C.AUDIT_GROUPS[group]))
    if text:
        result = result.where(_any_contains(["user_id", "action", "details"], text))
    return result


def drop_pseudo_rules(checks: DataFrame, column: str = "rule_id") -> DataFrame:
    pseudo = F.col(column).isNull()
    for prefix in C.PSEUDO_RULE_PREFIXES:
        pseudo = pseudo | F.col(column).startswith(prefix)
    return checks.where(~pseudo)


LEDGER_COLUMNS = [
    "inspection_id", "product_name", "category", "location", "inspector_id", "inspector_name",
    "overall_status", "overall_confidence", "route_7b_triggered", "officer_decision",
    "created_at",
]


def ledger_list(insp: DataFrame) -> DataFrame:
    """The list view, newest first (a distributed range sort)."""
    present = [c for c in LEDGER_COLUMNS if c in insp.columns]
    return insp.select(*present).orderBy(F.desc("created_at"), F.desc("inspection_id"))


def rule_search(rules: DataFrame, text: str) -> DataFrame:
    target = F.coalesce("target_parameter", "field_name", F.lit(""))
    reference = F.coalesce("statutory_reference", "regulation_section", F.lit(""))
    found = F.lit(False)
    for column in (F.coalesce("rule_id", F.lit("")), target, reference):
        found = found | F.lower(column).contains(text.lower())
    return rules.where(found)


def user_search(users: DataFrame, text: str) -> DataFrame:
    return users.where(_any_contains(["name", "email", "role"], text)) if text else users


def override_search(amend: DataFrame, text: str = "", verdict: str = "ALL") -> DataFrame:
    result = amend
    if text:
        result = result.where(_any_contains(["inspection_id", "officer_id", "note"], text))
    wanted = {"TO_7A": "7A", "TO_7B": "7B"}.get(verdict)
    if wanted:
        result = result.where(F.coalesce("new_verdict", F.lit("")).contains(wanted))
    return result


def rule_list(
    rules: DataFrame,
    category: str | None = None,
    active: bool | None = None,
    regulation: str | None = None,
) -> DataFrame:
    result = rules
    if active is not None:
        result = result.where(F.col("is_active") == active)
    if category and category != "ALL":
        result = result.where(F.col("product_category").ilike(f"%{category}%"))
    if regulation:
        result = result.where(F.col("regulation").ilike(f"%{regulation}%"))
    return result.orderBy("rule_id")


def is_bypassed() -> Column:
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    reason = F.lower(F.coalesce("reason", F.lit("")))
    by_reason = reason.contains("bypassed") | reason.contains("optional declaration not detected")
    return status.isin("NOT_APPLICABLE", "BYPASSED", "N/A", "OPTIONAL") | (
        ~F.coalesce("is_mandatory", F.lit(True)) & by_reason
    )


def check_tab(checks: DataFrame, tab: str) -> DataFrame:
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    review = status.isin("NEEDS_REVIEW", "NEEDS REVIEW", "CANNOT_VERIFY", "REVIEW")
    tests = {
        "fail": (status == "FAIL") & ~is_bypassed(),
        "pass": (status == "PASS") & ~is_bypassed(),
        "review": review & ~is_bypassed(),
        "na": is_bypassed(),
    }
    return checks.where(tests[tab]) if tab in tests else checks


def with_check_tab(checks: DataFrame) -> DataFrame:
    """Names the tab of each check in one pass."""
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    review = status.isin("NEEDS_REVIEW", "NEEDS REVIEW", "CANNOT_VERIFY", "REVIEW")
    tab = (
        F.when(is_bypassed(), "na")
        .when(status == "FAIL", "fail")
        .when(status == "PASS", "pass")
        .when(review, "review")
        .otherwise("all")
    )
    return checks.withColumn("tab", tab)


def verified_rules(rules_raw: DataFrame) -> DataFrame:
    return rules_raw.where(F.col("verification_status") == "VERIFIED_FROM_SOURCE")


# --------------------------------------------------------------- aggregates


def kpi_overview(insp: DataFrame) -> DataFrame:
    """All dashboard numbers in one pass over the ledger."""
    status = F.col("overall_status")
    is_7b = status.like("%7B%")
    waiting = ((status == "PENDING") | _routed() | is_7b) & F.col("officer_decision").isNull()
    counts = insp.agg(
        F.count("*").alias("total"),
        F.count_if(status.like("%7A%")).alias("compliant"),
        F.count_if(is_7b).alias("violations"),
        F.count_if(status == "PENDING").alias("pending"),
        F.count_if(_routed()).alias("routed"),
        F.count_if(F.col("officer_decision").isNotNull()).alias("signed"),
        F.count_if(waiting).alias("queue"),
    )
    rate = F.col("compliant") / F.greatest("total", F.lit(1)) * 100.0
    return counts.select(
        "total",
        "compliant",
        "violations",
        F.when(F.col("queue") > 0, F.col("queue")).otherwise(F.col("pending")).alias("pending_review"),
        _round1(rate).alias("compliance_rate"),
        "routed",
        "signed",
    )


def category_breakdown(insp: DataFrame) -> DataFrame:
    category = F.when(F.coalesce("category", F.lit("")) == "", "Uncategorized").otherwise(
        F.col("category")
    )
    return insp.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def explode_violations(insp: DataFrame, column: str = "violations_json") -> DataFrame:
    parsed = F.from_json(column, VIOLATION_SCHEMA)
    return insp.select("inspection_id", F.posexplode(parsed).alias("position", "violation")).select(
        "inspection_id", "position", "violation.*"
    )


def top_violations(violations: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """Most frequent rules; the label is the first one seen in ``order``."""
    rule = F.coalesce("rule_id", F.lit("UNKNOWN"))
    label = F.coalesce("target_parameter", "detected_issue", rule)
    return (
        violations.groupBy(rule.alias("rule_id"))
        .agg(F.min_by(label, F.struct(*order)).alias("name"), F.count("*").alias("n"))
        .orderBy(F.desc("n"), "rule_id")
        .limit(k)
    )


def admin_summary(insp: DataFrame) -> DataFrame:
    status = _upper_status()
    pending = ~is_signed() & (status.isin("PENDING", "7B VIOLATION") | _routed())
    counts = insp.agg(
        F.count("*").alias("total_scans"),
        F.count_if(pending).alias("pending_review"),
        F.count_if(is_compliant()).alias("compliant"),
        F.count_if(is_violation()).alias("violations"),
        F.count_if(is_signed()).alias("signed_off"),
    )
    rate = F.try_divide(F.col("compliant") * 100.0, F.col("total_scans"))
    return counts.withColumn("compliance_rate", F.coalesce(_round1(rate), F.lit(0.0)))


def inspector_workload(insp: DataFrame) -> DataFrame:
    who = F.coalesce(F.nullif("inspector_id", F.lit("")), F.lit("unknown"))
    name = F.coalesce(F.nullif("inspector_name", F.lit("")), who)
    return insp.groupBy(who.alias("inspector_id")).agg(
        F.min_by(name, F.struct("created_at", "inspection_id")).alias("name"),
        F.count("*").alias("total"),
        F.count_if(~is_signed()).alias("pending"),
    )


def officer_workload(insp: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("officer_name", F.lit("")), F.col("officer_id"))
    assigned = insp.where(F.coalesce("officer_id", F.lit("")) != "")
    return assigned.groupBy("officer_id").agg(
        F.min_by(name, F.struct("created_at", "inspection_id")).alias("name"),
        F.count("*").alias("assigned"),
        F.count_if(is_signed()).alias("signed"),
    )


def users_by_role(users: DataFrame) -> DataFrame:
    return users.groupBy("role").agg(F.count("*").alias("n"))


def override_stats(amend: DataFrame) -> DataFrame:
    verdict = F.coalesce("new_verdict", F.lit(""))
    return amend.agg(
        F.count_if(verdict.contains("7A")).alias("to_7a"),
        F.count_if(verdict.contains("7B")).alias("to_7b"),
        F.count_distinct("officer_id").alias("officers"),
    )


def registry_metrics(insp: DataFrame) -> DataFrame:
    status = F.coalesce("overall_status", F.lit(""))
    good = status.contains("7A") | status.contains("COMPLIANT")
    bad = status.contains("7B") | status.contains("VIOLATION")
    counts = insp.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("compliant"),
        F.count_if(bad).alias("violations"),
    )
    return counts.withColumn("pending", F.expr("total - compliant - violations"))


def role_report_stats(insp: DataFrame, role: str, user_id: str, user_name: str | None = None) -> DataFrame:
    own = role_scope(insp, role, user_id, user_name)
    counts = own.agg(
        F.count("*").alias("total"),
        F.count_if(is_compliant()).alias("compliant"),
        F.count_if(is_violation()).alias("violations"),
        F.count_if(~is_signed() & (_upper_status() == "PENDING")).alias("pending"),
    )
    rate = F.try_divide(F.col("compliant") * 100.0, F.col("total"))
    return counts.withColumn("compliance_rate", F.coalesce(_round1(rate), F.lit(0.0)))


def dashboard_counts(insp: DataFrame) -> DataFrame:
    status = F.coalesce("overall_status", F.lit(""))
    return insp.agg(
        F.count("*").alias("total"),
        F.count_if(status.contains("7A") | status.contains("COMPLIANT")).alias("compliant"),
        F.count_if(status.contains("7B") | status.contains("VIOLATION")).alias("issues"),
        F.count_if(status.contains("PENDING")).alias("pending"),
    )


def newest(df: DataFrame, time: str, unique: str, n: int) -> DataFrame:
    """Newest ``n`` rows: each task keeps only its own top ``n``."""
    return df.orderBy(F.desc(time), F.desc(unique)).limit(n)


def pending_queue(insp: DataFrame) -> DataFrame:
    status = _upper_status()
    waiting = (status == "PENDING") | is_violation() | _routed()
    return insp.where(~is_signed() & waiting)


def pending_categories(insp: DataFrame) -> DataFrame:
    queue = pending_queue(insp).where(F.coalesce("category", F.lit("")) != "")
    return queue.select("category").distinct()


# -------------------------------------------------------------- time & order


def _millis(column: str, now: datetime) -> Column:
    """Milliseconds from the (UTC, zone-less) column to ``now``, never negative."""
    moment = F.lit(now).cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", F.col(column).cast("timestamp_ntz"), moment)
    return F.greatest(millis, F.lit(0))


def wait_columns(df: DataFrame, column: str, now: datetime) -> DataFrame:
    minutes = F.floor(_millis(column, now) / 60000)
    df = df.withColumn("_minutes", minutes)
    hours = F.expr("_minutes DIV 60")
    days = F.expr("_minutes DIV 1440")
    text = (
        F.when(F.col(column).isNull(), "< 1m wait")
        .when(days > 0, F.concat(days, F.lit("d "), F.expr("(_minutes DIV 60) % 24"), F.lit("h wait")))
        .when(hours > 0, F.concat(hours, F.lit("h "), F.expr("_minutes % 60"), F.lit("m wait")))
        .when(F.col("_minutes") > 0, F.concat(F.col("_minutes"), F.lit("m wait")))
        .otherwise("< 1m wait")
    )
    return (
        df.withColumn("wait_text", text)
        .withColumn("is_urgent", F.coalesce(hours >= 24, F.lit(False)))
        .drop("_minutes")
    )


def review_fifo(insp: DataFrame, now: datetime) -> DataFrame:
    """The whole review queue, oldest first, with each row's place in it."""
    queue = pending_queue(insp)
    placed = slices.running_position(
        queue, [], [F.col("created_at").asc_nulls_first(), F.col("inspection_id")], "position"
    )
    return wait_columns(placed, "created_at", now)


def relative_time(df: DataFrame, column: str, now: datetime, name: str = "ago") -> DataFrame:
    moment = F.lit(now).cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", F.col(column).cast("timestamp_ntz"), moment)
    df = df.withColumn("_m", F.floor(millis / 60000))
    text = (
        F.when(F.col(column).isNull(), "—")
        .when(F.col("_m") < 1, "just now")
        .when(F.col("_m") < 60, F.concat(F.col("_m"), F.lit("m ago")))
        .when(F.col("_m") < 1440, F.concat(F.expr("_m DIV 60"), F.lit("h ago")))
        .otherwise(F.concat(F.expr("_m DIV 1440"), F.lit("d ago")))
    )
    return df.withColumn(name, text).drop("_m")


def verdict_history(amend: DataFrame) -> DataFrame:
    """Each amendment next to the verdict it replaced."""
    order = [F.col("amended_at"), F.col("amendment_id")]
    chained = slices.previous_value(
        amend,
        ["inspection_id"],
        order,
        {"new_verdict": "previous_verdict", "amended_at": "_previous_at"},
    )
    seconds = F.timestamp_diff("SECOND", F.col("_previous_at"), F.col("amended_at"))
    return (
        chained.withColumn("changed", ~F.col("new_verdict").eqNullSafe(F.col("previous_verdict")))
        .withColumn("seconds_since_last", seconds)
        .drop("_previous_at")
    )


_FRAME_ORDER = ["event_time", "event_id"]


def _motion() -> Column:
    return F.coalesce(F.abs(F.col("metric") - F.col("_before")), F.lit(0.0))


def frame_motion(frames: DataFrame) -> DataFrame:
    moved = slices.previous_value(frames, ["user_id"], [F.col(c) for c in _FRAME_ORDER], {"metric": "_before"})
    return moved.withColumn("delta", _motion()).drop("_before")


def stable_frames(frames: DataFrame) -> DataFrame:
    """Length of each device's run of sharp, still frames, and its progress; frames are sorted once."""
    steady = (F.col("metric") >= C.MIN_SHARPNESS) & (F.col("delta") < C.MAX_MOTION)
    streaks = slices.streak_beside_previous(
        frames, ["user_id"], [F.col(c) for c in _FRAME_ORDER], {"metric": "_before"}, {"delta": _motion(), "steady": steady}, "steady", "streak"
    ).drop("_before")
    percent = F.when(F.col("streak") >= 2, 100).when(F.col("streak") == 1, 50).otherwise(25)
    return streaks.withColumn("percent", percent).withColumn("capture", F.col("streak") >= 2)


def beside(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """A page of rows with a one-row summary next to each of them."""
    one = totals.withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


# ------------------------------------------------------------ sorts & pages


def latest_or_id(insp: DataFrame, wanted: str) -> DataFrame:
    if wanted == "latest":
        return newest(insp, "created_at", "inspection_id", 1)
    return insp.where(F.col("inspection_id") == wanted)


def page_slice(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page; only ``page * size`` rows ever reach the final merge."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    pages = F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("long")
    return df.agg(pages.alias("total_pages"))


def paint_order(checks: DataFrame, unique: list[str]) -> DataFrame:
    status = F.upper(F.coalesce("status", F.lit("")))
    layer = (
        F.when(status.isin("FAIL", "NON_COMPLIANT", "NON-COMPLIANT"), 3)
        .when(status.isin("PASS", "COMPLIANT"), 1)
        .otherwise(2)
    )
    return checks.withColumn("layer", layer).orderBy("layer", *unique)


def first_rule_version(rules: DataFrame, default: str = "v2.1") -> DataFrame:
    first = F.min_by("version", F.struct("rule_id", "version"))
    return rules.agg(F.coalesce(first, F.lit(default)).alias("engine_version"))


# ----------------------------------------------------------------- by id


def session_by_id(sessions: DataFrame, scan_id: str) -> DataFrame:
    def urls(name: str) -> Column:
        text = F.coalesce(name, F.lit(""))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))

    return sessions.where(F.col("session_id") == scan_id).withColumns(
        {
            "original_urls": urls("original_image_url"),
            "processed_urls": urls("processed_image_url"),
        }
    )


def export_rows(insp: DataFrame, scope: str = "all") -> DataFrame:
    """The eleven export columns as text."""
    rows = insp
    if scope == "violations":
        rows = insp.where(_upper_status().contains("7B"))
    elif scope == "pending":
        rows = insp.where(~is_signed())

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return rows.select(
        text("inspection_id").alias("Inspection ID"),
        text("product_name").alias("Product Name"),
        text("category").alias("Category"),
        text("location").alias("Location"),
        text("inspector_name").alias("Inspector Name"),
        text("overall_status").alias("Status"),
        text("overall_confidence").alias("Compliance %"),
        F.when(_routed(), "YES").otherwise("NO").alias("Route 7B"),
        text("officer_decision").alias("Officer Decision"),
        text("officer_name").alias("Officer Name"),
        F.date_format("created_at", "dd/MM/yyyy").alias("Scan Date"),
    )
