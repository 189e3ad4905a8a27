"""Ledger, audit and user queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from panelmark import fixtures as fx
from panelmark.operators import ledger
from panelmark.queries.registry import query

NOW = datetime(1999, 6, 1, 12, 0, 0)
NOW_SQL = "timestamp '1999-06-01 12:00:00'"

_UP = "upper(coalesce(overall_status, ''))"
_GOOD = f"({_UP} LIKE '%7A%' OR {_UP} LIKE '%COMPLIANT%')"
_BAD = f"({_UP} LIKE '%7B%' OR {_UP} LIKE '%VIOLATION%')"
_SIGNED = "(coalesce(officer_decision, '') <> '')"
_QUEUE = f"(NOT {_SIGNED} AND ({_UP} = 'PENDING' OR {_BAD} OR route_7b_triggered))"

query("status_like_filters", """
SELECT inspection_id, overall_status LIKE '%7A%' AS is_7a, overall_status LIKE '%7B%' AS is_7b,
       overall_status = 'PENDING' AS is_pending, route_7b_triggered AS is_routed,
       officer_decision IS NOT NULL AS is_signed FROM fx_inspections
""")(lambda spark, sf: ledger.status_flags(fx.inspections(spark, sf)))

query("status_buckets", f"""
SELECT inspection_id, overall_status, {_GOOD} AS in_compliant, {_BAD} AS in_violation
FROM fx_inspections
""")(lambda spark, sf: ledger.status_buckets(fx.inspections(spark, sf)))

query("ledger_search", """
SELECT inspection_id, product_name, category, overall_status FROM fx_inspections
WHERE (lower(inspection_id) LIKE '%item 1%' OR lower(product_name) LIKE '%item 1%'
       OR lower(location) LIKE '%item 1%' OR lower(inspector_name) LIKE '%item 1%'
       OR lower(category) LIKE '%item 1%')
  AND overall_status LIKE '%7B%' AND category = 'MACHINERY'
""")(lambda spark, sf: ledger.search(fx.inspections(spark, sf), "item 1", "7B", "MACHINERY")
     .select("inspection_id", "product_name", "category", "overall_status"))

@query("review_tabs", f"""
SELECT 'pending' AS tab, inspection_id FROM fx_inspections
WHERE NOT {_SIGNED} AND ({_UP} LIKE '%7B%' OR {_UP} = 'PENDING' OR route_7b_triggered)
UNION ALL SELECT 'violations', inspection_id FROM fx_inspections WHERE {_BAD}
UNION ALL SELECT 'compliant', inspection_id FROM fx_inspections WHERE {_GOOD}
UNION ALL SELECT 'signed', inspection_id FROM fx_inspections WHERE {_SIGNED}
""")
def _review_tabs(spark, sf):
    return ledger.with_review_tabs(fx.inspections(spark, sf)).select("tab", "inspection_id")


query("dispatch_filter", f"""
SELECT inspection_id, product_name, overall_status FROM fx_inspections
WHERE {_BAD} AND (lower(inspection_id) LIKE '%inspector 7%' OR lower(product_name) LIKE '%inspector 7%'
                  OR lower(inspector_name) LIKE '%inspector 7%')
""")(lambda spark, sf: ledger.dispatch(fx.inspections(spark, sf), "violations", "inspector 7")
     .select("inspection_id", "product_name", "overall_status"))

query("role_scope", """
SELECT inspection_id, inspector_id FROM fx_inspections
WHERE inspector_id = 'USR-3' OR inspector_name = 'Inspector 4'
""")(lambda spark, sf: ledger.role_scope(fx.inspections(spark, sf), "inspector", "USR-3", "Inspector 4")
     .select("inspection_id", "inspector_id"))

@query("unread_notifications", """
SELECT n.notification_id, n.created_at, n.severity, u.unread_count FROM
 (SELECT * FROM fx_notifications WHERE NOT is_read
  ORDER BY created_at DESC, notification_id DESC LIMIT 50) n
CROSS JOIN (SELECT count(*) AS unread_count FROM fx_notifications WHERE NOT is_read) u
""")
def _unread(spark, sf):
    notifications = fx.notifications(spark, sf)
    newest = ledger.unread(notifications, True).select("notification_id", "created_at", "severity")
    return ledger.beside(newest, ledger.unread_count(notifications))


query("audit_search", """
SELECT event_id, action, user_id FROM fx_audit
WHERE action IN ('CREATE_USER', 'UPDATE_USER_ROLE')
  AND (lower(user_id) LIKE '%k": 1%' OR lower(action) LIKE '%k": 1%' OR lower(details) LIKE '%k": 1%')
""")(lambda spark, sf: ledger.audit_search(fx.audit(spark, sf), "USERS", 'k": 1')
     .select("event_id", "action", "user_id"))

query("drop_pseudo_rules", """
SELECT rule_id, source_rank FROM fx_rules_raw
WHERE NOT (starts_with(rule_id, 'DECL-') OR starts_with(rule_id, 'VIS-')
           OR starts_with(rule_id, 'OCR-DET-') OR starts_with(rule_id, 'rule_'))
""")(lambda spark, sf: ledger.drop_pseudo_rules(fx.rules_raw(spark, sf)).select("rule_id", "source_rank"))

_LIST = """
SELECT inspection_id, product_name, category, location, inspector_id, inspector_name, overall_status,
       overall_confidence, route_7b_triggered, officer_decision, created_at FROM fx_inspections
"""
query("ledger_projection", _LIST)(lambda spark, sf: ledger.ledger_list(fx.inspections(spark, sf)))
query("newest_first", "SELECT inspection_id, created_at FROM fx_inspections")(
    lambda spark, sf: ledger.ledger_list(fx.inspections(spark, sf)).select("inspection_id", "created_at")
)

query("user_search", """
SELECT user_id, name, role FROM fx_users
WHERE lower(name) LIKE '%officer%' OR lower(email) LIKE '%officer%' OR lower(role) LIKE '%officer%'
""")(lambda spark, sf: ledger.user_search(fx.users(spark, sf), "officer").select("user_id", "name", "role"))

query("override_search", """
SELECT amendment_id, inspection_id, new_verdict FROM fx_amendments
WHERE (lower(inspection_id) LIKE '%urgent%' OR lower(officer_id) LIKE '%urgent%'
       OR lower(note) LIKE '%urgent%') AND new_verdict LIKE '%7A%'
""")(lambda spark, sf: ledger.override_search(fx.amendments(spark, sf), "URGENT", "TO_7A")
     .select("amendment_id", "inspection_id", "new_verdict"))

_BYPASS = """(status IN ('NOT_APPLICABLE', 'BYPASSED', 'N/A', 'OPTIONAL')
  OR (NOT is_mandatory AND (lower(reason) LIKE '%bypassed%'
      OR lower(reason) LIKE '%optional declaration not detected%')))"""
query("check_tabs", f"""
SELECT inspection_id, rule_id, line_no,
  CASE WHEN {_BYPASS} THEN 'na' WHEN status = 'FAIL' THEN 'fail' WHEN status = 'PASS' THEN 'pass'
       WHEN status = 'NEEDS_REVIEW' THEN 'review' ELSE 'all' END AS tab FROM fx_checks
""")(lambda spark, sf: ledger.with_check_tab(fx.checks(spark, sf))
     .select("inspection_id", "rule_id", "line_no", "tab"))

query("verified_rules", """
SELECT rule_id, source_rank, severity FROM fx_rules_raw
WHERE verification_status = 'VERIFIED_FROM_SOURCE'
""")(lambda spark, sf: ledger.verified_rules(fx.rules_raw(spark, sf))
     .select("rule_id", "source_rank", "severity"))

query("kpi_overview", """
SELECT total, compliant, violations, CASE WHEN queue > 0 THEN queue ELSE pending END AS pending_review,
       round(compliant / greatest(total, 1) * 100.0, 1) AS compliance_rate, routed, signed FROM (
SELECT count(*) AS total, count(*) FILTER (overall_status LIKE '%7A%') AS compliant,
       count(*) FILTER (overall_status LIKE '%7B%') AS violations,
       count(*) FILTER (overall_status = 'PENDING') AS pending,
       count(*) FILTER (route_7b_triggered) AS routed,
       count(officer_decision) AS signed,
       count(*) FILTER (officer_decision IS NULL AND (overall_status = 'PENDING'
             OR route_7b_triggered OR overall_status LIKE '%7B%')) AS queue FROM fx_inspections) t
""")(lambda spark, sf: ledger.kpi_overview(fx.inspections(spark, sf)))

query("category_breakdown", """
SELECT CASE WHEN coalesce(category, '') = '' THEN 'Uncategorized' ELSE category END AS category,
       count(*) AS n FROM fx_inspections GROUP BY 1
""")(lambda spark, sf: ledger.category_breakdown(fx.inspections(spark, sf)))


@query("top_violations", """
SELECT rule_id, arg_min(field_name, (inspection_id, line_no)) AS name, count(*) AS n
FROM fx_checks WHERE status = 'FAIL' GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5
""")
def _top_violations(spark, sf):
    found = F.struct("line_no", "rule_id", F.col("field_name").alias("target_parameter"))
    stored = fx.checks(spark, sf).where("status = 'FAIL'").groupBy("inspection_id").agg(
        F.to_json(F.array_sort(F.collect_list(found))).alias("violations_json"))
    return ledger.top_violations(ledger.explode_violations(stored), ["inspection_id", "position"])


query("admin_summary", f"""
SELECT total_scans, pending_review, compliant, violations, signed_off,
       coalesce(round(compliant * 100.0 / nullif(total_scans, 0), 1), 0.0) AS compliance_rate FROM (
SELECT count(*) AS total_scans,
       count(*) FILTER (NOT {_SIGNED} AND ({_UP} IN ('PENDING', '7B VIOLATION') OR route_7b_triggered))
         AS pending_review,
       count(*) FILTER ({_GOOD}) AS compliant, count(*) FILTER ({_BAD}) AS violations,
       count(*) FILTER ({_SIGNED}) AS signed_off FROM fx_inspections) t
""")(lambda spark, sf: ledger.admin_summary(fx.inspections(spark, sf)))

query("inspector_workload", f"""
SELECT inspector_id, arg_min(inspector_name, (created_at, inspection_id)) AS name,
       count(*) AS total, count(*) FILTER (NOT {_SIGNED}) AS pending
FROM fx_inspections GROUP BY inspector_id
""")(lambda spark, sf: ledger.inspector_workload(fx.inspections(spark, sf)))

query("officer_workload", f"""
SELECT officer_id, arg_min(officer_name, (created_at, inspection_id)) AS name,
       count(*) AS assigned, count(*) FILTER ({_SIGNED}) AS signed
FROM fx_inspections WHERE officer_id IS NOT NULL GROUP BY officer_id
""")(lambda spark, sf: ledger.officer_workload(fx.inspections(spark, sf)))

query("users_by_role", "SELECT role, count(*) AS n FROM fx_users GROUP BY role")(
    lambda spark, sf: ledger.users_by_role(fx.users(spark, sf))
)

query("override_stats", """
SELECT count(*) FILTER (new_verdict LIKE '%7A%') AS to_7a, count(*) FILTER (new_verdict LIKE '%7B%') AS to_7b,
       count(DISTINCT officer_id) AS officers FROM fx_amendments
""")(lambda spark, sf: ledger.override_stats(fx.amendments(spark, sf)))

query("registry_metrics", """
SELECT *, total - compliant - violations AS pending FROM (
SELECT count(*) AS total,
  count(*) FILTER (overall_status LIKE '%7A%' OR overall_status LIKE '%COMPLIANT%') AS compliant,
  count(*) FILTER (overall_status LIKE '%7B%' OR overall_status LIKE '%VIOLATION%') AS violations
FROM fx_inspections) t
""")(lambda spark, sf: ledger.registry_metrics(fx.inspections(spark, sf)))

query("role_report_stats", f"""
SELECT *, coalesce(round(compliant * 100.0 / nullif(total, 0), 1), 0.0) AS compliance_rate FROM (
SELECT count(*) AS total, count(*) FILTER ({_GOOD}) AS compliant, count(*) FILTER ({_BAD}) AS violations,
       count(*) FILTER (NOT {_SIGNED} AND {_UP} = 'PENDING') AS pending
FROM fx_inspections WHERE inspector_id = 'USR-3') t
""")(lambda spark, sf: ledger.role_report_stats(fx.inspections(spark, sf), "inspector", "USR-3"))

@query("inspector_dashboard", """
SELECT r.*, c.* FROM (SELECT inspection_id, overall_status, created_at FROM fx_inspections
  ORDER BY created_at DESC, inspection_id DESC LIMIT 10) r CROSS JOIN (
SELECT count(*) AS total,
  count(*) FILTER (overall_status LIKE '%7A%' OR overall_status LIKE '%COMPLIANT%') AS compliant,
  count(*) FILTER (overall_status LIKE '%7B%' OR overall_status LIKE '%VIOLATION%') AS issues,
  count(*) FILTER (overall_status LIKE '%PENDING%') AS pending FROM fx_inspections) c
""")
def _dashboard(spark, sf):
    insp = fx.inspections(spark, sf)
    last = ledger.newest(insp, "created_at", "inspection_id", 10)
    return ledger.beside(last.select("inspection_id", "overall_status", "created_at"), ledger.dashboard_counts(insp))


query("pending_categories", f"""
SELECT DISTINCT category FROM fx_inspections WHERE {_QUEUE} AND coalesce(category, '') <> ''
""")(lambda spark, sf: ledger.pending_categories(fx.inspections(spark, sf)))

query("rule_inventory", """
SELECT verification_status, validation_type, severity, count(*) AS n FROM fx_rules_raw GROUP BY ALL
""")(lambda spark, sf: fx.rules_raw(spark, sf)
     .groupBy("verification_status", "validation_type", "severity").agg(F.count("*").alias("n")))

query("review_fifo", f"""
SELECT inspection_id, position,
  CASE WHEN d > 0 THEN concat(d, 'd ', h % 24, 'h wait') WHEN h > 0 THEN concat(h, 'h ', m % 60, 'm wait')
       WHEN m > 0 THEN concat(m, 'm wait') ELSE '< 1m wait' END AS wait_text,
  h >= 24 AS is_urgent
FROM (SELECT *, m // 60 AS h, m // 1440 AS d FROM (
  SELECT inspection_id, row_number() OVER (ORDER BY created_at, inspection_id) AS position,
         greatest(date_diff('second', created_at, {NOW_SQL}), 0) // 60 AS m
  FROM fx_inspections WHERE {_QUEUE}) a) b
""")(lambda spark, sf: ledger.review_fifo(fx.inspections(spark, sf), NOW)
     .select("inspection_id", "position", "wait_text", "is_urgent"))

query("relative_time", f"""
SELECT inspection_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, 'm ago')
  WHEN m < 1440 THEN concat(m // 60, 'h ago') ELSE concat(m // 1440, 'd ago') END AS ago
FROM (SELECT inspection_id, cast(floor(date_diff('second', created_at, {NOW_SQL}) / 60.0) AS bigint) AS m
      FROM fx_inspections) t
""")(lambda spark, sf: ledger.relative_time(fx.inspections(spark, sf), "created_at", NOW)
     .select("inspection_id", "ago"))

query("verdict_history", """
SELECT inspection_id, amendment_id, new_verdict, previous_verdict,
       new_verdict IS DISTINCT FROM previous_verdict AS changed,
       date_diff('second', previous_at, amended_at) AS seconds_since_last FROM (
SELECT *, lag(new_verdict) OVER w AS previous_verdict, lag(amended_at) OVER w AS previous_at
FROM fx_amendments WINDOW w AS (PARTITION BY inspection_id ORDER BY amended_at, amendment_id)) t
""")(lambda spark, sf: ledger.verdict_history(fx.amendments(spark, sf)).select(
    "inspection_id", "amendment_id", "new_verdict", "previous_verdict", "changed", "seconds_since_last"))

_MOTION = """
SELECT event_id, event_time, user_id, metric, coalesce(abs(metric - lag(metric) OVER w), 0.0) AS delta
FROM fx_audit WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)
"""
query("frame_motion", f"SELECT event_id, user_id, round(delta, 4) AS delta FROM ({_MOTION}) t")(
    lambda spark, sf: ledger.frame_motion(fx.audit(spark, sf)).select(
        "event_id", "user_id", F.round("delta", 4).alias("delta")))

query("stable_frames", f"""
SELECT event_id, user_id, streak, CASE WHEN streak >= 2 THEN 100 WHEN streak = 1 THEN 50 ELSE 25 END
  AS percent, streak >= 2 AS capture FROM (
SELECT *, CASE WHEN steady THEN sum(CASE WHEN steady THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id, island ORDER BY event_time, event_id) ELSE 0 END::bigint AS streak FROM (
  SELECT *, sum(CASE WHEN steady THEN 0 ELSE 1 END) OVER (
    PARTITION BY user_id ORDER BY event_time, event_id) AS island FROM (
    SELECT *, metric >= 55.0 AND delta < 8.5 AS steady FROM ({_MOTION}) m) a) b) c
""")(lambda spark, sf: ledger.stable_frames(fx.audit(spark, sf)).select(
    "event_id", "user_id", "streak", "percent", "capture"))

query("audit_tail", """
SELECT event_id, event_time, user_id, action FROM fx_audit
ORDER BY event_time DESC, event_id DESC LIMIT 200
""")(lambda spark, sf: ledger.newest(fx.audit(spark, sf), "event_time", "event_id", 200)
     .select("event_id", "event_time", "user_id", "action"))

query("override_ledger", """
SELECT amendment_id, inspection_id, new_verdict, amended_at FROM fx_amendments
ORDER BY amended_at DESC, amendment_id DESC LIMIT 100
""")(lambda spark, sf: ledger.newest(fx.amendments(spark, sf), "amended_at", "amendment_id", 100)
     .select("amendment_id", "inspection_id", "new_verdict", "amended_at"))

@query("latest_or_id", """
SELECT * FROM (SELECT inspection_id, created_at FROM fx_inspections
               ORDER BY created_at DESC, inspection_id DESC LIMIT 1) a
UNION ALL SELECT inspection_id, created_at FROM fx_inspections WHERE inspection_id = 'INS-42'
""")
def _latest(spark, sf):
    insp = fx.inspections(spark, sf).select("inspection_id", "created_at")
    return ledger.latest_or_id(insp, "latest").unionByName(ledger.latest_or_id(insp, "INS-42"))


@query("page_slice", f"""
SELECT p.inspection_id, p.created_at, t.total_pages FROM
 (SELECT inspection_id, created_at FROM fx_inspections WHERE {_QUEUE}
  ORDER BY created_at, inspection_id LIMIT 10 OFFSET 20) p
CROSS JOIN (SELECT greatest(cast(ceil(count(*) / 10.0) AS bigint), 1) AS total_pages
            FROM fx_inspections WHERE {_QUEUE}) t
""")
def _page(spark, sf):
    queue = ledger.pending_queue(fx.inspections(spark, sf)).select("inspection_id", "created_at")
    page = ledger.page_slice(queue, [F.col("created_at"), F.col("inspection_id")], 3, 10)
    return ledger.beside(page, ledger.page_count(queue, 10))


query("severity_paint_order", """
SELECT inspection_id, rule_id, line_no, CASE WHEN status = 'FAIL' THEN 3 WHEN status = 'PASS' THEN 1
  ELSE 2 END AS layer FROM fx_checks
""")(lambda spark, sf: ledger.paint_order(fx.checks(spark, sf), ["inspection_id", "line_no"])
     .select("inspection_id", "rule_id", "line_no", "layer"))

query("first_rule_version", """
SELECT arg_min(version, (rule_id, version)) AS engine_version FROM fx_rules_raw
""")(lambda spark, sf: ledger.first_rule_version(fx.rules_raw(spark, sf)))

query("inspection_by_id", "SELECT * FROM fx_inspections WHERE inspection_id = 'INS-7'")(
    lambda spark, sf: ledger.latest_or_id(fx.inspections(spark, sf), "INS-7"))

@query("amendment_trail", """
SELECT a.amendment_id, a.inspection_id, a.new_verdict, a.amended_at, u.name
FROM fx_amendments a JOIN fx_users u ON concat('CASE-', substr(u.user_id, 5)) = a.inspection_id
""")
def _trail(spark, sf):
    owners = fx.users(spark, sf).selectExpr(
        "concat('CASE-', substr(user_id, 5)) AS inspection_id", "name"
    )
    return (
        fx.amendments(spark, sf)
        .join(owners, "inspection_id")
        .select("amendment_id", "inspection_id", "new_verdict", "amended_at", "name")
        .orderBy(F.desc("amended_at"), F.desc("amendment_id"))
    )


EXPORT_SQL = """
SELECT inspection_id AS "Inspection ID", product_name AS "Product Name", coalesce(category, '') AS "Category",
  coalesce(location, '') AS "Location", inspector_name AS "Inspector Name", overall_status AS "Status",
  cast(overall_confidence AS varchar) AS "Compliance %",
  CASE WHEN route_7b_triggered THEN 'YES' ELSE 'NO' END AS "Route 7B",
  coalesce(officer_decision, '') AS "Officer Decision", coalesce(officer_name, '') AS "Officer Name",
  strftime(created_at, '%d/%m/%Y') AS "Scan Date"
FROM fx_inspections
"""
query("export_csv", f"{EXPORT_SQL} WHERE upper(overall_status) LIKE '%7B%'")(lambda spark, sf: ledger.export_rows(fx.inspections(spark, sf), "violations"))
