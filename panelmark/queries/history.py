"""Lineage, change, source and sink queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark import fixtures as fx
from panelmark.operators import changes as ch
from panelmark.operators import lineage as ln
from panelmark.queries.ledger import EXPORT_SQL
from panelmark.queries.registry import EXTRA_VIEWS, query
from panelmark.queries.rules import declarations, packages
from panelmark.sources import readers, sinks

NOW = datetime(2026, 1, 15, 9, 30, 0)
NOW_SQL = "timestamp '2026-01-15 09:30:00'"

# -------------------------------------------------------------------- lineage

query("provision_tree", """
WITH RECURSIVE t AS (SELECT provision_id AS node, provision_id AS root, cast(0 AS bigint) AS depth, provision_id AS path FROM fx_provisions WHERE parent_id IS NULL
UNION ALL SELECT p.provision_id, t.root, t.depth + 1, t.path || '/' || p.provision_id FROM fx_provisions p JOIN t ON p.parent_id = t.node)
SELECT *, cast(NULL AS varchar) AS reason FROM t
""")(lambda spark, sf: ln.climb(fx.provisions(spark, sf), "provision_id", "parent_id"))


@query("amendment_chain", """
WITH RECURSIVE t AS (SELECT amendment_id AS id, amendment_id AS root, cast(0 AS bigint) AS hops FROM fx_legal_amendments WHERE supersedes_id IS NULL
UNION ALL SELECT a.amendment_id, t.root, t.hops + 1 FROM fx_legal_amendments a JOIN t ON a.supersedes_id = t.id)
SELECT t.id, t.root, t.hops, f.final_date FROM t JOIN (SELECT root, max(commencement_date) AS final_date FROM t
  JOIN fx_legal_amendments ON amendment_id = id GROUP BY root) f USING (root)
""")
def _chain(spark, sf):
    amendments = fx.legal_amendments(spark, sf)
    climbed = ln.climb(amendments, "amendment_id", "supersedes_id")
    dated = climbed.join(amendments.select(F.col("amendment_id").alias("node"), "commencement_date"), "node")
    final = dated.groupBy("root").agg(F.max("commencement_date").alias("final_date"))
    return climbed.join(final, "root").select(F.col("node").alias("id"), "root", F.col("depth").alias("hops"), "final_date")


query("rule_lineage", """
SELECT r.rule_id, r.source_rank, p.provision_id, p.title, a.amendment_id, cast(a.commencement_date AS date) AS commencement_date, s.s_name AS document, c.n_name AS category
FROM (SELECT *, concat('PRV-', cast(source_rank * 2 AS varchar)) AS pid FROM fx_rules_raw) r LEFT JOIN fx_provisions p ON p.provision_id = r.pid
LEFT JOIN fx_legal_amendments a ON a.amendment_id = p.amendment_id LEFT JOIN supplier s ON concat('SRC-', cast(s.s_suppkey AS varchar)) = p.document_id
LEFT JOIN nation c ON c.n_nationkey = r.source_rank % 30
""")(lambda spark, sf: ln.rule_lineage(
    fx.rules_raw(spark, sf).selectExpr("rule_id", "source_rank", "concat('PRV-', cast(source_rank * 2 AS string)) AS _pid",
                                       "cast(source_rank % 30 AS int) AS category_id").withColumnRenamed("_pid", "provision_id"),
    fx.provisions(spark, sf).select("provision_id", "title", "amendment_id", "document_id", F.col("provision_id").alias("_found")),
    fx.legal_amendments(spark, sf).select("amendment_id", "commencement_date", F.col("amendment_id").alias("_amendment")),
    fx.table(spark, sf, "supplier").selectExpr("concat('SRC-', cast(s_suppkey AS string)) AS document_id", "s_name AS document"),
    fx.table(spark, sf, "nation").selectExpr("n_nationkey AS category_id", "n_name AS category")).select(
    "rule_id", "source_rank", F.col("_found").alias("provision_id"), "title", F.col("_amendment").alias("amendment_id"), "commencement_date", "document", "category"))

query("asof_amendment", """
SELECT i.inspection_id, a.amendment_id, a.commencement_date FROM (SELECT inspection_id, cast(created_at AS date) AS day FROM fx_inspections) i
ASOF LEFT JOIN (SELECT max(amendment_id) AS amendment_id, day AS commencement_date FROM (
  SELECT amendment_id, cast(commencement_date - INTERVAL 15 YEAR AS date) AS day FROM fx_legal_amendments) t GROUP BY day) a ON i.day >= a.commencement_date
""")(lambda spark, sf: ln.asof_amendment(
    fx.inspections(spark, sf).select("inspection_id", "created_at"), "created_at", "inspection_id",
    fx.legal_amendments(spark, sf).selectExpr("amendment_id", "add_months(commencement_date, -180) AS commencement_date")).select(
    "inspection_id", "amendment_id", "commencement_date"))

# -------------------------------------------------------------------- changes

EXTRA_VIEWS["vx_base_rules"] = """
SELECT rule_id, arg_min(field, source_rank) AS field_name, arg_min(severity, source_rank) AS severity, arg_min(version, source_rank) AS version,
  arg_min(field, source_rank) AS target_parameter FROM fx_rules_raw WHERE source_rank % 3 <> 0 GROUP BY rule_id
"""
EXTRA_VIEWS["vx_new_rules"] = """
SELECT rule_id, arg_max(field, source_rank) AS field_name, 'CRITICAL' AS severity FROM fx_rules_raw WHERE source_rank % 2 = 0 GROUP BY rule_id
"""


def base_rules(spark, sf):
    raw = fx.rules_raw(spark, sf).where("source_rank % 3 <> 0")
    pick = lambda c: F.min_by(c, "source_rank")
    return raw.groupBy("rule_id").agg(pick("field").alias("field_name"), pick("severity").alias("severity"), pick("version").alias("version"),
                                      pick("field").alias("target_parameter"))


def new_rules(spark, sf):
    raw = fx.rules_raw(spark, sf).where("source_rank % 2 = 0").withColumn("severity", F.lit("CRITICAL"))
    return ch.latest_change(raw.select("rule_id", "source_rank", F.col("field").alias("field_name"), "severity"), "rule_id", "source_rank").drop("source_rank")


query("rule_upsert", """
SELECT coalesce(b.rule_id, n.rule_id) AS rule_id, coalesce(n.field_name, b.field_name) AS field_name, coalesce(n.severity, b.severity) AS severity, b.version,
  CASE WHEN n.rule_id IS NOT NULL THEN coalesce(n.field_name, b.field_name, b.target_parameter) ELSE b.target_parameter END AS target_parameter,
  CASE WHEN n.rule_id IS NULL THEN 'KEEP' WHEN b.rule_id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action
FROM vx_base_rules b FULL JOIN vx_new_rules n ON b.rule_id = n.rule_id
""")(lambda spark, sf: ch.rule_upsert(base_rules(spark, sf), new_rules(spark, sf), NOW))


@query("upsert_split", """
SELECT rule_id, CASE WHEN rule_id IN (SELECT rule_id FROM vx_base_rules) THEN 'update' ELSE 'insert' END AS part FROM vx_new_rules
""")
def _split(spark, sf):
    updates, inserts = ch.upsert_split(base_rules(spark, sf), new_rules(spark, sf))
    return updates.select("rule_id", F.lit("update").alias("part")).unionByName(inserts.select("rule_id", F.lit("insert").alias("part")))


query("rule_delete", "SELECT rule_id, field_name FROM vx_base_rules WHERE rule_id NOT IN (SELECT rule_id FROM vx_new_rules)")(
    lambda spark, sf: ch.rule_delete(base_rules(spark, sf), new_rules(spark, sf)).select("rule_id", "field_name"))
query("version_bump", """
SELECT rule_id, CASE WHEN rule_id IN (SELECT rule_id FROM vx_new_rules) THEN 'v9' ELSE version END AS version, rule_id IN (SELECT rule_id FROM vx_new_rules) AS bumped FROM vx_base_rules
""")(lambda spark, sf: ch.version_bump(base_rules(spark, sf), "v9", new_rules(spark, sf)).select("rule_id", "version", "bumped"))

query("officer_sign_off", f"""
SELECT inspection_id, CASE WHEN seq % 6 = 0 THEN coalesce(nullif(CASE WHEN seq % 12 = 0 THEN '7B VIOLATION' ELSE '' END, ''), '7A COMPLIANT') ELSE officer_decision END AS officer_decision,
  CASE WHEN seq % 6 = 0 THEN 'OFF-9' ELSE officer_id END AS officer_id,
  CASE WHEN seq % 6 = 0 THEN 'fine' WHEN seq % 4 = 1 THEN 'kept' END AS officer_comments,
  CASE WHEN seq % 6 = 0 THEN {NOW_SQL} WHEN seq % 4 = 1 THEN TIMESTAMP '2020-01-02 03:04:05' END AS verified_at FROM fx_inspections
""")(lambda spark, sf: ch.officer_sign_off(_commented(spark, sf), _decisions(spark, sf), NOW, "change_no").select(
    "inspection_id", "officer_decision", "officer_id", "officer_comments", "verified_at"))


def _commented(spark, sf):
    """Ledger rows, some with a comment and a time from earlier."""
    return fx.inspections(spark, sf).withColumns({
        "officer_comments": F.expr("CASE WHEN seq % 4 = 1 THEN 'kept' END"),
        "verified_at": F.expr("CASE WHEN seq % 4 = 1 THEN timestamp_ntz'2020-01-02 03:04:05' END")})


def _decisions(spark, sf):
    """Two decisions for each inspection signed; the second counts."""
    signed = fx.inspections(spark, sf).where("seq % 6 = 0")
    return signed.selectExpr(
        "inspection_id", "2 AS change_no", "CASE WHEN seq % 12 = 0 THEN '7B VIOLATION' END AS decision", "'fine' AS comments", "'OFF-9' AS officer_id"
    ).unionByName(signed.selectExpr(
        "inspection_id", "1 AS change_no", "'HOLD' AS decision", "'look again' AS comments", "'OFF-0' AS officer_id"))


def overrides(spark, sf):
    """Officer overrides for one ledger row in five, some without a reason, some for unknown rows."""
    return fx.inspections(spark, sf).where("seq % 5 = 0").selectExpr(
        "CASE WHEN seq % 35 = 0 THEN concat('X', inspection_id) ELSE inspection_id END AS inspection_id",
        "CASE seq % 3 WHEN 0 THEN ' 7b violation' WHEN 1 THEN 'compliant' ELSE 'hold' END AS verdict",
        "CASE WHEN seq % 25 = 0 THEN ' ' ELSE 'seen on site' END AS note", "'OFF-1' AS officer_id",
        "map('mrp', concat('Rs ', cast(seq AS string)), 'packer', 'ACME') AS declarations",
        "map('R-1', 'pass', 'R-99', 'violation') AS rule_statuses")


def overrides_twice(spark, sf):
    """The overrides, some after an earlier one of the same inspection."""
    last = overrides(spark, sf).withColumn("change_no", F.lit(2))
    seq = F.regexp_extract("inspection_id", "([0-9]+)", 1).cast("long")
    first = last.where((seq % 10 == 0) & (seq % 25 != 0)).withColumns({
        "change_no": F.lit(1), "verdict": F.lit("hold"), "note": F.lit("at first"), "officer_id": F.lit("OFF-2"),
        "declarations": F.create_map(F.lit("mrp"), F.lit("none"), F.lit("gone"), F.lit("x")),
        "rule_statuses": F.create_map(F.lit("R-1"), F.lit("violation"), F.lit("R-98"), F.lit("pass"))})
    return last.unionByName(first)


EXTRA_VIEWS["vx_overrides"] = """
SELECT seq, CASE WHEN seq % 35 = 0 THEN concat('X', inspection_id) ELSE inspection_id END AS inspection_id,
  CASE seq % 3 WHEN 0 THEN '7B VIOLATION' WHEN 1 THEN '7A COMPLIANT' ELSE 'HOLD' END AS verdict, CASE WHEN seq % 25 = 0 THEN '' ELSE 'seen on site' END AS note
FROM fx_inspections WHERE seq % 5 = 0
"""
query("override_apply", """
SELECT i.inspection_id, CASE WHEN o.verdict IS NOT NULL THEN 'seen on site' WHEN seq % 4 = 1 THEN 'kept' END AS officer_comments, o.verdict IS NOT NULL AS overridden, coalesce(o.verdict, i.overall_status) AS overall_status,
  CASE o.verdict WHEN '7A COMPLIANT' THEN false WHEN '7B VIOLATION' THEN true ELSE i.route_7b_triggered END AS route_7b_triggered,
  CASE WHEN o.verdict IS NOT NULL THEN coalesce(i.officer_decision, i.overall_status, 'PENDING') END AS previous_verdict
FROM fx_inspections i LEFT JOIN (SELECT inspection_id, verdict FROM vx_overrides WHERE note <> '') o USING (inspection_id)
""")(lambda spark, sf: ch.override_apply(_commented(spark, sf), overrides_twice(spark, sf), "change_no")[0].select(
    "inspection_id", "officer_comments", "overridden", "overall_status", "route_7b_triggered", "previous_verdict"))
query("override_rejects", """
SELECT inspection_id, CASE WHEN note = '' THEN 'justification is missing' ELSE 'unknown inspection' END AS reason FROM vx_overrides
WHERE note = '' OR inspection_id LIKE 'X%'
""")(lambda spark, sf: ch.override_apply(fx.inspections(spark, sf), overrides(spark, sf))[1])

EXTRA_VIEWS["vx_ledger_decl"] = """
SELECT concat('INS-', cast(l_orderkey AS varchar)) AS inspection_id, CASE l_linenumber WHEN 1 THEN 'mrp' WHEN 2 THEN 'net_quantity' ELSE 'batch_number' END AS field_name,
  min(cast(l_quantity AS bigint)) AS q FROM lineitem GROUP BY 1, 2
"""


def ledger_decl(spark, sf):
    lineitem = fx.table(spark, sf, "lineitem")
    name = F.expr("CASE l_linenumber WHEN 1 THEN 'mrp' WHEN 2 THEN 'net_quantity' ELSE 'batch_number' END")
    return lineitem.groupBy(F.expr("concat('INS-', cast(l_orderkey AS string))").alias("inspection_id"), name.alias("field_name")).agg(
        F.min(F.col("l_quantity").cast("long")).cast("string").alias("value"), F.lit(80.0).alias("confidence"))


_ENTERED = """SELECT inspection_id, 'mrp' AS field_name, concat('Rs ', cast(seq AS varchar)) AS v FROM vx_overrides WHERE note <> ''
UNION ALL SELECT inspection_id, 'packer', 'ACME' FROM vx_overrides WHERE note <> ''"""
query("override_declarations", f"""
SELECT coalesce(d.inspection_id, e.inspection_id) AS inspection_id, coalesce(d.field_name, e.field_name) AS field_name, coalesce(e.v, cast(d.q AS varchar)) AS value,
  CASE WHEN e.v IS NOT NULL THEN cast(d.q AS varchar) END AS previous_value, CASE WHEN e.v IS NOT NULL THEN 100.0 ELSE 80.0 END AS confidence
FROM vx_ledger_decl d FULL JOIN ({_ENTERED}) e ON d.inspection_id = e.inspection_id AND d.field_name = e.field_name
""")(lambda spark, sf: ch.override_declarations(ledger_decl(spark, sf), overrides_twice(spark, sf), "change_no").select(
    "inspection_id", "field_name", "value", "previous_value", "confidence"))

EXTRA_VIEWS["vx_one_check"] = "SELECT inspection_id, rule_id, min(status) AS status FROM fx_checks GROUP BY 1, 2"
_RULED = """SELECT inspection_id, 'R-1' AS rule_id, 'COMPLIANT' AS s FROM vx_overrides WHERE note <> ''
UNION ALL SELECT inspection_id, 'R-99', 'VIOLATION' FROM vx_overrides WHERE note <> ''"""
query("override_checks", f"""
SELECT coalesce(c.inspection_id, e.inspection_id) AS inspection_id, coalesce(c.rule_id, e.rule_id) AS rule_id, coalesce(e.s, c.status) AS status,
  CASE WHEN e.s IS NOT NULL THEN CASE WHEN c.rule_id IS NULL THEN 'UNKNOWN' WHEN c.status = 'PASS' THEN 'COMPLIANT' ELSE 'VIOLATION' END END AS previous_status
FROM vx_one_check c FULL JOIN ({_RULED}) e ON c.inspection_id = e.inspection_id AND c.rule_id = e.rule_id
""")(lambda spark, sf: ch.override_checks(
    fx.checks(spark, sf).groupBy("inspection_id", "rule_id").agg(F.min("status").alias("status")), overrides_twice(spark, sf), "change_no").drop("overridden"))


def _one_check(spark, sf):
    return fx.checks(spark, sf).groupBy("inspection_id", "rule_id").agg(F.min("status").alias("status"))


def _violations(spark, sf):
    return _one_check(spark, sf).where("status <> 'PASS'").select("inspection_id", "rule_id")


_STAYING = """SELECT c.inspection_id, c.rule_id FROM vx_one_check c LEFT JOIN (SELECT inspection_id, verdict FROM vx_overrides WHERE note <> '') o USING (inspection_id)
WHERE c.status <> 'PASS' AND (coalesce(o.verdict, '') <> '7A COMPLIANT' OR c.rule_id NOT IN ('R-1', 'R-99'))
UNION ALL SELECT inspection_id, 'R-99' FROM vx_overrides WHERE note <> '' AND verdict = '7A COMPLIANT'"""
query("override_violations", _STAYING)(lambda spark, sf: ch.override_violations(
    _violations(spark, sf), _one_check(spark, sf), overrides_twice(spark, sf), "change_no"))
query("override_amendments", f"""
SELECT i.inspection_id, coalesce(i.officer_decision, i.overall_status, 'PENDING') AS previous_verdict, o.verdict AS new_verdict, 'OFF-1' AS amended_by,
  i.route_7b_triggered AS route_before, CASE o.verdict WHEN '7A COMPLIANT' THEN false WHEN '7B VIOLATION' THEN true ELSE i.route_7b_triggered END AS route_after,
  d.q AS price_before, concat('Rs ', cast(o.seq AS varchar)) AS price_after, coalesce(v0.n, 0) AS violations_before, coalesce(v1.n, 0) AS violations_after,
  CASE WHEN c.status IS NULL THEN 'UNKNOWN' WHEN c.status = 'PASS' THEN 'COMPLIANT' ELSE 'VIOLATION' END AS rule_from, 'COMPLIANT' AS rule_to
FROM fx_inspections i JOIN vx_overrides o ON o.inspection_id = i.inspection_id AND o.note <> ''
LEFT JOIN (SELECT inspection_id, cast(q AS varchar) AS q FROM vx_ledger_decl WHERE field_name = 'mrp') d ON d.inspection_id = i.inspection_id
LEFT JOIN (SELECT inspection_id, count(*) AS n FROM vx_one_check WHERE status <> 'PASS' GROUP BY 1) v0 ON v0.inspection_id = i.inspection_id
LEFT JOIN (SELECT inspection_id, count(*) AS n FROM ({_STAYING}) GROUP BY 1) v1 ON v1.inspection_id = i.inspection_id
LEFT JOIN vx_one_check c ON c.inspection_id = i.inspection_id AND c.rule_id = 'R-1'
""")(lambda spark, sf: _amended(spark, sf))


def _amended(spark, sf):
    rows = ch.override_amendments(
        fx.inspections(spark, sf), ledger_decl(spark, sf), _one_check(spark, sf), _violations(spark, sf), overrides_twice(spark, sf), NOW, "change_no")
    inside = lambda column, path: F.get_json_object(column, path)
    listed = lambda column: F.size(F.from_json(inside(column, "$.violations"), "array<string>")).cast("long")
    return rows.select(
        "inspection_id", "previous_verdict", "new_verdict", "amended_by",
        inside("previous_state", "$.route_7b_triggered").cast("boolean").alias("route_before"),
        inside("updated_state", "$.route_7b_triggered").cast("boolean").alias("route_after"),
        inside("previous_state", "$.declarations.mrp").alias("price_before"), inside("updated_state", "$.declarations.mrp").alias("price_after"),
        listed("previous_state").alias("violations_before"), listed("updated_state").alias("violations_after"),
        inside("diff_summary", "$['modified_rules']['R-1']['from']").alias("rule_from"),
        inside("diff_summary", "$['modified_rules']['R-1']['to']").alias("rule_to"))


@query("override_diff", """
SELECT inspection_id, string_agg(concat(field_name, ':', coalesce(cast(q AS varchar), ''), '>', v), ',' ORDER BY field_name) AS diff FROM (
SELECT i.inspection_id, e.field_name, d.q, e.v FROM (SELECT DISTINCT inspection_id FROM vx_ledger_decl) i JOIN (
""" + _ENTERED + """) e USING (inspection_id) LEFT JOIN vx_ledger_decl d ON d.inspection_id = e.inspection_id AND d.field_name = e.field_name) t GROUP BY inspection_id
""")
def _diff(spark, sf):
    before = ledger_decl(spark, sf).groupBy("inspection_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("before"))
    entered = overrides(spark, sf).where("trim(note) <> ''").select("inspection_id", "declarations")
    both = before.join(entered, "inspection_id").withColumn(
        "after", F.map_concat(F.map_filter("before", lambda k, v: ~F.array_contains(F.map_keys("declarations"), k)), F.col("declarations")))
    changed = F.array_sort(F.map_entries(ch.map_diff(F.col("before"), F.col("after"))))
    shown = F.transform(changed, lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"]["from"], F.lit("")), F.lit(">"), e["value"]["to"]))
    return both.select("inspection_id", F.array_join(shown, ",").alias("diff"))


_FLIP = "CASE WHEN (p LIKE '%VIOLATION%' AND new_verdict LIKE '%COMPLIANT%') OR (p LIKE '%COMPLIANT%' AND new_verdict LIKE '%VIOLATION%') THEN 'ALERT' ELSE 'WARNING' END"
query("override_notice", f"""
SELECT inspection_id, amendment_id, {_FLIP} AS severity, concat('Inspection ', inspection_id, ': ''', coalesce(p, ''), ''' -> ''', new_verdict, '''') AS message FROM (
SELECT *, lag(new_verdict) OVER (PARTITION BY inspection_id ORDER BY amended_at, amendment_id) AS p FROM fx_amendments) t
""")(lambda spark, sf: _notice(spark, sf).select("inspection_id", "amendment_id", "severity", "message"))


def _notice(spark, sf):
    from panelmark.operators.ledger import verdict_history

    return ch.override_notice(verdict_history(fx.amendments(spark, sf)))


query("mark_read", "SELECT notification_id, is_read OR notification_id % 7 = 0 AS is_read FROM fx_notifications")(
    lambda spark, sf: ch.mark_read(fx.notifications(spark, sf), fx.notifications(spark, sf).where("notification_id % 7 = 0")).select("notification_id", "is_read"))

_NEW_ROLE = "CASE user_no % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'inspector' ELSE 'king' END"
EXTRA_VIEWS["vx_role_changes"] = f"SELECT concat('USR-', cast(user_no AS varchar)) AS user_id, {_NEW_ROLE} AS role FROM (SELECT s_suppkey * 20 AS user_no FROM supplier) t"


def role_changes(spark, sf):
    return fx.table(spark, sf, "supplier").selectExpr("s_suppkey * 20 AS user_no").selectExpr(
        "concat('USR-', cast(user_no AS string)) AS user_id", f"{_NEW_ROLE} AS role")


@query("role_change", """
SELECT c.user_id, u.role AS old_role, CASE WHEN c.role IN ('admin', 'inspector', 'reviewing_officer') AND u.role IS NOT NULL THEN c.role END AS new_role,
  CASE WHEN c.role = 'king' THEN 'invalid role' WHEN u.role IS NULL THEN 'unknown user' END AS reason FROM vx_role_changes c LEFT JOIN fx_users u USING (user_id)
""")
def _roles(spark, sf):
    good, bad = ch.role_change(fx.users(spark, sf), role_changes(spark, sf))
    bad = bad.join(fx.users(spark, sf).select("user_id", F.col("role").alias("old_role")), "user_id", "left")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(
        bad.select("user_id", "old_role", F.lit(None).cast("string").alias("new_role"), "reason"))


_INCOMING = """s_suppkey AS row_no, CASE WHEN s_suppkey % 4 = 0 THEN concat('U', cast(s_suppkey AS {s})) END AS user_id,
  CASE WHEN s_suppkey % 5 = 0 THEN lower('Customer#000000007@example.com') ELSE concat('s', cast(s_suppkey % 60 AS {s}), '@example.com') END AS email,
  CASE WHEN s_suppkey % 9 = 0 THEN 'guest' ELSE 'inspector' END AS role"""
EXTRA_VIEWS["vx_incoming_users"] = f"SELECT {_INCOMING.replace('{s}', 'varchar')} FROM supplier"


@query("user_load", """
SELECT row_no, email, reason, CASE WHEN reason IS NULL THEN coalesce(user_id, concat('USR-NEW-', cast(n AS varchar))) END AS user_id FROM (
SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY row_no) AS n FROM (
SELECT i.*, CASE WHEN role = 'guest' THEN 'invalid role' WHEN email IN (SELECT email FROM fx_users) THEN 'e-mail exists'
  WHEN row_number() OVER (PARTITION BY email ORDER BY row_no) > 1 THEN 'e-mail repeated' END AS reason FROM vx_incoming_users i) a) b
""")
def _load(spark, sf):
    incoming = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS row_no", "CASE WHEN s_suppkey % 4 = 0 THEN concat('U', cast(s_suppkey AS string)) END AS user_id",
        "CASE WHEN s_suppkey % 5 = 0 THEN lower('Customer#000000007@example.com') ELSE concat('s', cast(s_suppkey % 60 AS string), '@example.com') END AS email",
        "CASE WHEN s_suppkey % 9 = 0 THEN 'guest' ELSE 'inspector' END AS role")
    good, bad = ch.user_load(fx.users(spark, sf), incoming)
    none = F.lit(None).cast("string")
    return good.select("row_no", "email", none.alias("reason"), "user_id").unionByName(bad.select("row_no", "email", "reason", none.alias("user_id")))


_WORK = """seq, CASE WHEN seq % 70 = 0 THEN 'INS-none' ELSE inspection_id END AS inspection_id, concat('USR-', cast(seq % 2000 AS {s})) AS user_id,
  CASE WHEN seq % 2 = 0 THEN 'officer_review' ELSE 'inspector_dispatch' END AS assignment_type"""
EXTRA_VIEWS["vx_work"] = f"SELECT {_WORK.replace('{s}', 'varchar')} FROM fx_inspections WHERE seq % 7 = 0"


def work(spark, sf):
    return fx.inspections(spark, sf).where("seq % 7 = 0").selectExpr(
        "CASE WHEN seq % 70 = 0 THEN 'INS-none' ELSE inspection_id END AS inspection_id", "concat('USR-', cast(seq % 2000 AS string)) AS user_id",
        "CASE WHEN seq % 2 = 0 THEN 'officer_review' ELSE 'inspector_dispatch' END AS assignment_type")


query("assign_work", """
SELECT i.inspection_id, CASE WHEN u.name IS NOT NULL AND w.assignment_type = 'officer_review' THEN w.user_id ELSE i.officer_id END AS officer_id,
  CASE WHEN u.name IS NOT NULL AND w.assignment_type = 'inspector_dispatch' THEN u.name ELSE i.inspector_name END AS inspector_name
FROM fx_inspections i LEFT JOIN vx_work w ON w.inspection_id = i.inspection_id LEFT JOIN fx_users u ON u.user_id = w.user_id
""")(lambda spark, sf: ch.assign_work(fx.inspections(spark, sf), fx.users(spark, sf), work(spark, sf))[0].select("inspection_id", "officer_id", "inspector_name"))
query("assign_work_rejects", """
SELECT w.inspection_id, w.user_id, CASE WHEN u.name IS NULL THEN 'unknown user' ELSE 'unknown inspection' END AS reason FROM vx_work w
LEFT JOIN fx_users u USING (user_id) WHERE u.name IS NULL OR w.inspection_id = 'INS-none'
""")(lambda spark, sf: ch.assign_work(fx.inspections(spark, sf), fx.users(spark, sf), work(spark, sf))[1])

EXTRA_VIEWS["vx_reads"] = """
SELECT inspection_id, CASE WHEN line_no <= 6 THEN 'front' ELSE 'back' END AS field_name, CASE WHEN line_no % 5 = 0 THEN '' ELSE text END AS value, CASE WHEN line_no % 4 <> 1 THEN confidence END AS confidence, line_no AS image_index FROM fx_label_lines
"""
query("merge_declarations", """
SELECT inspection_id, field_name, image_index, value FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id, field_name
  ORDER BY value <> '' DESC, CASE WHEN value <> '' THEN coalesce(confidence, 0) ELSE 0 END DESC, image_index) AS r FROM vx_reads) t WHERE r = 1
""")(lambda spark, sf: ch.merge_declarations(fx.label_lines(spark, sf).selectExpr(
    "inspection_id", "CASE WHEN line_no <= 6 THEN 'front' ELSE 'back' END AS field_name", "CASE WHEN line_no % 5 = 0 THEN '' ELSE text END AS value",
    "CASE WHEN line_no % 4 <> 1 THEN confidence END AS confidence", "line_no AS image_index")).select("inspection_id", "field_name", "image_index", "value"))
query("merge_dates_by_type", """
SELECT inspection_id, type, image_index FROM (SELECT inspection_id, field_name AS type, image_index, row_number() OVER (PARTITION BY inspection_id, field_name
  ORDER BY coalesce(confidence, 0) DESC, image_index) AS r FROM vx_reads) t WHERE r = 1
""")(lambda spark, sf: ch.merge_dates(fx.label_lines(spark, sf).selectExpr(
    "inspection_id", "CASE WHEN line_no <= 6 THEN 'front' ELSE 'back' END AS type", "text AS date_text",
    "CASE WHEN line_no % 4 <> 1 THEN confidence END AS confidence", "line_no AS image_index")).select(
    "inspection_id", "type", "image_index"))

# ------------------------------------------------------------ sources and sinks


def scans(spark, sf):
    """Scans with nested detections and a declarations map, as a capture service sends them."""
    lines = fx.label_lines(spark, sf)
    item = F.struct("line_no", "text", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    entry = F.struct(F.concat(F.lit("field_"), F.col("line_no").cast("string")).alias("k"),
                     F.struct(F.when(F.col("line_no") != 4, F.col("text")).alias("value"),
                              F.when(F.col("line_no") != 2, F.col("confidence")).alias("confidence")).alias("v"))
    return lines.groupBy("inspection_id").agg(
        F.array_sort(F.collect_list(item)).alias("detections"), F.map_from_entries(F.collect_list(entry)).alias("declarations"),
        F.max("confidence").alias("overall_confidence"), F.count("*").alias("n")).withColumns(
        {"image_id": F.concat(F.col("inspection_id"), F.lit(".png")), "full_text": F.concat(F.lit("lines: "), F.col("n").cast("string"))})


query("ingest_detections", """
SELECT inspection_id, concat(inspection_id, '.png') AS image_id, concat('lines: ', cast(count(*) OVER (PARTITION BY inspection_id) AS varchar)) AS full_text,
  text AS detected_text, confidence FROM fx_label_lines
""")(lambda spark, sf: readers.ingest_detections(scans(spark, sf)).select("inspection_id", "image_id", "full_text", "detected_text", "confidence"))
query("ingest_declarations", """
SELECT inspection_id, concat('field_', cast(line_no AS varchar)) AS field_name, text AS field_value,
  CASE WHEN line_no <> 2 THEN confidence ELSE m END AS confidence FROM (
SELECT *, max(confidence) OVER (PARTITION BY inspection_id) AS m FROM fx_label_lines) t WHERE line_no <> 4
""")(lambda spark, sf: readers.ingest_declarations(scans(spark, sf)).select("inspection_id", "field_name", "field_value", "confidence"))

query("reject_bad_input", """
SELECT page_id, CASE WHEN length(html) % 7 = 0 THEN 'empty file' WHEN page_id % 3 = 0 THEN 'format not allowed'
  WHEN page_id % 5 = 0 THEN 'larger than 25 MB' END AS reason FROM pages
""")(lambda spark, sf: readers.judge_uploads(fx.table(spark, sf, "pages").selectExpr(
    "page_id", "concat('/up/', cast(page_id AS string), CASE WHEN page_id % 3 = 0 THEN '.gif' ELSE '.JPG' END) AS path",
    "CASE WHEN length(html) % 7 = 0 THEN 0 WHEN page_id % 5 = 0 THEN 26214401 ELSE length(html) END AS length")).select("page_id", "reason"))

_KEYS = ", ".join(f"('{k}')" for k in C.SESSION_FIELDS)
query("sink_scan_session", f"""
SELECT p.inspection_id, k.field_name, d.value, coalesce(d.confidence, 0.0) AS confidence,
  CASE WHEN coalesce(d.value, '') <> '' THEN 'detected' ELSE 'not_detected' END AS status
FROM (SELECT DISTINCT inspection_id FROM fx_label_lines) p CROSS JOIN (VALUES {_KEYS}) k(field_name)
LEFT JOIN vx_decl d ON d.inspection_id = p.inspection_id AND d.field_name = k.field_name
""")(lambda spark, sf: sinks.session_rows(fx.label_lines(spark, sf).select("inspection_id").distinct(), declarations(spark, sf)).select(
    "inspection_id", "field_name", "value", "confidence", "status"))

_ENTRY_JSON = "map<string, struct<value string, confidence double, bbox array<double>, status string>>"
query("sink_session_documents", f"""
SELECT p.inspection_id, k.field_name, d.value, coalesce(d.confidence, 0.0) AS confidence, coalesce(d.x1, 0.0) AS x1, coalesce(d.y2, 0.0) AS y2,
  CASE WHEN coalesce(d.value, '') <> '' THEN 'detected' ELSE 'not_detected' END AS status
FROM (SELECT DISTINCT inspection_id FROM fx_label_lines) p CROSS JOIN (VALUES {_KEYS}) k(field_name)
LEFT JOIN vx_decl d ON d.inspection_id = p.inspection_id AND d.field_name = k.field_name
""")(lambda spark, sf: sinks.session_documents(fx.label_lines(spark, sf).select("inspection_id").distinct(), declarations(spark, sf)).select(
    "inspection_id", F.explode(F.from_json("normalized_declarations_json", _ENTRY_JSON)).alias("field_name", "d")).select(
    "inspection_id", "field_name", "d.value", "d.confidence", F.col("d.bbox")[0].alias("x1"), F.col("d.bbox")[3].alias("y2"), "d.status"))

query("session_by_id", """
SELECT 'INS-8' AS session_id, '/a/INS-8.png|/b/INS-8.png' AS originals, '' AS processed FROM fx_inspections WHERE inspection_id = 'INS-8'
""")(lambda spark, sf: _session(spark, sf))


def _session(spark, sf):
    from panelmark.operators.ledger import session_by_id

    sessions = fx.inspections(spark, sf).selectExpr(
        "inspection_id AS session_id", "concat('/a/', inspection_id, '.png,/b/', inspection_id, '.png') AS original_image_url", "'' AS processed_image_url")
    found = session_by_id(sessions, "INS-8")
    return found.select("session_id", F.array_join("original_urls", "|").alias("originals"), F.array_join("processed_urls", "|").alias("processed"))


query("sink_inspection", f"""
SELECT i.inspection_id, CASE WHEN c.failed = 0 AND c.review = 0 THEN '7A COMPLIANT' ELSE '7B VIOLATION' END AS overall_status, l.checks, l.violations, d.fields
FROM fx_inspections i JOIN vx_summary c USING (inspection_id) JOIN (
  SELECT inspection_id, string_agg(t, ',' ORDER BY t) AS checks, coalesce(string_agg(t, ',' ORDER BY t) FILTER (status = 'FAIL'), '') AS violations
  FROM (SELECT *, concat_ws(':', rule_id, field_name, status, severity, reason) AS t FROM fx_checks) k GROUP BY 1) l USING (inspection_id)
LEFT JOIN (SELECT inspection_id, string_agg(t, ',' ORDER BY t) AS fields FROM (
  SELECT *, concat(field_name, '=', cast(q AS varchar)) AS t FROM vx_ledger_decl) m GROUP BY 1) d USING (inspection_id)
""")(lambda spark, sf: sinks.ledger_rows(
    fx.inspections(spark, sf).select("inspection_id", "product_name").join(fx.checks(spark, sf).select("inspection_id").distinct(), "inspection_id", "left_semi"),
    fx.checks(spark, sf).withColumn("observed", F.col("reason")), ledger_decl(spark, sf)).select(
    "inspection_id", "overall_status",
    _said("checks_json", _CHECK_JSON, lambda c: F.concat_ws(":", c["rule_id"], c["field_name"], c["status"], c["severity"], c["observed"])).alias("checks"),
    _said("violations_json", _CHECK_JSON, lambda c: F.concat_ws(":", c["rule_id"], c["field_name"], c["status"], c["severity"], c["observed"])).alias("violations"),
    F.array_join(F.array_sort(F.transform(F.map_entries(F.from_json("technical_matrix_json", "map<string, string>")), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
     .alias("fields")))

_PROFILE = {
    "field_name": "CASE line_no WHEN 2 THEN 'net_quantity' WHEN 7 THEN 'fssai_license' WHEN 8 THEN 'consumer_care' WHEN 10 THEN 'manufacturer' ELSE 'note' END",
    "value": "CASE WHEN (seq + line_no) % 6 = 0 THEN '' WHEN (seq + line_no) % 11 = 0 THEN NULL ELSE substr(text, 15) END",
    "numeric_value": "CASE WHEN line_no = 2 AND seq % 9 <> 0 THEN CASE WHEN seq % 5 IN (1, 3) THEN seq % 17 / 8.0 ELSE seq * 7 % 1300 * 1.0 END END",
    "unit": "CASE WHEN line_no = 2 THEN CASE seq % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ML' WHEN 3 THEN 'l' END END",
}
_PROFILE_NAME = "CASE WHEN seq % 3 = 0 THEN 'Packaged Commodity Item' ELSE concat('Tea ', cast(seq AS {s})) END"
EXTRA_VIEWS["vx_profile"] = "SELECT inspection_id, {} FROM fx_label_lines".format(", ".join(f"{sql} AS {name}" for name, sql in _PROFILE.items()))


def _of(field: str, column: str) -> str:
    return f"nullif(max({column}) FILTER (field_name = '{field}'), '')"


query("sink_inspection_evidence", f"""
SELECT inspection_id, image_quality_passed, coalesce(maker, CASE WHEN named THEN product_name ELSE 'Not Detected' END) AS company, CASE WHEN named THEN product_name
    ELSE 'Unidentified Product Label' END AS product, category, coalesce(licence, 'Not Detected') AS licence, coalesce(quantity, 'Not Detected') AS quantity,
  CASE WHEN quantity IS NULL THEN 'N/A' WHEN n IS NULL THEN '1.5%'
    WHEN u IN ('kg', 'l') THEN CASE WHEN n <= 1 THEN concat('15.0 ', CASE u WHEN 'kg' THEN 'g' ELSE 'ml' END) ELSE '1.5%' END
    WHEN n <= 50 THEN '9.0%' WHEN n <= 100 THEN concat('4.5 ', u) WHEN n <= 200 THEN '4.5%' WHEN n <= 300 THEN concat('9.0 ', u) WHEN n <= 500 THEN '3.0%'
    WHEN n <= 1000 THEN concat('15.0 ', u) ELSE '1.5%' END AS shown, care, page, boxes FROM (
SELECT p.inspection_id, quality_score >= 70 AS image_quality_passed, {_PROFILE_NAME.format(s="varchar")} AS product_name, seq % 3 <> 0 AS named, category, d.*, t.* FROM vx_packages p
JOIN (SELECT inspection_id AS a, {_of("manufacturer", "value")} AS maker, {_of("fssai_license", "value")} AS licence, {_of("net_quantity", "value")} AS quantity,
    max(value) FILTER (field_name = 'consumer_care') AS care, max(numeric_value) AS n, lower(coalesce(max(unit), 'g')) AS u FROM vx_profile GROUP BY 1) d ON d.a = p.inspection_id
JOIN (SELECT inspection_id AS b, string_agg(text, chr(10) ORDER BY line_no) AS page,
    string_agg(concat_ws(':', line_no, text, cast(x1 AS bigint), cast(y2 AS bigint)), '|' ORDER BY line_no) AS boxes FROM fx_label_lines GROUP BY 1) t ON t.b = p.inspection_id) w
""")(lambda spark, sf: _evidence(spark, sf))


def _evidence(spark, sf):
    lines = fx.label_lines(spark, sf)
    decl = lines.select("inspection_id", "confidence", *[F.expr(sql).alias(name) for name, sql in _PROFILE.items()])
    named = packages(spark, sf).withColumn("product_name", F.expr(_PROFILE_NAME.format(s="string")))
    rows = sinks.ledger_evidence(named.select("inspection_id", "product_name", "category", "quality_score"), decl, lines)

    def told(column: str, key: str):
        return F.get_json_object(column, f"$.{key}")

    boxes = F.transform(
        F.from_json("bounding_boxes_json_immutable", "array<struct<line_no: int, text: string, bbox: array<double>>>"),
        lambda b: F.concat_ws(":", b["line_no"], b["text"], b["bbox"][0].cast("long"), b["bbox"][3].cast("long")))
    return rows.select(
        "inspection_id", "image_quality_passed", told("company_profile_json", "company_name").alias("company"),
        told("company_profile_json", "product_name").alias("product"), told("company_profile_json", "category").alias("category"),
        told("company_profile_json", "fssai_license").alias("licence"), told("quantity_mpe_json", "declared_quantity").alias("quantity"),
        told("quantity_mpe_json", "mpe_display").alias("shown"), told("customer_care_json", "value").alias("care"),
        F.col("ocr_raw_text_immutable").alias("page"), F.array_join(boxes, "|").alias("boxes"))


_CHECK_JSON = "array<struct<rule_id: string, field_name: string, status: string, severity: string, observed: string>>"


def _said(column: str, schema: str, show):
    """What a JSON list says, item by item, in order."""
    return F.array_join(F.array_sort(F.transform(F.from_json(column, schema), show)), ",")



@query("export_csv_files", f"""
SELECT 'all' AS scope, t.* FROM ({EXPORT_SQL}) t
UNION ALL SELECT 'violations', t.* FROM ({EXPORT_SQL} WHERE upper(overall_status) LIKE '%7B%') t
UNION ALL SELECT 'pending', t.* FROM ({EXPORT_SQL} WHERE coalesce(officer_decision, '') = '') t
""")
def _export_files(spark, sf):
    """The files of all three scopes, read back."""
    folder = _scratch(spark, "export")
    files = []
    for scope in ("all", "violations", "pending"):
        sinks.write_csv(fx.inspections(spark, sf), f"{folder}/{scope}", scope)
        read = spark.read.options(header=True, emptyValue="").csv(f"{folder}/{scope}")
        files.append(read.select(F.lit(scope).alias("scope"), *[F.coalesce(c, F.lit("")).alias(c) for c in read.columns]))
    return files[0].unionByName(files[1]).unionByName(files[2])


query("sink_audit", f"""
SELECT concat('OFF-', cast(amendment_id % 5 AS varchar)) AS user_id, 'ADJUDICATION_OVERRIDE' AS action, inspection_id AS resource_id, concat('verdict ', new_verdict) AS details,
  {NOW_SQL} AS "timestamp" FROM fx_amendments
""")(lambda spark, sf: sinks.audit_rows(fx.amendments(spark, sf), F.col("officer_id"), F.lit("ADJUDICATION_OVERRIDE"), F.col("inspection_id"),
                                        F.concat(F.lit("verdict "), F.col("new_verdict")), NOW))

query("archive_snapshot", """
SELECT i.inspection_id AS original_inspection_id, i.inspector_id, i.overall_status, i.officer_decision, i.product_name, i.seq, d.fields FROM fx_inspections i
LEFT JOIN (SELECT inspection_id, string_agg(t, ',' ORDER BY t) AS fields FROM (
  SELECT *, concat(field_name, '=', cast(q AS varchar)) AS t FROM vx_ledger_decl) m GROUP BY 1) d USING (inspection_id)
""")(lambda spark, sf: sinks.archive_rows(
    fx.inspections(spark, sf), fx.label_lines(spark, sf), ledger_decl(spark, sf), NOW).select(
    "original_inspection_id", "inspector_id", "overall_status", "officer_decision",
    F.from_json("payload_json", _PAYLOAD_JSON).alias("p")).select(
    "original_inspection_id", "inspector_id", "overall_status", "officer_decision", "p.product_name", "p.seq",
    F.array_join(F.array_sort(F.transform("p.declarations", lambda d: F.concat_ws("=", d["field_name"], d["value"]))), ",").alias("fields")))

_PAYLOAD_JSON = "product_name string, seq long, declarations array<struct<field_name: string, value: string>>"

query("evolve_schema", """
SELECT rule_id, source_rank, 'ALL' AS product_category, true AS is_active, cast(NULL AS varchar) AS explanation FROM fx_rules_raw
""")(lambda spark, sf: sinks.evolve(fx.rules_raw(spark, sf).select("rule_id", "source_rank"), {
    "rule_id": ("string", None), "product_category": ("string", "ALL"), "is_active": ("boolean", True), "explanation": ("string", None)}))


@query("scan_rule_json", "SELECT rule_id, field AS field_name, severity FROM fx_rules_raw WHERE rule_id <> ''")
def _scan_json(spark, sf):
    folder = _scratch(spark, "rules-json")
    fx.rules_raw(spark, sf).select("rule_id", F.col("field").alias("field_name"), "severity").write.mode("overwrite").json(folder)
    return readers.read_rules_lines(spark, folder).select("rule_id", "field_name", "severity")


@query("scan_rule_documents", "SELECT rule_id, field AS field_name, severity FROM fx_rules_raw WHERE rule_id <> '' UNION ALL SELECT rule_id, field, severity FROM fx_rules_raw WHERE rule_id <> ''")
def _scan_documents(spark, sf):
    """The feed as documents of 500 rules each, once as bare lists and once wrapped; the folder is the first that exists."""
    folder = _scratch(spark, "rules-documents")
    rule = F.struct("rule_id", F.col("field").alias("field_name"), "severity")
    documents = fx.rules_raw(spark, sf).groupBy(F.expr("source_rank div 500").alias("document")).agg(F.collect_list(rule).alias("rules"))
    documents.select("document", F.to_json("rules").alias("value")).write.partitionBy("document").text(f"{folder}/listed")
    documents.write.partitionBy("document").json(f"{folder}/wrapped")
    read = [readers.read_rules_json(spark, [f"{folder}/missing", f"{folder}/{form}"]) for form in ("listed", "wrapped")]
    return read[0].unionByName(read[1]).select("rule_id", "field_name", "severity")


@query("scan_rule_csv", "SELECT rule_id, field, parameters, description FROM fx_rules_raw")
def _scan_csv(spark, sf):
    folder = _scratch(spark, "rules-csv")
    raw = fx.rules_raw(spark, sf).withColumn("provision_id", F.lit("P, 1")).withColumn("notes", F.lit('say "so"'))
    columns = [c.split(" ")[0] for c in readers.RAW_RULE_SCHEMA.split(", ")]
    raw.select(*columns).write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(f"{folder}/compliance_rules.csv")
    return readers.read_provenance_table(spark, folder, "compliance_rules").select("rule_id", "field", "parameters", "description")


@query("scan_ledger", "SELECT inspection_id, overall_status FROM fx_inspections")
def _scan_ledger(spark, sf):
    folder = _scratch(spark, "ledger")
    sinks.append(fx.inspections(spark, sf).withColumn("month", F.date_format("created_at", "yyyy-MM")), f"{folder}/inspections", ["month"])
    return readers.read_ledger(spark, folder, "inspections").select("inspection_id", "overall_status")


def _scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid

    from panelmark.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
