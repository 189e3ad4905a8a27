"""Label-screening views over the driver's tables.

Each view exists twice: as a DataFrame for Spark and as SQL text (``SQL``) that
an oracle puts in front of its query as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PACKAGE = 12


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def inspections(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(
        nation, customer.c_nationkey == nation.n_nationkey, "left"
    )
    return joined.selectExpr(
        "concat('INS-', cast(o_orderkey AS string)) AS inspection_id",
        "o_orderkey AS seq",
        "concat('Item ', cast(o_custkey % 97 AS string)) AS product_name",
        "CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE c_mktsegment END AS category",
        "n_name AS location",
        "concat('USR-', cast(o_custkey % 20 AS string)) AS inspector_id",
        "concat('Inspector ', cast(o_custkey % 20 AS string)) AS inspector_name",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('OFF-', cast(o_orderkey % 5 AS string)) END"
        " AS officer_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('Officer ', cast(o_orderkey % 5 AS string)) END"
        " AS officer_name",
        "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'NON-COMPLIANT'"
        " WHEN o_orderstatus = 'F' THEN '7A COMPLIANT'"
        " WHEN o_orderstatus = 'O' THEN '7B VIOLATION' ELSE 'PENDING' END AS overall_status",
        "CASE WHEN o_orderkey % 4 = 0 THEN '7A COMPLIANT'"
        " WHEN o_orderkey % 4 = 1 THEN '7B VIOLATION' END AS officer_decision",
        "cast(50 + (o_orderkey * 7) % 50 AS double) AS overall_confidence",
        "cast(40 + (o_orderkey * 13) % 61 AS double) AS quality_score",
        "o_orderpriority LIKE '1-%' AS route_7b_triggered",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS created_at",
    )


def checks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('INS-', cast(l_orderkey AS string)) AS inspection_id",
        "concat('R-', cast(l_partkey % 34 AS string)) AS rule_id",
        "l_linenumber AS line_no",
        "concat('field_', cast(l_partkey % 12 AS string)) AS field_name",
        "CASE WHEN l_linenumber = 1 THEN 'CRITICAL' WHEN l_linenumber <= 3 THEN 'HIGH'"
        " WHEN l_linenumber <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity",
        "CASE WHEN l_returnflag = 'A' THEN 'PASS'"
        " WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'FAIL'"
        " WHEN l_returnflag = 'N' THEN 'NEEDS_REVIEW'"
        " WHEN l_linestatus = 'O' THEN 'NOT_APPLICABLE' ELSE 'PASS' END AS status",
        "l_suppkey % 5 <> 0 AS is_mandatory",
        "CASE WHEN l_suppkey % 10 = 0 THEN 'Statutory check bypassed' ELSE 'Evaluated' END"
        " AS reason",
        "l_shipdate AS evaluated_at",
    )


_LINE_TEXT = """
CASE line_no
  WHEN 1 THEN p_name
  WHEN 2 THEN CASE WHEN p_partkey % 7 = 0
    THEN concat('NET WEIGHT: ', cast(p_size AS string), 'g + 9g EXTRA = ',
                cast(p_size + 9 AS string), 'g')
    ELSE concat('Net Quantity: ', cast(p_size AS string), ' ',
                CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml'
                     ELSE 'gms' END) END
  WHEN 3 THEN CASE WHEN p_partkey % 13 = 0
    THEN concat('Rs. ', cast(cast(p_retailprice AS decimal(12,2)) AS string), ' only')
    ELSE concat('MRP Rs. ', cast(cast(p_retailprice AS decimal(12,2)) AS string),
                CASE WHEN p_partkey % 3 <> 0 THEN ' (Incl. of all taxes)' ELSE '' END) END
  WHEN 4 THEN concat('PKD: ', lpad(cast(1 + p_partkey % 28 AS string), 2, '0'), '/',
                     lpad(cast(1 + p_partkey % 12 AS string), 2, '0'), '/2025')
  WHEN 5 THEN CASE WHEN p_partkey % 5 = 0
    THEN concat('BEST BEFORE ', cast(1 + p_partkey % 18 AS string),
                ' MONTHS FROM PACKAGING')
    ELSE concat('EXP: ', lpad(cast(1 + p_partkey % 28 AS string), 2, '0'), '/',
                lpad(cast(1 + p_partkey % 12 AS string), 2, '0'), '/',
                cast(2024 + p_partkey % 4 AS string)) END
  WHEN 6 THEN concat('Batch No: B', cast(p_partkey % 1000 AS string), '-X')
  WHEN 7 THEN concat('FSSAI Lic No: 1', lpad(cast(p_partkey AS string), 13, '0'))
  WHEN 8 THEN concat('Consumer Care: 1800-', lpad(cast(p_partkey % 1000 AS string), 3, '0'), '-',
                     lpad(cast(p_partkey % 10000 AS string), 4, '0'), ' | care',
                     cast(p_partkey % 50 AS string), '@example.com')
  WHEN 9 THEN concat('Country of Origin: ',
                     CASE p_partkey % 2 WHEN 0 THEN 'India' ELSE 'Nepal' END)
  WHEN 10 THEN concat('Manufactured by: ', p_brand, ' Foods Ltd')
  WHEN 11 THEN CASE WHEN p_partkey % 6 = 0 THEN 'Ingredients: SALT'
    WHEN p_partkey % 6 = 1 THEN 'Ingredients: SUGAR, WHEAT FLOUR' ELSE 'Export quality pack' END
  ELSE concat('USP Rs. ', cast(1 + p_partkey % 90 AS string), '.50 / g') END
"""


def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per text line of a package label, some lines missing on purpose."""
    return lines_of(table(spark, sf, "part"))


def lines_of(part: DataFrame) -> DataFrame:
    # a file of one row group is read by one task; the patterns need them all
    part = part.repartition(part.sparkSession.sparkContext.defaultParallelism, "p_partkey")
    lines = part.withColumn("line_no", F.explode(F.sequence(F.lit(1), F.lit(LINES_PER_PACKAGE))))
    lines = lines.where("(p_partkey + line_no) % 11 <> 0")
    return lines.selectExpr(
        "concat('PKG-', cast(p_partkey AS string)) AS inspection_id",
        "p_partkey AS seq",
        "line_no",
        f"{_LINE_TEXT} AS text",
        "cast(50 + (p_partkey * 31 + line_no * 17) % 50 AS double) AS confidence",
        "cast(40 + (line_no % 3) * 5 AS double) AS x1",
        "cast(60 * line_no AS double) AS y1",
    ).selectExpr(
        "*", "x1 + 10 * length(text) AS x2", "y1 + 20 + (seq + line_no) % 3 * 10 AS y2"
    )


#: zeroes of the nine scripts, in the order in which packages take turns
_SCRIPTS = [0x0966, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0B66, 0x09E6, 0x0A66, 0x0AE6]
_DIGITS = ", ".join(f"'{''.join(chr(zero + i) for i in range(10))}'" for zero in _SCRIPTS)

_SPLIT_TEXT = """
CASE line_no
  WHEN 21 THEN CASE p_partkey % 4 WHEN 0 THEN 'M.R.P.:' WHEN 1 THEN 'MAX RETAIL' WHEN 2 THEN concat('MRP ₹', translate(price, '0123456789', digits))
    ELSE 'Our price list is MRP' END
  WHEN 22 THEN CASE p_partkey % 4 WHEN 0 THEN concat('fresh stock of the season', repeat(' for all', cast(p_partkey % 13 AS int)))
    WHEN 1 THEN 'PRICE (see below)' WHEN 2 THEN concat('Net Quantity: ', translate(cast(p_size AS string), '0123456789', digits), ' g')
    ELSE CASE WHEN p_partkey % 3 = 0 THEN 'Incl. of all taxes' ELSE 'printed on the cap' END END
  WHEN 23 THEN CASE p_partkey % 4 WHEN 2 THEN concat('PKD: ', translate(concat(lpad(cast(1 + p_partkey % 28 AS string), 2, '0'), '/',
      lpad(cast(1 + p_partkey % 12 AS string), 2, '0'), '/2025'), '0123456789', digits))
    WHEN 1 THEN concat('Rs. ', price, ' (Incl. of all taxes)') ELSE concat(price, ' only') END
  ELSE CASE WHEN p_partkey % 5 = 0 THEN '₹ 2.50 per g' ELSE 'Keep in a cool place' END END
"""


def split_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Labels whose price stands lines below its key, or in digits of other scripts."""
    part = table(spark, sf, "part")
    part = part.repartition(spark.sparkContext.defaultParallelism, "p_partkey").selectExpr(
        "*", "cast(cast(p_retailprice AS decimal(12,2)) AS string) AS price",
        f"element_at(array({_DIGITS}), cast(p_partkey % 9 + 1 AS int)) AS digits")
    lines = part.withColumn("line_no", F.explode(F.sequence(F.lit(21), F.lit(24))))
    return lines.selectExpr(
        "concat('SPL-', cast(p_partkey AS string)) AS inspection_id", "p_partkey AS seq", "line_no", f"{_SPLIT_TEXT} AS text",
        "cast(60 + (p_partkey * 31 + line_no * 17) % 40 AS double) AS confidence", "cast(40 AS double) AS x1",
        "cast(200 * (line_no - 20) AS double) AS y1").selectExpr("*", "x1 + 10 * length(text) AS x2", "y1 + 30 AS y2")


_SPLIT_LINES_SQL = f"""
SELECT inspection_id, seq, line_no, text, confidence, x1, y1, x1 + 10 * length(text) AS x2, y1 + 30 AS y2 FROM (
SELECT concat('SPL-', cast(p_partkey AS varchar)) AS inspection_id, p_partkey AS seq, line_no,
  {_SPLIT_TEXT.replace(" AS string)", " AS varchar)")} AS text,
  cast(60 + (p_partkey * 31 + line_no * 17) % 40 AS double) AS confidence, cast(40 AS double) AS x1, cast(200 * (line_no - 20) AS double) AS y1
FROM (SELECT *, cast(cast(p_retailprice AS decimal(12,2)) AS varchar) AS price,
    ([{_DIGITS}])[cast(p_partkey % 9 + 1 AS int)] AS digits FROM part) p, (SELECT unnest(range(21, 25)) AS line_no) n) t
"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "ts AS event_time",
        "concat('USR-', cast(user_id AS string)) AS user_id",
        "CASE event_type WHEN 'signup' THEN 'CREATE_USER' WHEN 'purchase' THEN 'OFFICER_SIGN_OFF'"
        " WHEN 'view' THEN 'INSPECTION_SCAN_PROCESSED' WHEN 'click' THEN 'WORK_ASSIGNED'"
        " ELSE 'ADJUDICATION_OVERRIDE' END AS action",
        "value AS metric",
        "concat('details ', props) AS details",
    )


def amendments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "concat('CASE-', cast(o_custkey AS string)) AS inspection_id",
        "o_orderkey AS amendment_id",
        "concat('OFF-', cast(o_orderkey % 5 AS string)) AS officer_id",
        "CASE o_orderstatus WHEN 'F' THEN '7A COMPLIANT' WHEN 'O' THEN '7B VIOLATION'"
        " ELSE 'PENDING' END AS new_verdict",
        "concat('note ', o_orderpriority) AS note",
        "o_orderdate AS amended_at",
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "concat('USR-', cast(c_custkey AS string)) AS user_id",
        "c_name AS name",
        "lower(concat(c_name, '@example.com')) AS email",
        "CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 5 = 0"
        " THEN 'reviewing_officer' ELSE 'inspector' END AS role",
    )


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS notification_id",
        "ts AS created_at",
        "CASE event_type WHEN 'error' THEN 'ALERT' ELSE 'WARNING' END AS severity",
        "event_type IN ('view', 'signup') AS is_read",
    )


def rules_raw(spark: SparkSession, sf: str) -> DataFrame:
    """A rule list as large as the part table, as a catalogue feed would give it."""
    return table(spark, sf, "part").selectExpr(
        "concat(CASE WHEN p_partkey % 17 = 0 THEN 'DECL-' WHEN p_partkey % 19 = 0 THEN 'rule_'"
        " ELSE 'LM-CR-' END, lpad(cast(p_partkey % 1500 AS string), 3, '0')) AS rule_id",
        "p_partkey AS source_rank",
        "CASE p_partkey % 4 WHEN 0 THEN 'net_quantity' WHEN 1 THEN 'mrp' WHEN 2 THEN 'fssai_license'"
        " ELSE 'allergen_declaration' END AS field",
        "CASE p_partkey % 9 WHEN 0 THEN 'PRESENCE' WHEN 1 THEN 'UNIT' WHEN 2 THEN 'FORMAT'"
        " WHEN 3 THEN 'DATE' WHEN 4 THEN 'NUMERIC' WHEN 5 THEN 'CONDITIONAL'"
        " WHEN 6 THEN 'DIMENSION' WHEN 7 THEN 'APPLICABILITY_EXCLUSION' ELSE 'SHAPE' END"
        " AS validation_type",
        "CASE p_partkey % 5 WHEN 0 THEN '{\"allowed_units\": [\"g\", \"kg\"]}'"
        " WHEN 1 THEN '{\"min\": 1, \"max\": 5000}' WHEN 2 THEN '{\"mandatory\": false}'"
        " WHEN 3 THEN 'not json' ELSE '{}' END AS parameters",
        "CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity",
        "CASE p_partkey % 6 WHEN 0 THEN 'pre_packaged_general' WHEN 1 THEN 'pre_packaged_food'"
        " WHEN 2 THEN 'cosmetics' WHEN 3 THEN 'imported_products' WHEN 4 THEN 'frozen, pre_packaged_food'"
        " ELSE '' END AS applicability",
        "CASE WHEN p_partkey % 7 = 0 THEN 'DRAFT' WHEN p_partkey % 11 = 0 THEN 'DEPRECATED'"
        " ELSE 'VERIFIED_FROM_SOURCE' END AS verification_status",
        "concat('2026.', cast(p_partkey % 3 AS string), '.0') AS version",
        "CASE WHEN p_partkey % 8 = 0 THEN '2025-06-01' END AS effective_from",
        "CASE WHEN p_partkey % 16 = 0 THEN '2025-01-01' WHEN p_partkey % 8 = 0 THEN '2026-06-01' END"
        " AS effective_to",
        "concat('Clause on ', p_type) AS description",
    )


def provisions(spark: SparkSession, sf: str) -> DataFrame:
    """A forest: every provision hangs below number // 3, the first five are roots."""
    return table(spark, sf, "part").selectExpr(
        "concat('PRV-', cast(p_partkey AS string)) AS provision_id",
        "CASE WHEN p_partkey >= 5 THEN concat('PRV-', cast(p_partkey DIV 3 AS string)) END"
        " AS parent_id",
        "concat('Title ', p_name) AS title",
        "concat('AMD-', cast(p_partkey % 40 AS string)) AS amendment_id",
        "concat('SRC-', cast(p_partkey % 12 AS string)) AS document_id",
    )


def legal_amendments(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of seven amendments, each superseding the one before it."""
    return table(spark, sf, "part").selectExpr(
        "concat('AMD-', cast(p_partkey AS string)) AS amendment_id",
        "CASE WHEN p_partkey % 7 <> 0 THEN concat('AMD-', cast(p_partkey - 1 AS string)) END"
        " AS supersedes_id",
        "date_add(date '2010-01-01', cast(p_partkey * 3 % 5000 AS int)) AS commencement_date",
    )


_INSPECTIONS_SQL = """
SELECT concat('INS-', cast(o.o_orderkey AS varchar)) AS inspection_id, o.o_orderkey AS seq,
       concat('Item ', cast(o.o_custkey % 97 AS varchar)) AS product_name,
       CASE WHEN o.o_orderkey % 41 = 0 THEN '' ELSE c.c_mktsegment END AS category,
       n.n_name AS location,
       concat('USR-', cast(o.o_custkey % 20 AS varchar)) AS inspector_id,
       concat('Inspector ', cast(o.o_custkey % 20 AS varchar)) AS inspector_name,
       CASE WHEN o.o_orderkey % 3 = 0 THEN concat('OFF-', cast(o.o_orderkey % 5 AS varchar)) END
         AS officer_id,
       CASE WHEN o.o_orderkey % 3 = 0 THEN concat('Officer ', cast(o.o_orderkey % 5 AS varchar)) END
         AS officer_name,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 7 = 0 THEN 'NON-COMPLIANT'
            WHEN o.o_orderstatus = 'F' THEN '7A COMPLIANT'
            WHEN o.o_orderstatus = 'O' THEN '7B VIOLATION' ELSE 'PENDING' END AS overall_status,
       CASE WHEN o.o_orderkey % 4 = 0 THEN '7A COMPLIANT'
            WHEN o.o_orderkey % 4 = 1 THEN '7B VIOLATION' END AS officer_decision,
       cast(50 + (o.o_orderkey * 7) % 50 AS double) AS overall_confidence,
       cast(40 + (o.o_orderkey * 13) % 61 AS double) AS quality_score,
       o.o_orderpriority LIKE '1-%' AS route_7b_triggered,
       o.o_orderdate + to_seconds(o.o_orderkey % 86400) AS created_at
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
              LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

_CHECKS_SQL = """
SELECT concat('INS-', cast(l_orderkey AS varchar)) AS inspection_id,
       concat('R-', cast(l_partkey % 34 AS varchar)) AS rule_id,
       l_linenumber AS line_no,
       concat('field_', cast(l_partkey % 12 AS varchar)) AS field_name,
       CASE WHEN l_linenumber = 1 THEN 'CRITICAL' WHEN l_linenumber <= 3 THEN 'HIGH'
            WHEN l_linenumber <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE WHEN l_returnflag = 'A' THEN 'PASS'
            WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'FAIL'
            WHEN l_returnflag = 'N' THEN 'NEEDS_REVIEW'
            WHEN l_linestatus = 'O' THEN 'NOT_APPLICABLE' ELSE 'PASS' END AS status,
       l_suppkey % 5 <> 0 AS is_mandatory,
       CASE WHEN l_suppkey % 10 = 0 THEN 'Statutory check bypassed' ELSE 'Evaluated' END AS reason,
       l_shipdate AS evaluated_at
FROM lineitem
"""

_LABEL_LINES_SQL = f"""
SELECT *, x1 + 10 * length(text) AS x2, y1 + 20 + (seq + line_no) % 3 * 10 AS y2 FROM (
SELECT concat('PKG-', cast(p_partkey AS varchar)) AS inspection_id, p_partkey AS seq,
       cast(line_no AS integer) AS line_no,
       {_LINE_TEXT} AS text,
       cast(50 + (p_partkey * 31 + line_no * 17) % 50 AS double) AS confidence,
       cast(40 + (line_no % 3) * 5 AS double) AS x1, cast(60 * line_no AS double) AS y1
FROM part CROSS JOIN (SELECT unnest(range(1, {LINES_PER_PACKAGE + 1})) AS line_no) t
WHERE (p_partkey + line_no) % 11 <> 0) s
"""

_AUDIT_SQL = """
SELECT event_id, ts AS event_time, concat('USR-', cast(user_id AS varchar)) AS user_id,
       CASE event_type WHEN 'signup' THEN 'CREATE_USER' WHEN 'purchase' THEN 'OFFICER_SIGN_OFF'
            WHEN 'view' THEN 'INSPECTION_SCAN_PROCESSED' WHEN 'click' THEN 'WORK_ASSIGNED'
            ELSE 'ADJUDICATION_OVERRIDE' END AS action,
       value AS metric, concat('details ', props) AS details
FROM events
"""

_AMENDMENTS_SQL = """
SELECT concat('CASE-', cast(o_custkey AS varchar)) AS inspection_id, o_orderkey AS amendment_id,
       concat('OFF-', cast(o_orderkey % 5 AS varchar)) AS officer_id,
       CASE o_orderstatus WHEN 'F' THEN '7A COMPLIANT' WHEN 'O' THEN '7B VIOLATION'
            ELSE 'PENDING' END AS new_verdict,
       concat('note ', o_orderpriority) AS note, o_orderdate AS amended_at
FROM orders
"""

_USERS_SQL = """
SELECT concat('USR-', cast(c_custkey AS varchar)) AS user_id, c_name AS name,
       lower(concat(c_name, '@example.com')) AS email,
       CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 5 = 0 THEN 'reviewing_officer'
            ELSE 'inspector' END AS role
FROM customer
"""

_NOTIFICATIONS_SQL = """
SELECT event_id AS notification_id, ts AS created_at,
       CASE event_type WHEN 'error' THEN 'ALERT' ELSE 'WARNING' END AS severity,
       event_type IN ('view', 'signup') AS is_read
FROM events
"""

_RULES_RAW_SQL = """
SELECT concat(CASE WHEN p_partkey % 17 = 0 THEN 'DECL-' WHEN p_partkey % 19 = 0 THEN 'rule_'
              ELSE 'LM-CR-' END,
              CASE WHEN length(cast(p_partkey % 1500 AS varchar)) < 3
                   THEN lpad(cast(p_partkey % 1500 AS varchar), 3, '0')
                   ELSE substr(cast(p_partkey % 1500 AS varchar), 1, 3) END) AS rule_id,
       p_partkey AS source_rank,
       CASE p_partkey % 4 WHEN 0 THEN 'net_quantity' WHEN 1 THEN 'mrp' WHEN 2 THEN 'fssai_license'
            ELSE 'allergen_declaration' END AS field,
       CASE p_partkey % 9 WHEN 0 THEN 'PRESENCE' WHEN 1 THEN 'UNIT' WHEN 2 THEN 'FORMAT'
            WHEN 3 THEN 'DATE' WHEN 4 THEN 'NUMERIC' WHEN 5 THEN 'CONDITIONAL'
            WHEN 6 THEN 'DIMENSION' WHEN 7 THEN 'APPLICABILITY_EXCLUSION' ELSE 'SHAPE' END
         AS validation_type,
       CASE p_partkey % 5 WHEN 0 THEN '{"allowed_units": ["g", "kg"]}'
            WHEN 1 THEN '{"min": 1, "max": 5000}' WHEN 2 THEN '{"mandatory": false}'
            WHEN 3 THEN 'not json' ELSE '{}' END AS parameters,
       CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE p_partkey % 6 WHEN 0 THEN 'pre_packaged_general' WHEN 1 THEN 'pre_packaged_food'
            WHEN 2 THEN 'cosmetics' WHEN 3 THEN 'imported_products'
            WHEN 4 THEN 'frozen, pre_packaged_food' ELSE '' END AS applicability,
       CASE WHEN p_partkey % 7 = 0 THEN 'DRAFT' WHEN p_partkey % 11 = 0 THEN 'DEPRECATED'
            ELSE 'VERIFIED_FROM_SOURCE' END AS verification_status,
       concat('2026.', cast(p_partkey % 3 AS varchar), '.0') AS version,
       CASE WHEN p_partkey % 8 = 0 THEN '2025-06-01' END AS effective_from,
       CASE WHEN p_partkey % 16 = 0 THEN '2025-01-01' WHEN p_partkey % 8 = 0 THEN '2026-06-01' END
         AS effective_to,
       concat('Clause on ', p_type) AS description
FROM part
"""

_PROVISIONS_SQL = """
SELECT concat('PRV-', cast(p_partkey AS varchar)) AS provision_id,
       CASE WHEN p_partkey >= 5 THEN concat('PRV-', cast(p_partkey // 3 AS varchar)) END
         AS parent_id,
       concat('Title ', p_name) AS title,
       concat('AMD-', cast(p_partkey % 40 AS varchar)) AS amendment_id,
       concat('SRC-', cast(p_partkey % 12 AS varchar)) AS document_id
FROM part
"""

_LEGAL_AMENDMENTS_SQL = """
SELECT concat('AMD-', cast(p_partkey AS varchar)) AS amendment_id,
       CASE WHEN p_partkey % 7 <> 0 THEN concat('AMD-', cast(p_partkey - 1 AS varchar)) END
         AS supersedes_id,
       cast(date '2010-01-01' + cast(p_partkey * 3 % 5000 AS integer) AS date)
         AS commencement_date
FROM part
"""

SQL = {
    "fx_inspections": _INSPECTIONS_SQL,
    "fx_checks": _CHECKS_SQL,
    "fx_label_lines": _LABEL_LINES_SQL,
    "fx_split_lines": _SPLIT_LINES_SQL,
    "fx_audit": _AUDIT_SQL,
    "fx_amendments": _AMENDMENTS_SQL,
    "fx_users": _USERS_SQL,
    "fx_notifications": _NOTIFICATIONS_SQL,
    "fx_rules_raw": _RULES_RAW_SQL,
    "fx_provisions": _PROVISIONS_SQL,
    "fx_legal_amendments": _LEGAL_AMENDMENTS_SQL,
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the views that ``sql`` names in front of it."""
    known = {**SQL, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\b[fv]x_\w+", text))):
            if name in known and name not in needed:
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({known[name]})" for name in needed)
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = " RECURSIVE", ", " + body[len("WITH RECURSIVE"):].strip()
    elif body.upper().startswith("WITH "):
        body = ", " + body[len("WITH "):].strip()
    return f"WITH{recursive} {views}\n{body}"
