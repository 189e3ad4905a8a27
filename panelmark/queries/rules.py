"""Rule loading, applicability, evaluation and roll-up queries."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark import fixtures as fx
from panelmark.functions import text as tx
from panelmark.functions import values as vx
from panelmark.operators import extract as ex
from panelmark.operators import ledger
from panelmark.operators import measures as ms
from panelmark.operators import rollup as ru
from panelmark.operators import tokens as tk
from panelmark.plans import applicability as ap
from panelmark.plans import catalog, screening
from panelmark.queries.extraction import FALLBACK_WORDS, SQUEEZED
from panelmark.queries.registry import EXTRA_VIEWS, query
from panelmark.queries.scalars import SQL_SUSPICIOUS, sql_any, sql_label_date, sql_list, sql_map

TODAY = date(2026, 1, 15)
TODAY_SQL = "date '2026-01-15'"

# --------------------------------------------------------------- package views

_CATEGORY = ("CASE p_partkey % 6 WHEN 0 THEN 'Food & Beverages' WHEN 1 THEN 'Cosmetics' WHEN 2 THEN 'ALL'"
             " WHEN 3 THEN 'Imported Products' WHEN 4 THEN 'pre_packaged_food' ELSE NULL END")
EXTRA_VIEWS["vx_packages"] = f"""
SELECT concat('PKG-', cast(p_partkey AS varchar)) AS inspection_id, p_partkey AS seq, {_CATEGORY} AS category,
  cast(60 + p_partkey * 7 % 40 AS double) AS overall_confidence, p_partkey % 9 <> 0 AS quality_ok,
  cast(40 + p_partkey * 13 % 61 AS double) AS quality_score FROM part
"""


def packages(spark, sf):
    return packages_of(fx.table(spark, sf, "part"))


def packages_of(part):
    return part.selectExpr(
        "concat('PKG-', cast(p_partkey AS string)) AS inspection_id",
        "p_partkey AS seq",
        f"{_CATEGORY} AS category",
        "cast(60 + p_partkey * 7 % 40 AS double) AS overall_confidence",
        "p_partkey % 9 <> 0 AS quality_ok",
        "cast(40 + p_partkey * 13 % 61 AS double) AS quality_score",
    )


# Declarations taken straight from the lines, one row per field.
_FIELD = ("CASE line_no WHEN 1 THEN 'generic_name' WHEN 2 THEN 'quantity' WHEN 3 THEN 'mrp' WHEN 4 THEN 'pkd' WHEN 5 THEN 'use_by'"
          " WHEN 6 THEN 'batch_no' WHEN 7 THEN 'license_number' WHEN 8 THEN 'customer_care' WHEN 9 THEN 'made_in'"
          " WHEN 10 THEN 'packer' WHEN 11 THEN 'ingredient_list' ELSE 'usp' END")
_VALUE = ("CASE WHEN line_no = 1 THEN text WHEN line_no = 11 AND seq % 5 = 0 THEN 'Not Detected' WHEN line_no = 6 THEN substr(text, 11)"
          " WHEN line_no IN (4, 5) THEN substr(text, 6) ELSE substr(text, length(text) - 12) END")
EXTRA_VIEWS["vx_decl"] = f"""
SELECT inspection_id, seq, line_no, {_FIELD} AS field_name, {_VALUE} AS value,
  CASE WHEN seq % 4 = 0 THEN confidence / 100.0 ELSE confidence END AS confidence, x1, y1, x2, y2 FROM fx_label_lines
"""


def declarations(spark, sf):
    return declarations_of(fx.table(spark, sf, "part"))


def declarations_of(part):
    return fx.lines_of(part).selectExpr(
        "inspection_id", "seq", "line_no", f"{_FIELD} AS field_name", f"{_VALUE} AS value",
        "CASE WHEN seq % 4 = 0 THEN confidence / 100.0 ELSE confidence END AS confidence", "x1", "y1", "x2", "y2",
        "cast(0 AS int) AS image_index",
    )


def sql_rules() -> str:
    def q(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + str(v).replace("'", "''") + "'"

    columns = ["rule_id", "regulation", "product_category", "field_name", "rule_type", "condition", "required",
               "severity", "version", "effective_from", "effective_to", "is_active"]
    rows = ", ".join("(" + ", ".join(q(r[c]) for c in columns) + ")" for r in catalog.RULES)
    return f"SELECT * FROM (VALUES {rows}) AS t({', '.join(columns)})"


EXTRA_VIEWS["vx_rules"] = sql_rules()
_ALIASES = ", ".join(
    f"('{f}', '{c}', {i + 1})" for f, cs in C.FIELD_ALIASES.items() for i, c in enumerate(cs))
EXTRA_VIEWS["vx_aliases"] = f"SELECT * FROM (VALUES {_ALIASES}) AS t(field, candidate, priority)"
_BOXES = ", ".join(f"('{f}', '{c}', {i + 1})" for f, cs in C.BOX_FALLBACKS.items() for i, c in enumerate(cs))
EXTRA_VIEWS["vx_box_fallbacks"] = f"SELECT * FROM (VALUES {_BOXES}) AS t(field, candidate, priority)"

_CANDIDATES = f"""list_concat([{sql_list(C.GENERIC_CATEGORIES)}], CASE WHEN trim(category) IN ({sql_list(C.GENERIC_CATEGORIES)}) OR trim(category) = ''
  THEN [] WHEN contains(category, '&') THEN list_concat([trim(category)], list_transform(string_split(trim(category), '&'), lambda c: trim(c)))
  ELSE [trim(category)] END)"""
EXTRA_VIEWS["vx_applicable"] = f"""
SELECT DISTINCT p.inspection_id, r.rule_id FROM (SELECT *, {_CANDIDATES} AS cs FROM (
  SELECT * REPLACE (coalesce(category, 'ALL') AS category) FROM vx_packages) a) p
JOIN vx_rules r ON r.is_active AND r.field_name <> '' AND (r.effective_from IS NULL OR cast(r.effective_from AS date) <= {TODAY_SQL})
  AND (r.effective_to IS NULL OR cast(r.effective_to AS date) >= {TODAY_SQL})
  AND (r.product_category IS NULL OR len(list_filter(p.cs, lambda c: r.product_category ILIKE concat('%', c, '%'))) > 0)
"""

query("applicable_rules", "SELECT * FROM vx_applicable")(lambda spark, sf: ap.applicable_rules(
    packages(spark, sf), catalog.rules(spark), TODAY).select("inspection_id", "rule_id"))

_BAD = f"lower(trim(value)) IN ({sql_list(C.ABSENT_TEXTS)})"
_SCALED = "CASE WHEN coalesce(nullif(confidence, 0), 90) <= 1 THEN coalesce(nullif(confidence, 0), 90) * 100 ELSE coalesce(nullif(confidence, 0), 90) END"
EXTRA_VIEWS["vx_resolved"] = f"""
SELECT inspection_id, field, arg_min(value, (priority, value)) AS value, arg_min(conf, (priority, value)) AS confidence FROM (
SELECT inspection_id, field_name AS field, 0 AS priority, value, {_SCALED} AS conf FROM vx_decl WHERE trim(coalesce(value, '')) <> '' AND NOT {_BAD}
UNION ALL SELECT inspection_id, field, priority, value, {_SCALED} FROM vx_decl JOIN vx_aliases ON candidate = field_name
  WHERE trim(coalesce(value, '')) <> '' AND NOT {_BAD}) t GROUP BY inspection_id, field
"""
# what is given, and the tax clause that the price text implies (with the price's confidence as it stands, not scaled)
EXTRA_VIEWS["vx_given"] = f"""
SELECT inspection_id, field, value, confidence FROM vx_resolved
UNION ALL SELECT inspection_id, 'mrp_inclusive_tax', 'Inclusive of all taxes', coalesce(nullif(confidence, 0), 90) FROM vx_decl
  WHERE field_name = 'mrp' AND {sql_any('lower(value)', C.TAX_WORDS)}
    AND inspection_id NOT IN (SELECT inspection_id FROM vx_resolved WHERE field = 'mrp_inclusive_tax')
"""
query("resolve_alias", """
SELECT * REPLACE (round(confidence, 4) AS confidence) FROM vx_resolved
""")(lambda spark, sf: screening.resolve_aliases(declarations(spark, sf)).where(
    "priority < 1000").select(
    "inspection_id", "field", "entry.value", F.round("entry.confidence", 4).alias("confidence")))


@query("cross_field_pair", """
SELECT e.inspection_id, e.value, m.value AS ref_value FROM (SELECT * FROM vx_resolved WHERE field = 'expiry_date') e
LEFT JOIN (SELECT * FROM vx_resolved WHERE field = 'manufacturing_date') m USING (inspection_id)
""")
def _cross(spark, sf):
    resolved = screening.resolve_aliases(declarations(spark, sf))
    maps = screening.field_maps(resolved.where("field IN ('expiry_date', 'manufacturing_date')"))
    return maps.select(
        "inspection_id",
        F.try_element_at("fields", F.lit("expiry_date"))["value"].alias("value"),
        F.try_element_at("fields", F.lit("manufacturing_date"))["value"].alias("ref_value"),
    ).where("value IS NOT NULL")


_PRICE_NUM = r"try_cast(nullif(regexp_extract(p, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS double)"
_QTY_RX = r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)"
_QTY_NUM = rf"try_cast(nullif(regexp_extract(q, '{_QTY_RX}', 1), '') AS double)"
EXTRA_VIEWS["vx_pq"] = f"""
SELECT inspection_id, max(value) FILTER (field_name = 'mrp') AS p, max(value) FILTER (field_name = 'net_quantity') AS q,
  max(coalesce(nullif(confidence, 0), 90)) FILTER (field_name = 'mrp') AS pc,
  max(coalesce(nullif(confidence, 0), 90)) FILTER (field_name = 'net_quantity') AS qc FROM (
SELECT * REPLACE (CASE WHEN field_name = 'quantity' THEN 'net_quantity' ELSE field_name END AS field_name) FROM vx_decl) t GROUP BY inspection_id
"""


def priced(spark, sf):
    return declarations(spark, sf).withColumn(
        "field_name", F.when(F.col("field_name") == "quantity", "net_quantity").otherwise(F.col("field_name")))


query("unit_sale_price", rf"""
SELECT inspection_id, cast(round(cast(cast({_PRICE_NUM} / {_QTY_NUM} AS varchar) AS decimal(30, 18)), 2) AS double) AS unit_price, regexp_extract(q, '{_QTY_RX}', 2) AS unit,
  least(pc, qc) AS confidence FROM vx_pq WHERE {_PRICE_NUM} > 0 AND {_QTY_NUM} > 0 AND round({_PRICE_NUM} / {_QTY_NUM}, 2) > 0
""")(lambda spark, sf: ru.unit_sale_price(priced(spark, sf)))

_UNIT_RX = r"'(?i)(?:^|\s|[0-9])(g|kg|ml|l|ltr|gm|gms|pcs|units|pieces|n|u)\b'"
_PER_UNIT = f"cast(round(cast(cast({_PRICE_NUM} / {_QTY_NUM} AS varchar) AS decimal(30, 18)), 2) AS double)"
_SHOWN_UNIT_PRICE = "CASE WHEN u % 1 = 0 THEN concat(cast(cast(u AS bigint) AS varchar), '.0') ELSE cast(u AS varchar) END"
query("derived_fields", rf"""
SELECT inspection_id, unnest([{sql_list(C.UNIT_FIELDS)}]) AS field, regexp_extract(q, {_UNIT_RX}, 1) AS value, qc AS confidence, NULL::DOUBLE AS numeric_value
FROM vx_pq WHERE regexp_extract(q, {_UNIT_RX}, 1) <> ''
UNION ALL SELECT inspection_id, unnest([{sql_list(C.TAX_FIELDS)}]), 'Inclusive of all taxes', pc, NULL
FROM vx_pq WHERE contains(lower(p), 'tax') OR contains(lower(p), 'incl')
UNION ALL SELECT inspection_id, unnest([{sql_list(C.UNIT_PRICE_FIELDS)}]), concat('Rs. ', {_SHOWN_UNIT_PRICE}, ' / ', per), least(pc, qc), u
FROM (SELECT *, {_PER_UNIT} AS u, regexp_extract(q, '{_QTY_RX}', 2) AS per FROM vx_pq WHERE {_PRICE_NUM} > 0 AND {_QTY_NUM} > 0) t
""")(lambda spark, sf: screening.derived_declarations(screening.standard_declarations(priced(spark, sf)))
     .select("inspection_id", "field", "entry.value", "entry.confidence", "entry.numeric_value"))

# ----------------------------------------------------------------- rule loading

query("validate_rules", f"""
SELECT rule_id, source_rank, CASE WHEN validation_type NOT IN ({sql_list(C.RULE_TYPES)}) THEN concat('unknown rule type: ', validation_type)
  WHEN effective_from IS NOT NULL AND effective_to IS NOT NULL AND cast(effective_to AS date) < cast(effective_from AS date)
  THEN 'effective_to is before effective_from' END AS reason FROM fx_rules_raw
""")(lambda spark, sf: ap.validate_rules(fx.rules_raw(spark, sf).withColumnRenamed("validation_type", "rule_type")).select(
    "rule_id", "source_rank", "reason"))

_APPL = "CASE applicability WHEN 'pre_packaged_general' THEN 'ALL' WHEN 'pre_packaged_food' THEN 'Food & Beverages' WHEN 'cosmetics' THEN 'Cosmetics' WHEN 'imported_products' THEN 'Imported Products' WHEN '' THEN 'ALL' ELSE applicability END"
query("applicability_category", f"SELECT rule_id, source_rank, {_APPL} AS category FROM fx_rules_raw")(
    lambda spark, sf: ap.canonicalise_rules(fx.rules_raw(spark, sf)).select(
        "rule_id", "source_rank", F.col("product_category").alias("category")))

_TYPE = sql_map(C.RULE_TYPE_ALIASES, "validation_type", "'MANDATORY_FIELD'")
_UNITS_JSON = '{"operator":"one_of","values":["g","kg"]}'
_UNITS_DEFAULT = '{"operator":"one_of","values":[' + ",".join(f'"{u}"' for u in C.DEFAULT_ALLOWED_UNITS) + "]}"
# the feed in mixed shapes: a tag, a list of tags or of unknown ones; parameters as text, object or list; types of its own
EXTRA_VIEWS["vx_feed"] = """
SELECT * REPLACE (CASE WHEN source_rank % 23 = 0 THEN 'SPECIAL' WHEN source_rank % 23 = 1 THEN NULL ELSE validation_type END AS validation_type,
    CASE WHEN source_rank % 10 = 2 THEN '{"mandatory":false}' WHEN source_rank % 10 = 5 THEN '{"allowed_units":["g","kg"]}' ELSE parameters END AS parameters),
  CASE source_rank % 4 WHEN 0 THEN 'Chapter II' WHEN 1 THEN 'Retail sale of packages' WHEN 2 THEN 'Chapter V' END AS chapter,
  CASE WHEN source_rank % 46 = 0 THEN 'OWN_CHECK' WHEN source_rank % 46 = 1 THEN 'date' END AS rule_type,
  CASE WHEN source_rank % 69 = 0 THEN '{"operator":"present"}' WHEN source_rank % 2 = 0 THEN '{}' END AS own,
  CASE source_rank % 31 WHEN 0 THEN true WHEN 1 THEN false END AS own_required
FROM fx_rules_raw
"""


def mixed_feed(spark, sf):
    """The rule list as lines of JSON whose fields change their shape from rule to rule, read as variants."""
    raw = fx.rules_raw(spark, sf)
    rank = F.col("source_rank")
    tags = F.when(rank % 12 == 6, F.lit('["x-ray", "pre_packaged_general"]')).when(rank % 12 == 7, '["frozen", "chilled"]').when(rank % 12 == 8, "[]")
    # a text in JSON is quoted, an object or list is not
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[(.*)\]$", "$1")
    odd = F.when(rank % 10 == 2, F.lit('{"mandatory":false}')).when(rank % 10 == 5, '{"allowed_units":["g","kg"]}').when(
        F.col("parameters") == "not json", F.when(rank % 2 == 0, F.lit("[1]")).otherwise(quoted(F.col("parameters"))))
    return raw.withColumns({
        "applicability": F.parse_json(F.coalesce(tags, quoted(F.col("applicability")))),
        "parameters": F.parse_json(F.coalesce(odd, quoted(F.col("parameters")))),
        "provision": F.parse_json(F.expr("CASE source_rank % 4 WHEN 0 THEN '{\"chapter\": \"Chapter II\"}' WHEN 1 THEN '{\"chapter\": \"Retail sale of packages\"}' WHEN 2 THEN '{\"chapter\": \"Chapter V\"}' ELSE '{}' END")),
        "validation_type": F.when(rank % 23 == 0, "SPECIAL").when(rank % 23 != 1, F.col("validation_type")),
        "rule_type": F.when(rank % 46 == 0, "OWN_CHECK").when(rank % 46 == 1, "date"),
        "condition": F.parse_json(F.when(rank % 69 == 0, '{"operator":"present"}').when(rank % 2 == 0, "{}")),
        "required": F.when(rank % 31 == 0, True).when(rank % 31 == 1, False),
    })


_KIND = "upper(coalesce(validation_type, rule_type, 'PRESENCE'))"
_PLAIN = "CASE WHEN parameters = 'not json' THEN '{}' ELSE parameters END"
query("canonicalise_rules", f"""
SELECT rule_id, source_rank,
  CASE source_rank % 12 WHEN 6 THEN 'ALL' WHEN 7 THEN 'frozen, chilled' WHEN 8 THEN 'ALL' ELSE {_APPL} END AS product_category, field AS field_name,
  CASE WHEN {_KIND} IN ({sql_list(C.RULE_TYPE_ALIASES)}) THEN {sql_map(C.RULE_TYPE_ALIASES, _KIND, "''")} ELSE coalesce(rule_type, 'MANDATORY_FIELD') END AS rule_type,
  CASE {_KIND} WHEN 'PRESENCE' THEN '{{"operator":"present"}}'
    WHEN 'UNIT' THEN CASE WHEN source_rank % 5 = 0 THEN '{_UNITS_JSON}' ELSE '{_UNITS_DEFAULT}' END
    WHEN 'DATE' THEN '{{"operator":"is_valid_date","format":"DD/MM/YYYY or MM/YYYY"}}'
    ELSE CASE WHEN {_KIND} NOT IN ({sql_list(C.RULE_TYPE_ALIASES)}) AND own <> '{{}}' THEN own ELSE {_PLAIN} END END AS condition,
  coalesce(own_required, rule_id NOT IN ({sql_list(C.NOT_REQUIRED_RULE_IDS)}) AND NOT contains(parameters, 'mandatory')
    AND coalesce(contains(chapter, 'II') OR contains(chapter, 'Retail sale'), false) AND {_KIND} NOT IN ('APPLICABILITY_EXCLUSION', 'DIMENSION')) AS required,
  severity, verification_status <> 'DEPRECATED' AS is_active FROM vx_feed
""")(lambda spark, sf: ap.canonicalise_rules(mixed_feed(spark, sf)).select(
    "rule_id", "source_rank", "product_category", "field_name", "rule_type", "condition", "required", "severity", "is_active"))

query("rule_type_alias", f"SELECT rule_id, source_rank, {sql_map(C.RULE_TYPE_ALIASES, 'validation_type', 'validation_type')} AS rule_type FROM fx_rules_raw")(
    lambda spark, sf: fx.rules_raw(spark, sf).select(
        "rule_id", "source_rank", ap.canonical_type(F.col("validation_type")).alias("rule_type")))

_MAND = f"CASE WHEN field IN ({sql_list(C.OPTIONAL_FIELDS)}) THEN false WHEN field IN ({sql_list(C.CORE_FIELDS)}) THEN true ELSE source_rank % 3 = 0 END"


def flagged(spark, sf):
    rules = fx.rules_raw(spark, sf).selectExpr("rule_id", "source_rank", "field AS field_name", "source_rank % 3 = 0 AS required", "description")
    return rules.withColumn("is_mandatory", ap.mandatory_flag(rules))


query("mandatory_flag", f"SELECT rule_id, source_rank, {_MAND} AS is_mandatory FROM fx_rules_raw")(
    lambda spark, sf: flagged(spark, sf).select("rule_id", "source_rank", "is_mandatory"))
query("expected_text", f"""
SELECT rule_id, source_rank, CASE WHEN NOT {_MAND} THEN 'Optional field' WHEN source_rank % 4 = 0 THEN 'Must be declared on the package.'
  WHEN source_rank % 5 = 0 THEN 'Must be declared on the package.' ELSE description END AS expected FROM fx_rules_raw
""")(lambda spark, sf: flagged(spark, sf).select("rule_id", "source_rank", ap.expected_text(
    F.col("is_mandatory"), F.expr("CASE WHEN source_rank % 4 = 0 THEN 'an optional mark' WHEN source_rank % 5 = 0 THEN '' ELSE description END")).alias("expected")))

_RETIRED = sql_list(C.RETIRED_RULE_IDS)
query("dedup_rules", f"""
SELECT rule_id, min(source_rank) AS source_rank, arg_min(field, source_rank) AS field FROM fx_rules_raw
WHERE rule_id NOT IN ({_RETIRED}) GROUP BY rule_id
""")(lambda spark, sf: ap.dedup_rules(fx.rules_raw(spark, sf)).select("rule_id", "source_rank", "field"))
query("except_retired", f"SELECT rule_id, source_rank FROM fx_rules_raw WHERE rule_id NOT IN ({_RETIRED})")(
    lambda spark, sf: fx.rules_raw(spark, sf).where(~F.col("rule_id").isin(C.RETIRED_RULE_IDS)).select("rule_id", "source_rank"))
query("union_catalogues", f"""
SELECT rule_id, arg_min(src, (src, source_rank)) AS src, arg_min(source_rank, (src, source_rank)) AS source_rank FROM (
SELECT rule_id, 1 AS src, source_rank FROM fx_rules_raw WHERE severity = 'LOW' UNION ALL SELECT rule_id, 2, source_rank FROM fx_rules_raw) t
WHERE rule_id NOT IN ({_RETIRED}) GROUP BY rule_id
""")(lambda spark, sf: ap.dedup_rules(
    fx.rules_raw(spark, sf).where("severity = 'LOW'").select("rule_id", F.lit(1).alias("src"), "source_rank").unionByName(
        fx.rules_raw(spark, sf).select("rule_id", F.lit(2).alias("src"), "source_rank")).withColumn("rank", F.struct("src", "source_rank")),
    "rank").select("rule_id", "src", "source_rank"))

_RULE_ROWS = "rule_id, source_rank, severity"
query("rule_search", f"""
SELECT {_RULE_ROWS} FROM fx_rules_raw WHERE lower(rule_id) LIKE '%1%' OR lower(field) LIKE '%1%' OR lower(description) LIKE '%1%'
""")(lambda spark, sf: ledger.rule_search(
    fx.rules_raw(spark, sf).withColumns({"target_parameter": F.lit(None).cast("string"), "field_name": F.col("field"),
                                         "statutory_reference": F.lit(None).cast("string"), "regulation_section": F.col("description")}), "1")
     .select("rule_id", "source_rank", "severity"))
query("rule_list_filter", f"""
SELECT rule_id, source_rank FROM fx_rules_raw WHERE verification_status <> 'DEPRECATED' AND {_APPL} ILIKE '%food%'
""")(lambda spark, sf: ledger.rule_list(
    ap.canonicalise_rules(fx.rules_raw(spark, sf)).withColumn("regulation", F.lit("x")), "Food", True).select("rule_id", "source_rank"))

# ------------------------------------------------------------------- evaluation


def screened(spark, sf):
    return screening.screen(packages(spark, sf), declarations(spark, sf), catalog.rules(spark), TODAY)


# pieces of the verdict, written out again for the oracle
_COND = "json_extract_string(condition, '$.{}')"
_DET = "v IS NOT NULL"
_MISSING = "CASE WHEN NOT mand THEN 'NOT_APPLICABLE' WHEN NOT {q} THEN 'NEEDS_REVIEW' WHEN overall >= 85 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END"
_MISS_Q, _MISS = _MISSING.format(q="quality_ok"), _MISSING.format(q="true")
_SOFT = "CASE WHEN conf >= 75 THEN 'FAIL' ELSE 'REVIEW' END"
_TAXY = sql_any("lower(v)", C.TAX_WORDS)
_LIST = "list_transform(cast(json_extract(condition, '$.values') AS varchar[]), lambda x: lower(x))"
_UNIT_OF = sql_map(C.UNIT_SPELLINGS, "lower(trim(v))", "lower(trim(v))")
_NUM_OF = r"try_cast(nullif(regexp_extract(v, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS double)"
_FIRST_UNIT = rf"coalesce(nullif(regexp_extract(q, {_UNIT_RX}, 1), ''), NULL)"


def _field_value(field: str, column: str) -> str:
    return f"(SELECT {column} FROM vx_resolved r WHERE r.inspection_id = a.inspection_id AND r.field = {field})"


EXTRA_VIEWS["vx_pairs"] = f"""
SELECT a.inspection_id, r.rule_id, r.field_name, r.rule_type, r.condition, r.severity, p.overall_confidence AS overall, p.quality_ok,
  CASE WHEN r.field_name IN ({sql_list(C.CORE_FIELDS)}) THEN true ELSE r.required END AS mand, s.value AS v, coalesce(s.confidence, 0) AS conf,
  m.value AS made, c.value AS origin, b.value AS batch
FROM vx_applicable a JOIN vx_rules r USING (rule_id) JOIN vx_packages p USING (inspection_id)
LEFT JOIN vx_resolved s ON s.inspection_id = a.inspection_id AND s.field = r.field_name
LEFT JOIN vx_resolved m ON m.inspection_id = a.inspection_id AND m.field = 'manufacturing_date'
LEFT JOIN vx_resolved c ON c.inspection_id = a.inspection_id AND c.field = 'country_of_origin'
LEFT JOIN vx_resolved b ON b.inspection_id = a.inspection_id AND b.field = 'batch_number'
WHERE r.field_name NOT IN ('unit_of_measurement', 'mrp_inclusive_tax', 'unit_sale_price')
"""
_DATE_V, _DATE_M = sql_label_date("v"), sql_label_date("made")
EXTRA_VIEWS["vx_base_verdicts"] = f"""
SELECT inspection_id, rule_id, severity, CASE
  WHEN field_name = 'mrp' THEN CASE WHEN (CASE WHEN {_DET} THEN conf ELSE overall END) < 85 THEN 'NEEDS_REVIEW'
    WHEN NOT ({_DET}) THEN 'FAIL' ELSE 'PASS' END
  WHEN rule_type IN ('MANDATORY_FIELD', 'PRESENCE') THEN CASE WHEN {_DET} THEN CASE WHEN conf >= 75 THEN 'PASS' ELSE 'NEEDS_REVIEW' END ELSE {_MISS_Q} END
  WHEN rule_type = 'CONDITIONAL_RULE' THEN CASE WHEN lower(coalesce(origin, '')) <> 'nepal' THEN 'PASS' WHEN batch IS NULL THEN {_MISS} ELSE 'PASS' END
  WHEN NOT ({_DET}) THEN {_MISS}
  WHEN rule_type = 'TEXT_CHECK' THEN CASE WHEN len(list_filter({_LIST}, lambda x: NOT contains(lower(v), x))) = 0 THEN 'PASS' ELSE {_SOFT} END
  WHEN rule_type = 'RANGE_CHECK' THEN CASE WHEN {_NUM_OF} IS NULL THEN CASE WHEN NOT mand THEN 'NOT_APPLICABLE' WHEN overall >= 85 THEN 'FAIL' ELSE 'REVIEW' END
    WHEN {_NUM_OF} BETWEEN 2 AND 45 THEN 'PASS' ELSE {_SOFT} END
  WHEN rule_type = 'FORMAT_CHECK' THEN CASE WHEN regexp_matches(trim(v), '(?i)' || {_COND.format('pattern')})
    OR (field_name = 'fssai_license' AND regexp_matches(lower(v), 'fssai|logo|verified')) THEN 'PASS' ELSE {_SOFT} END
  WHEN rule_id = 'PK-06-1-D-PAST' THEN CASE WHEN dv IS NULL AND regexp_matches(lower(v), '\\b(month|months|year|years|days)\\b') THEN 'PASS'
    WHEN dv IS NULL THEN CASE WHEN NOT mand THEN 'NOT_APPLICABLE' WHEN overall >= 85 THEN 'FAIL' ELSE 'REVIEW' END
    WHEN dv <= {TODAY_SQL} THEN 'PASS' WHEN dv - {TODAY_SQL} <= 31 THEN 'REVIEW' ELSE {_SOFT} END
  WHEN rule_id = 'FD-05-3-EXP' THEN CASE WHEN dv IS NULL AND regexp_matches(lower(v), '\\b(month|months|year|years|days)\\b') THEN 'PASS'
    WHEN dv IS NULL THEN CASE WHEN NOT mand THEN 'NOT_APPLICABLE' WHEN overall >= 85 THEN 'FAIL' ELSE 'REVIEW' END
    WHEN dm IS NULL THEN 'REVIEW' WHEN dv >= dm THEN 'PASS' ELSE {_SOFT} END
  ELSE 'PASS' END AS status FROM (SELECT *, {_DATE_V} AS dv, {_DATE_M} AS dm FROM vx_pairs) t
"""

_MISSING_CORE = "CASE WHEN overall_confidence >= 85 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END"
EXTRA_VIEWS["vx_verdicts"] = f"""
SELECT inspection_id, rule_id, severity, status FROM vx_base_verdicts
UNION ALL SELECT a.inspection_id, a.rule_id, 'HIGH', CASE WHEN (CASE WHEN s.value IS NULL THEN overall_confidence ELSE s.confidence END) < 85 THEN 'NEEDS_REVIEW'
    WHEN s.value IS NULL THEN 'FAIL' ELSE 'PASS' END
  FROM vx_applicable a JOIN vx_packages USING (inspection_id) LEFT JOIN vx_given s ON s.inspection_id = a.inspection_id AND s.field = 'mrp_inclusive_tax'
  WHERE a.rule_id = 'PK-06-1-E-TAX'
UNION ALL SELECT a.inspection_id, a.rule_id, 'HIGH', CASE WHEN s.value IS NULL THEN {_MISSING_CORE}
    WHEN {sql_map(C.UNIT_SPELLINGS, 'lower(s.value)', 'lower(s.value)')} IN ('g', 'kg', 'mg', 'ml', 'l') THEN 'PASS' WHEN s.confidence >= 75 THEN 'FAIL' ELSE 'REVIEW' END
  FROM vx_applicable a JOIN vx_packages USING (inspection_id) LEFT JOIN vx_resolved s ON s.inspection_id = a.inspection_id AND s.field = 'unit_of_measurement'
  WHERE a.rule_id = 'PK-06-1-C-UNIT'
UNION ALL SELECT a.inspection_id, a.rule_id, 'MEDIUM', CASE WHEN s.value IS NOT NULL OR (m.value IS NOT NULL AND q.value IS NOT NULL) THEN 'PASS' ELSE {_MISSING_CORE} END
  FROM vx_applicable a JOIN vx_packages USING (inspection_id) LEFT JOIN vx_resolved s ON s.inspection_id = a.inspection_id AND s.field = 'unit_sale_price'
  LEFT JOIN (SELECT * FROM vx_decl WHERE field_name = 'mrp') m ON m.inspection_id = a.inspection_id
  LEFT JOIN (SELECT * FROM vx_decl WHERE field_name = 'net_quantity') q ON q.inspection_id = a.inspection_id WHERE a.rule_id = 'PK-10-USP'
"""

query("evaluate_all", "SELECT inspection_id, rule_id, status FROM vx_verdicts")(
    lambda spark, sf: screened(spark, sf).select("inspection_id", "rule_id", "status"))

_KINDS = {
    "eval_mandatory": "rule_type IN ('MANDATORY_FIELD', 'PRESENCE') AND field_name <> 'mrp'",
    "eval_format": "rule_type = 'FORMAT_CHECK'",
    "eval_range": "rule_type = 'RANGE_CHECK'",
    "eval_conditional": "rule_type = 'CONDITIONAL_RULE'",
    "eval_date": "rule_type = 'DATE_CHECK'",
    "eval_text": "rule_type = 'TEXT_CHECK'",
    "eval_price_verdict": "field_name = 'mrp'",
}
for _name, _where in _KINDS.items():
    query(_name, f"""
SELECT v.inspection_id, v.rule_id, v.status FROM vx_verdicts v JOIN vx_rules r USING (rule_id) WHERE {_where}
""")(lambda spark, sf, w=_where: screening.screen(
        packages(spark, sf), declarations(spark, sf),
        catalog.rules(spark).where(w), TODAY).select("inspection_id", "rule_id", "status"))

query("eval_value", rf"""
SELECT a.inspection_id, a.rule_id, CASE WHEN u IS NULL THEN CASE WHEN overall_confidence >= 85 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END
  WHEN {sql_map(C.UNIT_SPELLINGS, 'lower(u)', 'lower(u)')} IN ('g', 'kg', 'mg', 'ml', 'l') THEN 'PASS' WHEN qc >= 75 THEN 'FAIL' ELSE 'REVIEW' END AS status
FROM vx_applicable a JOIN vx_packages p USING (inspection_id)
LEFT JOIN (SELECT inspection_id, qc, nullif(regexp_extract(q, {_UNIT_RX}, 1), '') AS u FROM vx_pq) q USING (inspection_id)
WHERE a.rule_id = 'PK-06-1-C-UNIT'
""")(lambda spark, sf: screening.screen(
    packages(spark, sf), priced(spark, sf), catalog.rules(spark).where("rule_id = 'PK-06-1-C-UNIT'"), TODAY).select(
    "inspection_id", "rule_id", "status"))

EXTRA_VIEWS["vx_said"] = """
SELECT a.inspection_id, a.rule_id, s.value AS v FROM vx_applicable a JOIN vx_rules r USING (rule_id)
LEFT JOIN vx_given s ON s.inspection_id = a.inspection_id AND s.field = r.field_name
"""
query("adjudicate_missing", """
SELECT v.inspection_id, v.rule_id, v.status FROM vx_verdicts v JOIN vx_rules r USING (rule_id)
LEFT JOIN (SELECT inspection_id, field FROM vx_given WHERE value IS NOT NULL) s ON s.inspection_id = v.inspection_id AND s.field = r.field_name
WHERE s.inspection_id IS NULL
""")(lambda spark, sf: screened(spark, sf).where("extracted_value IS NULL").select(
    "inspection_id", "rule_id", "status"))

query("confidence_scale", f"SELECT inspection_id, line_no, round({_SCALED}, 4) AS confidence FROM vx_decl")(
    lambda spark, sf: declarations(spark, sf).select(
        "inspection_id", "line_no", F.round(vx.scaled_confidence("confidence"), 4).alias("confidence")))

query("evidence_column", """
SELECT inspection_id, rule_id, CASE WHEN v IS NOT NULL THEN 'FOUND' ELSE 'NO_RELIABLE_OCR_EVIDENCE_FOUND' END AS evidence_status FROM vx_said
""")(lambda spark, sf: screened(spark, sf).select("inspection_id", "rule_id", "evidence_status"))

_NORM_FIELD = "CASE line_no WHEN 2 THEN 'net_quantity' WHEN 3 THEN 'mrp' WHEN 4 THEN 'mfg_date' WHEN 5 THEN 'expiry_date' WHEN 7 THEN 'fssai_license' WHEN 12 THEN 'unit' ELSE 'note' END"
_NT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_NT_D = rf"regexp_replace({_NT}, '[^0-9]', '', 'g')"
query("normalise_field", rf"""
SELECT inspection_id, line_no, CASE line_no
  WHEN 3 THEN CASE WHEN mv % 1 = 0 THEN concat('₹', cast(mv AS bigint)) ELSE printf('₹%.2f', mv) END
  WHEN 2 THEN concat(CASE WHEN qv % 1 = 0 THEN cast(cast(qv AS bigint) AS varchar) ELSE cast(qv AS varchar) END, ' ', {sql_map(C.UNIT_SPELLINGS, 'lower(qu)', 'lower(qu)')})
  WHEN 12 THEN lower(t) WHEN 7 THEN CASE WHEN length({_NT_D}) = 14 THEN {_NT_D} ELSE t END
  WHEN 4 THEN coalesce(strftime(d, '%d/%m/%Y'), t) WHEN 5 THEN coalesce(strftime(d, '%d/%m/%Y'), t) ELSE t END AS normalized_value,
  CASE line_no WHEN 3 THEN mv WHEN 2 THEN qv END AS numeric_value, CASE WHEN line_no IN (4, 5) THEN d END AS date_value
FROM (SELECT inspection_id, line_no, text, {_NT} AS t, try_cast(nullif(regexp_extract({_NT}, '([0-9]+(?:\.[0-9]{{1,2}})?)', 1), '') AS double) AS mv,
  try_cast(nullif(regexp_extract({_NT}, '{_QTY_RX}', 1), '') AS double) AS qv, regexp_extract({_NT}, '{_QTY_RX}', 2) AS qu, {sql_label_date(_NT)} AS d FROM fx_label_lines) a
""")(lambda spark, sf: fx.label_lines(spark, sf).select("inspection_id", "line_no", *[
    c.alias(n) for n, c in vx.normalised_parts(F.expr(_NORM_FIELD), F.col("text")).items() if n in ("normalized_value", "numeric_value", "date_value")]))

_NAME_UP = "upper(coalesce(name, ''))"
query("infer_category", f"""
SELECT p.inspection_id, coalesce(category, '') IN ('', 'ALL') AS category_inferred, CASE WHEN coalesce(category, '') NOT IN ('', 'ALL') THEN category
  WHEN lic IS NOT NULL OR {sql_any(_NAME_UP, C.FOOD_TERMS)} THEN 'Food & Beverages' WHEN {sql_any(_NAME_UP, C.COSMETIC_TERMS)} THEN 'Cosmetics'
  WHEN {sql_any(_NAME_UP, C.PHARMA_TERMS)} THEN 'Pharmaceuticals' ELSE 'ALL' END AS category FROM vx_packages p
LEFT JOIN (SELECT inspection_id, max(text) FILTER (line_no = 1) AS name, max(text) FILTER (line_no = 7 AND seq % 2 = 0) AS lic FROM fx_label_lines GROUP BY 1) d USING (inspection_id)
""")(lambda spark, sf: screening.infer_category(packages(spark, sf), fx.label_lines(spark, sf).selectExpr(
    "inspection_id", "CASE WHEN line_no = 1 THEN 'product_name' WHEN line_no = 7 AND seq % 2 = 0 THEN 'fssai_license' ELSE 'x' END AS field_name",
    "text AS value")).select("inspection_id", "category_inferred", "category"))

_ASKED = [*C.BOX_FALLBACKS, "barcode"]
query("bbox_fallback", f"""
SELECT c.inspection_id, c.field_name, bx IS NOT NULL AS from_fallback, bx AS x1 FROM (
SELECT inspection_id, unnest([{sql_list(_ASKED)}]) AS field_name FROM vx_packages) c
LEFT JOIN (SELECT d.inspection_id, b.field, arg_min(d.x1, b.priority) AS bx FROM vx_decl d JOIN vx_box_fallbacks b ON b.candidate = d.field_name
  GROUP BY d.inspection_id, b.field) t ON t.inspection_id = c.inspection_id AND t.field = c.field_name
""")(lambda spark, sf: tk.box_fallback(
    packages(spark, sf).select("inspection_id", F.explode(F.array(*[F.lit(f) for f in _ASKED])).alias("field_name"))
    .withColumn("box", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double>")),
    declarations(spark, sf), catalog.box_fallback_table(spark)).select("inspection_id", "field_name", "from_fallback", "box.x1"))

# ---------------------------------------------------------------------- roll-up

EXTRA_VIEWS["vx_summary"] = """
SELECT inspection_id, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
  count(*) FILTER (status IN ('NEEDS_REVIEW', 'REVIEW', 'CANNOT_VERIFY')) AS review,
  count(*) FILTER (status IN ('NEEDS_REVIEW', 'NEEDS REVIEW', 'CANNOT_VERIFY')) AS unverified,
  count(*) FILTER (status IN ('NOT_APPLICABLE', 'BYPASSED', 'N/A')) AS bypassed,
  count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL') AS critical FROM fx_checks GROUP BY inspection_id
"""
_OVERALL = "CASE WHEN failed > 0 THEN 'NON-COMPLIANT' WHEN review > 0 THEN 'NEEDS REVIEW' ELSE 'COMPLIANT' END"
EXTRA_VIEWS["vx_judged"] = f"""
SELECT *, CASE WHEN critical > 0 OR failed >= 3 OR percent < 60 THEN 'HIGH' WHEN failed > 0 OR unverified >= 3 OR percent < 85 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (
SELECT *, {_OVERALL} AS overall_status, round(passed / greatest(1, total - bypassed) * 100.0, 1) AS percent FROM vx_summary) t
"""


def judged(spark, sf):
    return ru.judge(fx.checks(spark, sf))


_COUNTS = ["inspection_id", "total", "passed", "failed", "review", "bypassed"]
query("screening_summary", f"SELECT {', '.join(_COUNTS)} FROM vx_summary")(
    lambda spark, sf: ru.screening_summary(fx.checks(spark, sf)).select(*_COUNTS))
query("overall_status", "SELECT inspection_id, overall_status FROM vx_judged")(
    lambda spark, sf: judged(spark, sf).select("inspection_id", "overall_status"))
query("compliance_percent", "SELECT inspection_id, percent FROM vx_judged")(
    lambda spark, sf: judged(spark, sf).select("inspection_id", "percent"))
query("risk_level", """
SELECT inspection_id, risk, CASE risk WHEN 'HIGH' THEN concat(failed, ' failed, ', critical, ' critical')
  WHEN 'MEDIUM' THEN concat(failed, ' failed, ', unverified, ' unverified') ELSE concat('all ', passed, ' passed') END AS risk_reason FROM vx_judged
""")(lambda spark, sf: judged(spark, sf).select("inspection_id", "risk", "risk_reason"))
query("review_status", """
SELECT inspection_id, CASE WHEN overall_status = 'COMPLIANT' THEN '7A COMPLIANT' ELSE '7B VIOLATION' END AS legacy_verdict,
  overall_status <> 'COMPLIANT' AS route_7b_triggered FROM vx_judged
""")(lambda spark, sf: judged(spark, sf).select("inspection_id", "legacy_verdict", "route_7b_triggered"))

EXTRA_VIEWS["vx_rate"] = "SELECT inspection_id, count(DISTINCT field_name) / 6 * 100.0 AS rate FROM vx_decl WHERE field_name IN ('generic_name', 'mrp') AND coalesce(value, '') <> '' GROUP BY 1"
query("field_extraction_rate", "SELECT inspection_id, round(rate, 6) AS rate FROM vx_rate")(
    lambda spark, sf: ru.field_extraction_rate(declarations(spark, sf)).select("inspection_id", F.round("rate", 6).alias("rate")))
query("ocr_confidence_mean", "SELECT inspection_id, round(avg(confidence), 2) AS mean_confidence FROM fx_label_lines GROUP BY 1")(
    lambda spark, sf: ru.ocr_confidence_mean(fx.label_lines(spark, sf)))
query("inspection_confidence", """
SELECT p.inspection_id, greatest(10.0, least(99.0, round(0.30 * quality_score + 0.40 * overall_confidence + 0.30 * coalesce(rate, 0), 1))) AS confidence
FROM vx_packages p LEFT JOIN vx_rate r USING (inspection_id)
""")(lambda spark, sf: packages(spark, sf).join(ru.field_extraction_rate(declarations(spark, sf)), "inspection_id", "left").select(
    "inspection_id", ru.inspection_confidence(F.col("quality_score"), F.col("overall_confidence"), F.coalesce("rate", F.lit(0.0))).alias("confidence")))
query("low_confidence_warning", """
SELECT inspection_id, CASE WHEN round(avg(confidence), 2) < 75 THEN 'Text was not read with high confidence.' END AS warning FROM fx_label_lines GROUP BY 1
""")(lambda spark, sf: ru.ocr_confidence_mean(fx.label_lines(spark, sf)).select(
    "inspection_id", ru.low_confidence_warning(F.col("mean_confidence"), F.lit(1)).alias("warning")))

_IMAGE = [
    "inspection_id", "cast(line_no AS int) AS image_index", "confidence", "confidence - 10 AS quality_score",
    "CASE WHEN line_no % 3 = 1 AND seq % 2 = 0 THEN concat('89', cast(seq AS {s})) END AS barcode", "text AS raw_text",
    "line_no * 1.5 AS ocr_ms", "seq % 7 * 1.0 AS pre_ms", "line_no * 2.5 AS decl_ms",
]
EXTRA_VIEWS["vx_images"] = f"SELECT {', '.join(_IMAGE).replace('{s}', 'varchar')} FROM fx_label_lines"


def images(spark, sf):
    columns = [c.replace("{s}", "string") for c in _IMAGE]
    return fx.label_lines(spark, sf).selectExpr(*columns)


query("multi_image_rollup", """
SELECT inspection_id, max(quality_score) AS quality_score, max(confidence) AS confidence, arg_min(barcode, image_index) FILTER (barcode IS NOT NULL) AS barcode,
  string_agg(raw_text, chr(10) ORDER BY image_index) AS raw_text, cast(round(sum(ocr_ms), 1) AS double) AS ocr_ms, count(*) AS images FROM vx_images GROUP BY 1
""")(lambda spark, sf: ru.multi_image(images(spark, sf)).withColumn("ocr_ms", F.col("ocr_ms").cast("double")))
query("timing_breakdown", """
SELECT inspection_id, cast(round(sum(pre_ms), 1) AS double) AS preprocessing_ms, cast(round(sum(decl_ms) * 0.4, 1) AS double) AS panel_ms,
  cast(round(sum(ocr_ms), 1) AS double) AS ocr_ms, cast(round(sum(decl_ms), 1) AS double) AS extraction_ms,
  cast(round(sum(pre_ms + ocr_ms + decl_ms), 1) AS double) AS total_ms FROM vx_images GROUP BY 1
""")(lambda spark, sf: ru.timing_breakdown(images(spark, sf)).select(
    "inspection_id", *[F.col(c).cast("double").alias(c) for c in ("preprocessing_ms", "panel_ms", "ocr_ms", "extraction_ms", "total_ms")]))

query("batch_summary", """
SELECT *, round(followed / greatest(total, 1) * 100.0, 1) AS rate, round(total_seconds / greatest(total, 1), 2) AS mean_seconds FROM (
SELECT concat('BATCH-', strftime(i.created_at, '%Y%m')) AS batch_id, count(*) AS total, count(*) FILTER (j.overall_status = 'COMPLIANT') AS followed,
  count(*) FILTER (j.overall_status = 'NON-COMPLIANT') AS against_rule, count(*) FILTER (j.overall_status = 'NEEDS REVIEW') AS cannot_verify,
  round(sum(i.quality_score / 10), 2) AS total_seconds FROM vx_judged j JOIN fx_inspections i USING (inspection_id) GROUP BY 1) t
""")(lambda spark, sf: ru.batch_summary(judged(spark, sf).select("inspection_id", "overall_status").join(
    fx.inspections(spark, sf).select("inspection_id", F.concat(F.lit("BATCH-"), F.date_format("created_at", "yyyyMM")).alias("batch_id"),
                                     (F.col("quality_score") / 10).alias("seconds")), "inspection_id")))

query("review_triggers", """
SELECT inspection_id, array_to_string(list_filter([CASE WHEN i.overall_confidence < 75 THEN 'reading confidence is low' END,
  CASE WHEN i.seq % 4 = 0 THEN 'panel is uncertain' END, CASE WHEN i.quality_score < 70 THEN 'image quality is low' END,
  CASE WHEN s.unverified >= 2 THEN concat(s.unverified, ' declarations unverified') END,
  CASE WHEN i.seq % 11 = 0 THEN 'geometry is uncertain' END], lambda x: x IS NOT NULL), '; ') AS triggers,
  i.overall_confidence < 75 OR i.seq % 4 = 0 OR i.quality_score < 70 OR s.unverified >= 2 OR i.seq % 11 = 0 OR s.failed > 0 AS needs_human
FROM vx_summary s JOIN fx_inspections i USING (inspection_id)
""")(lambda spark, sf: ru.screening_summary(fx.checks(spark, sf)).join(fx.inspections(spark, sf), "inspection_id").withColumns({
    "ocr_confidence": F.col("overall_confidence"),
    "panel_status": F.expr("CASE WHEN seq % 4 = 0 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END"),
    "panel_shape": F.expr("CASE WHEN seq % 11 = 0 THEN 'unknown' ELSE 'rectangular' END")}).withColumn("_t", ru.review_triggers()).select(
    "inspection_id", F.array_join("_t", "; ").alias("triggers"), ((F.size("_t") > 0) | (F.col("failed") > 0)).alias("needs_human")))

_NA = "(status = 'NOT_APPLICABLE' OR (NOT is_mandatory AND lower(reason) LIKE '%bypassed%'))"
query("report_decision", f"""
SELECT inspection_id, CASE WHEN c > 0 OR f >= 3 THEN 'NON-COMPLIANT' WHEN f > 0 OR r > 0 THEN 'PARTIALLY COMPLIANT' ELSE 'COMPLIANT' END AS decision FROM (
SELECT inspection_id, count(*) FILTER (status = 'FAIL' AND NOT {_NA}) AS f, count(*) FILTER (status = 'NEEDS_REVIEW' AND NOT {_NA}) AS r,
  count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL' AND NOT {_NA}) AS c FROM fx_checks GROUP BY 1) t
""")(lambda spark, sf: ru.report_decision(fx.checks(spark, sf)).select("inspection_id", "decision"))

query("adjudication_branch", """
SELECT i.inspection_id, CASE WHEN i.overall_status = '7A COMPLIANT' AND coalesce(f, 0) = 0 THEN 'PASS'
  WHEN i.overall_status IN ('7B VIOLATION', 'NON-COMPLIANT') OR coalesce(f, 0) > 0 THEN 'FAIL' ELSE 'REVIEW' END AS branch
FROM fx_inspections i LEFT JOIN (SELECT inspection_id, count(*) FILTER (status = 'FAIL') AS f FROM fx_checks GROUP BY 1) c USING (inspection_id)
""")(lambda spark, sf: ru.adjudication_branch(fx.inspections(spark, sf), fx.checks(spark, sf)))

query("error_isolation", """
SELECT i.inspection_id, coalesce(j.overall_status, 'NEEDS REVIEW') AS overall_status FROM fx_inspections i LEFT JOIN vx_judged j USING (inspection_id)
""")(lambda spark, sf: fx.inspections(spark, sf).select("inspection_id").join(
    judged(spark, sf).select("inspection_id", "overall_status"), "inspection_id", "left").withColumn(
    "overall_status", F.coalesce("overall_status", F.lit("NEEDS REVIEW"))))

_EXPECT = sql_list(C.EXPECTED_FIELDS)
query("extraction_quality", f"""
SELECT tp AS true_positives, fn AS false_negatives, round(tp / greatest(tp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall,
  round(2 * (tp / greatest(tp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp, 1) + tp / greatest(tp + fn, 1), 1e-6), 4) AS f1 FROM (
SELECT cast(sum(n) AS bigint) AS tp, cast(count(*) * 9 - sum(n) AS bigint) AS fn FROM (
  SELECT inspection_id, count(DISTINCT field_name) FILTER (value <> '') AS n FROM vx_decl WHERE field_name IN ({_EXPECT}) GROUP BY 1) a) b
""")(lambda spark, sf: ru.extraction_quality(declarations(spark, sf)))

_GLYPH = "translate(text, '0156', 'OlSG')"
query("character_error_rate", rf"""
SELECT variant, round(avg(levenshtein(r, h) / length(r)), 6) AS cer, count(*) AS n FROM (
SELECT seq % 4 AS variant, upper(regexp_replace(text, '\s+', '', 'g')) AS r,
  upper(regexp_replace(CASE seq % 4 WHEN 0 THEN text WHEN 1 THEN {_GLYPH} WHEN 2 THEN substr(text, 3) ELSE reverse(text) END, '\s+', '', 'g')) AS h
FROM fx_label_lines) t GROUP BY variant
""")(lambda spark, sf: ru.character_error_rate(fx.label_lines(spark, sf).selectExpr(
    "seq % 4 AS variant", "text AS reference",
    f"CASE seq % 4 WHEN 0 THEN text WHEN 1 THEN {_GLYPH} WHEN 2 THEN substr(text, 3) ELSE reverse(text) END AS hypothesis")))

# --------------------------------------------------------------------- measures

def measured(spark, sf):
    return fx.table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE cast(p_size * 20.0 AS double) END AS area",
        "cast(0.5 + p_partkey % 70 / 10.0 AS double) AS height", "CASE p_partkey % 3 WHEN 0 THEN 'embossed' ELSE 'normal' END AS printing",
        "cast(80.0 + p_partkey % 20 AS double) AS confidence", "p_partkey % 5 <> 0 AS scale_ok")


EXTRA_VIEWS["vx_measured"] = """
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE cast(p_size * 20.0 AS double) END AS area, cast(0.5 + p_partkey % 70 / 10.0 AS double) AS height,
  CASE p_partkey % 3 WHEN 0 THEN 'embossed' ELSE 'normal' END AS printing, cast(80.0 + p_partkey % 20 AS double) AS confidence, p_partkey % 5 <> 0 AS scale_ok FROM part
"""
_REQ = """CASE WHEN printing = 'embossed' THEN CASE WHEN area <= 50 THEN 1.5 WHEN area <= 100 THEN 2.0 WHEN area <= 500 THEN 4.0 ELSE 6.0 END
  ELSE CASE WHEN area <= 50 THEN 1.0 WHEN area <= 100 THEN 1.5 WHEN area <= 500 THEN 2.5 WHEN area <= 2500 THEN 4.0 ELSE 6.0 END END"""
query("letter_height", f"""
SELECT p_partkey, required, difference, CASE WHEN area IS NULL OR NOT scale_ok OR confidence < 85 THEN 'NEEDS_OFFICER_VERIFICATION'
  WHEN difference >= 0 THEN 'COMPLIANT' ELSE 'POTENTIAL_VIOLATION' END AS result FROM (
SELECT *, CASE WHEN area IS NOT NULL AND scale_ok THEN round(height - required, 2) END AS difference FROM (
SELECT *, CASE WHEN area IS NOT NULL THEN cast({_REQ} AS double) END AS required FROM vx_measured) a) b
""")(lambda spark, sf: ms.letter_height(measured(spark, sf)).select("p_partkey", "required", "difference", "result"))

query("panel_area", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN round(0.40 * p_size * (pi() * (p_partkey % 9 + 1)), 2) ELSE round(cast(p_size * (p_partkey % 9 + 1) AS double), 2) END AS area FROM part
""")(lambda spark, sf: fx.table(spark, sf, "part").select("p_partkey", ms.panel_area(
    F.when(F.col("p_partkey") % 2 == 0, "Cylindrical").otherwise("rectangular"), F.col("p_size").cast("double"),
    (F.col("p_partkey") % 9 + 1).cast("double")).alias("area")))

query("standard_size", f"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000.0 ELSE p_size * 10.0 END AS in_base,
  CASE WHEN p_partkey % 2 = 0 THEN p_size * 1000.0 ELSE p_size * 10.0 END IN (50, 100, 200, 500, 1000, 2000, 5000) AS is_standard FROM part
""")(lambda spark, sf: ms.standard_size(fx.table(spark, sf, "part").selectExpr(
    "p_partkey", "cast(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size * 10 END AS double) AS quantity",
    "CASE WHEN p_partkey % 2 = 0 THEN 'KG' ELSE 'g' END AS unit")).select("p_partkey", "in_base", "is_standard"))

_TOL = "CASE WHEN q <= 50 THEN 9.0 WHEN q <= 100 THEN 4.5 WHEN q <= 200 THEN 4.5 WHEN q <= 500 THEN 3.0 WHEN q <= 1000 THEN 15.0 ELSE 1.5 END"
_TOLK = "CASE WHEN q <= 50 THEN 'percent' WHEN q <= 100 THEN 'fixed_g' WHEN q <= 500 THEN 'percent' WHEN q <= 1000 THEN 'fixed_g' ELSE 'percent' END"
_SHOW = """CASE WHEN u = 'kg' THEN CASE WHEN s <= 1 THEN '15.0 g' ELSE '1.5%' END WHEN s <= 50 THEN '9.0%' WHEN s <= 100 THEN '4.5 g' WHEN s <= 200 THEN '4.5%'
  WHEN s <= 300 THEN '9.0 g' WHEN s <= 500 THEN '3.0%' WHEN s <= 1000 THEN '15.0 g' ELSE '1.5%' END"""
query("quantity_tolerance", f"""
SELECT p_partkey, {_TOL} AS error, {_TOLK} AS kind, {_SHOW} AS shown FROM (
SELECT p_partkey, p_size * 30.0 AS q, CASE WHEN p_partkey % 2 = 0 THEN p_size / 10.0 ELSE p_size * 30.0 END AS s, CASE WHEN p_partkey % 2 = 0 THEN 'kg' ELSE 'g' END AS u FROM part) t
""")(lambda spark, sf: ms.tolerance(fx.table(spark, sf, "part").selectExpr(
    "p_partkey", "cast(p_size * 30 AS double) AS base_quantity", "cast(CASE WHEN p_partkey % 2 = 0 THEN p_size / 10.0 ELSE p_size * 30.0 END AS double) AS quantity",
    "CASE WHEN p_partkey % 2 = 0 THEN 'kg' ELSE 'g' END AS unit")).select("p_partkey", "error", "kind", "shown"))

query("bracket_lookup", """
SELECT p_partkey, CASE WHEN a <= 50 THEN 1.5 WHEN a <= 200 THEN 2.0 WHEN a <= 1000 THEN 4.0 ELSE 6.0 END AS min_height FROM (SELECT p_partkey, p_size * 25.0 AS a FROM part) t
""")(lambda spark, sf: ms.bracket_lookup(fx.table(spark, sf, "part").selectExpr("p_partkey", "cast(p_size * 25 AS double) AS a"), "a",
                                         C.PANEL_MIN_HEIGHTS, ["min_height"]).select("p_partkey", "min_height"))

_PANEL = """p_partkey, 100 + p_partkey % 900 AS w, 100 + p_partkey * 7 % 900 AS h, 0.70 + p_partkey % 30 / 100.0 AS solidity, p_partkey % 3 = 0 AS four_corners,
  p_partkey % 50 - 10 AS skew, p_partkey % 10 <> 0 AS has_contour"""
EXTRA_VIEWS["vx_panels"] = f"SELECT {_PANEL} FROM part"
_CONF = """CASE WHEN has_contour THEN greatest(10.0, least(99.0, 70.0 + CASE WHEN four_corners THEN 20 ELSE 0 END + CASE WHEN solidity BETWEEN 0.75 AND 1.0 THEN 10 ELSE 0 END
  - CASE WHEN abs(skew) > 25 THEN 15 ELSE 0 END)) ELSE 45.0 END"""
query("panel_shape", f"""
SELECT p_partkey, shape, band, area, CASE WHEN area <= 50 THEN 1.5 WHEN area <= 200 THEN 2.0 WHEN area <= 1000 THEN 4.0 ELSE 6.0 END AS min_height FROM (
SELECT *, CASE shape WHEN 'rectangular' THEN round(wc * hc, 1) WHEN 'cylindrical' THEN round(0.40 * hc * (wc * 3.14159), 1) ELSE round(0.40 * wc * hc, 1) END AS area FROM (
SELECT *, CASE WHEN c >= 80 THEN 'ACCEPTED' WHEN c >= 50 THEN 'REVIEW_REQUIRED' ELSE 'CANNOT_VERIFY' END AS band,
  CASE WHEN c < 50 THEN 'unknown' WHEN w / greatest(h, 1) < 0.65 OR w / greatest(h, 1) > 1.8 THEN 'cylindrical' WHEN solidity < 0.85 THEN 'flexible_pouch' ELSE 'rectangular' END AS shape,
  greatest(2.0, cast(w AS double) / 30) AS wc, greatest(2.0, cast(h AS double) / 30) AS hc FROM (SELECT *, {_CONF} AS c FROM vx_panels) a) b) c
""")(lambda spark, sf: ms.panel_shape(fx.table(spark, sf, "part").selectExpr(
    "p_partkey", "cast(100 + p_partkey % 900 AS double) AS width_px", "cast(100 + p_partkey * 7 % 900 AS double) AS height_px",
    "cast(0.70 + p_partkey % 30 / 100.0 AS double) AS solidity", "CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 5 END AS corners",
    "cast(p_partkey % 50 - 10 AS double) AS skew", "p_partkey % 10 <> 0 AS has_contour")).select("p_partkey", "shape", "band", "area", "min_height"))

query("physical_height", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN round(p_size * (15.0 * 10 / 1500), 2) ELSE round(p_size / 3.0, 1) END AS mm,
  p_partkey % 4 = 2 AS calibrated FROM part
""")(lambda spark, sf: ms.physical_height(fx.table(spark, sf, "part").selectExpr(
    "p_partkey", "cast(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS double) AS height_px",
    "CASE WHEN p_partkey % 2 = 0 THEN 15.0D END AS panel_cm", "1500.0D AS image_px")).select("p_partkey", "mm", "calibrated"))

query("image_quality_score", """
SELECT p_partkey, score, score >= 60 AND blur >= 80 AS passed FROM (SELECT p_partkey, blur, greatest(10, 100 - CASE WHEN blur < 80 THEN 35 WHEN blur < 150 THEN 15 ELSE 0 END
  - CASE WHEN contrast < 35 THEN 25 WHEN contrast < 50 THEN 10 ELSE 0 END - CASE WHEN bright < 50 OR bright > 220 THEN 25 WHEN bright < 70 OR bright > 200 THEN 10 ELSE 0 END) AS score FROM (
SELECT p_partkey, p_partkey % 200 AS blur, p_partkey * 3 % 80 AS contrast, p_partkey * 7 % 256 AS bright FROM part) a) b
""")(lambda spark, sf: ms.image_quality(fx.table(spark, sf, "part").selectExpr(
    "p_partkey", "cast(p_partkey % 200 AS double) AS blur", "cast(p_partkey * 3 % 80 AS double) AS contrast", "cast(p_partkey * 7 % 256 AS double) AS brightness"))
     .select("p_partkey", "score", "passed"))

# ------------------------------------------------------------- whole screenings


def labels_declared(spark, sf):
    return ex.declaration_table(fx.label_lines(spark, sf))


# the same views over extracted declarations and inferred categories
_SAME = {"vx_decl": "vx_label_decl", "vx_packages": "vx_label_packages", "vx_resolved": "vx_label_resolved", "vx_given": "vx_label_given",
         "vx_applicable": "vx_label_applicable", "vx_pairs": "vx_label_pairs",
         "vx_base_verdicts": "vx_label_base_verdicts", "vx_verdicts": "vx_label_verdicts"}


def _on_labels(sql: str) -> str:
    for old, new in _SAME.items():
        sql = re.sub(rf"\b{old}\b", new, sql)
    return sql


EXTRA_VIEWS["vx_label_packages"] = f"""
SELECT p.* REPLACE (CASE WHEN coalesce(category, '') NOT IN ('', 'ALL') THEN category WHEN lic IS NOT NULL OR {sql_any(_NAME_UP, C.FOOD_TERMS)} THEN 'Food & Beverages'
  WHEN {sql_any(_NAME_UP, C.COSMETIC_TERMS)} THEN 'Cosmetics' WHEN {sql_any(_NAME_UP, C.PHARMA_TERMS)} THEN 'Pharmaceuticals' ELSE 'ALL' END AS category)
FROM vx_packages p LEFT JOIN (SELECT inspection_id, max(value) FILTER (field_name = 'product_name') AS name, max(value) FILTER (field_name = 'fssai_license') AS lic
  FROM vx_label_decl GROUP BY 1) d USING (inspection_id)
"""
for _view in ("vx_resolved", "vx_given", "vx_applicable"):
    EXTRA_VIEWS[_SAME[_view]] = _on_labels(EXTRA_VIEWS[_view])
EXTRA_VIEWS["vx_label_pairs"] = f"""
SELECT t.*, d.verdict FROM ({_on_labels(EXTRA_VIEWS['vx_pairs'])}) t
LEFT JOIN vx_label_decl d ON d.inspection_id = t.inspection_id AND d.field_name = 'mrp'
"""
_PLAIN_PRICE = f"WHEN NOT ({_DET}) THEN 'FAIL' ELSE 'PASS' END"
_JUDGED_PRICE = f"WHEN verdict = 'CANNOT_VERIFY' THEN 'NEEDS_REVIEW' WHEN NOT ({_DET}) OR verdict = 'VIOLATION' THEN 'FAIL' ELSE 'PASS' END"
EXTRA_VIEWS["vx_label_base_verdicts"] = _on_labels(EXTRA_VIEWS["vx_base_verdicts"]).replace(_PLAIN_PRICE, _JUDGED_PRICE)
EXTRA_VIEWS["vx_label_verdicts"] = _on_labels(EXTRA_VIEWS["vx_verdicts"])


@query("screen_packages", f"""
SELECT inspection_id, total, passed, failed, review, bypassed, {_OVERALL} AS overall_status, percent,
  CASE WHEN critical > 0 OR failed >= 3 OR percent < 60 THEN 'HIGH' WHEN failed > 0 OR unverified >= 3 OR percent < 85 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN failed > 0 OR review > 0 THEN '7B VIOLATION' ELSE '7A COMPLIANT' END AS legacy_verdict FROM (
SELECT *, round(passed / greatest(1, total - bypassed) * 100.0, 1) AS percent FROM (
SELECT inspection_id, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
  count(*) FILTER (status IN ('NEEDS_REVIEW', 'REVIEW')) AS review, count(*) FILTER (status = 'NEEDS_REVIEW') AS unverified,
  count(*) FILTER (status = 'NOT_APPLICABLE') AS bypassed, count(*) FILTER (status = 'FAIL' AND severity = 'CRITICAL') AS critical
FROM vx_label_verdicts GROUP BY 1) a) b
""")
def screen_packages(spark, sf):
    """Flagship: extract, infer category, judge, roll up; one row per package."""
    from panelmark.session import cut

    decl = cut(labels_declared(spark, sf))
    ready = screening.infer_category(packages(spark, sf), decl)
    checks = screening.screen(ready, decl, catalog.rules(spark), TODAY)
    return ru.judge(checks).select(
        "inspection_id", "total", "passed", "failed", "review", "bypassed", "overall_status", "percent", "risk", "legacy_verdict")


query("screen_declarations", f"""
SELECT inspection_id, total, failed, {_OVERALL} AS overall_status FROM (SELECT inspection_id, count(*) AS total, count(*) FILTER (status = 'FAIL') AS failed,
  count(*) FILTER (status IN ('NEEDS_REVIEW', 'REVIEW')) AS review FROM vx_verdicts GROUP BY 1) t
""")(lambda spark, sf: ru.judge(screened(spark, sf)).select("inspection_id", "total", "failed", "overall_status"))

query("explain_checks")(lambda spark, sf: ms.explain_checks(screened(spark, sf), declarations(spark, sf), catalog.explain_alias_table(spark),
                                                            catalog.box_fallback_table(spark), fx.label_lines(spark, sf)))

# the report's rows over stated checks: every field the report knows by another name, and each way to a value and a box
_TOLD = [*C.BOX_FALLBACKS, *[f for f in C.EXPLAIN_ALIASES if f not in C.BOX_FALLBACKS], "MRP", "barcode"]
_TOLD_NAME = ("CASE field_name WHEN 'quantity' THEN 'net_quantity' WHEN 'pkd' THEN 'manufacturing_date' WHEN 'use_by' THEN 'expiry_date'"
              " WHEN 'customer_care' THEN 'consumer_care' WHEN 'packer' THEN 'manufacturer' ELSE field_name END")
_TOLD_BOX = ("CASE WHEN line_no <> 11 AND line_no <> seq % 13 THEN {} END", ["x1", "y1", "x2", "y2"])
_TOLD_COLUMNS = {
    "rule_id": "concat('E-', cast(line_no AS {s}))",
    "status": "CASE (seq + line_no) % 7 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'N/A' WHEN 3 THEN 'BYPASSED' WHEN 4 THEN 'NOT_APPLICABLE' WHEN 5 THEN 'REVIEW' END",
    "extracted_value": "CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN line_no % 2 = 0 THEN substr(text, 5) END END",
    "observed": "CASE seq % 5 WHEN 0 THEN 'Price: Cannot Verify' WHEN 1 THEN substr(text, 9) WHEN 2 THEN '' WHEN 3 THEN concat('No ', text) END",
    "expected_requirement": "concat('line ', cast(line_no AS {s}))",
    "reason": "CASE WHEN line_no % 3 = 0 THEN 'as read' END",
    "severity": "CASE WHEN line_no % 4 = 0 THEN 'HIGH' ELSE 'LOW' END",
}
_TOLD_GIVEN = "line_no = 9 AND seq % 2 = 0"


def _told(kind: str) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in _TOLD_COLUMNS.items()).replace("{s}", kind)


EXTRA_VIEWS["vx_told_decl"] = f"""
SELECT inspection_id, {_TOLD_NAME} AS field_name, value, {", ".join(f"{_TOLD_BOX[0].format(c)} AS {c}" for c in _TOLD_BOX[1])} FROM vx_decl
"""
EXTRA_VIEWS["vx_explain_aliases"] = "SELECT * FROM (VALUES {}) AS t(field, candidate)".format(
    ", ".join(f"('{f}', '{c}')" for f, c in C.EXPLAIN_ALIASES.items()))
EXTRA_VIEWS["vx_told_checks"] = f"""
SELECT inspection_id, [{sql_list(_TOLD)}][1 + (seq * 5 + line_no) % {len(_TOLD)}] AS field_name, {_told("varchar")},
  CASE WHEN {_TOLD_GIVEN} THEN {{'x1': 1.0, 'y1': 2.0, 'x2': 3.0, 'y2': 4.0}} END AS box FROM fx_label_lines
"""
EXTRA_VIEWS["vx_told_boxed"] = """
SELECT c.inspection_id, rule_id, field_name, CASE WHEN status IN ('NOT_APPLICABLE', 'BYPASSED', 'N/A') THEN 'NOT_APPLICABLE' WHEN status IN ('PASS', 'FAIL') THEN status
    ELSE 'CANNOT_VERIFY' END AS status, coalesce(nullif(extracted_value, ''), nullif(observed, ''), e.value) AS observed, expected_requirement, reason, severity,
  coalesce(e.place, c.box, f.place) AS box, e.place IS NULL AND c.box IS NULL AND f.place IS NOT NULL AS from_fallback
FROM vx_told_checks c
LEFT JOIN (SELECT inspection_id, key, arg_min({'value': value, 'place': place}, (rank, value)) AS e FROM (
  SELECT inspection_id, field_name AS key, 0 AS rank, value, CASE WHEN x1 IS NOT NULL THEN {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} END AS place FROM vx_told_decl WHERE value <> ''
  UNION ALL SELECT inspection_id, field, 1, value, CASE WHEN x1 IS NOT NULL THEN {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} END
    FROM vx_told_decl JOIN vx_explain_aliases ON candidate = field_name WHERE value <> '') u GROUP BY inspection_id, key) t
  ON t.inspection_id = c.inspection_id AND t.key = lower(c.field_name)
LEFT JOIN (SELECT inspection_id, field, arg_min({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}, priority) AS place FROM vx_told_decl JOIN vx_box_fallbacks ON candidate = field_name
  WHERE x1 IS NOT NULL GROUP BY inspection_id, field) f ON f.inspection_id = c.inspection_id AND f.field = lower(c.field_name)
"""


@query("explain_stated_checks", rf"""
SELECT b.inspection_id, b.rule_id, field_name, status, observed, expected_requirement, reason, severity, coalesce(box, place).x1 AS x1, coalesce(box, place).y1 AS y1,
  coalesce(box, place).x2 AS x2, coalesce(box, place).y2 AS y2, 0 AS image_index, from_fallback FROM vx_told_boxed b
LEFT JOIN (SELECT inspection_id, rule_id, arg_min({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, (-score, line_no)) AS place FROM (
  SELECT *, CASE WHEN contains(d, v) OR contains(v, d) THEN 2.0 WHEN num <> '' AND (contains(d, num) OR contains(text, num)) THEN 1.5
    ELSE len(list_intersect({FALLBACK_WORDS.format('v')}, {FALLBACK_WORDS.format('d')})) / nullif(len({FALLBACK_WORDS.format('v')}), 0) END AS score FROM (
    SELECT rule_id, t.*, {SQUEEZED.format('observed')} AS v, {SQUEEZED.format('t.text')} AS d, regexp_extract(observed, '[0-9]+(?:\.[0-9]+)?') AS num
    FROM vx_told_boxed JOIN fx_label_lines t USING (inspection_id)
    WHERE box IS NULL AND observed NOT LIKE '%Cannot Verify%' AND observed NOT LIKE '%Not Detected%' AND trim(observed) <> '') u) w
  WHERE score > 0 GROUP BY inspection_id, rule_id) r ON r.inspection_id = b.inspection_id AND r.rule_id = b.rule_id
""")
def explain_stated_checks(spark, sf):
    lines = fx.label_lines(spark, sf)
    place = F.struct(F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(3.0).alias("x2"), F.lit(4.0).alias("y2"))
    name = F.element_at(F.array(*[F.lit(f) for f in _TOLD]), F.expr(f"cast(1 + (seq * 5 + line_no) % {len(_TOLD)} AS int)"))
    told = lines.select("inspection_id", name.alias("field_name"), F.when(F.expr(_TOLD_GIVEN), place).alias("box"),
                        *[F.expr(sql.replace("{s}", "string")).alias(column) for column, sql in _TOLD_COLUMNS.items()])
    decl = declarations(spark, sf).withColumn("field_name", F.expr(_TOLD_NAME)).withColumns(
        {c: F.expr(_TOLD_BOX[0].format(c)) for c in _TOLD_BOX[1]})
    return ms.explain_checks(told, decl, catalog.explain_alias_table(spark), catalog.box_fallback_table(spark), lines)


@query("unrelated_label", """
SELECT inspection_id, contains(upper(t), 'REGRET THE INCONVENIENCE') OR contains(upper(t), 'PAGE COULD NOT BE FOUND')
  OR (NOT has_name AND NOT has_price AND NOT has_quantity AND length(trim(t)) > 0 AND NOT contains(upper(t), 'MRP') AND NOT contains(upper(t), 'QTY')) AS unrelated FROM (
SELECT inspection_id, string_agg(text, chr(10) ORDER BY line_no) AS t, bool_or(line_no = 1 AND seq % 3 = 0) AS has_name, bool_or(line_no = 3 AND text <> '') AS has_price,
  bool_or(line_no = 2 AND text <> '') AS has_quantity FROM (SELECT * REPLACE (CASE WHEN line_no IN (2, 3) AND seq % 4 = 0 THEN '' ELSE text END AS text) FROM fx_label_lines) r GROUP BY inspection_id) u
""")
def _unrelated(spark, sf):
    """Some packages have nothing on the lines of their quantity and price."""
    read = fx.label_lines(spark, sf).withColumn("text", F.expr("CASE WHEN line_no IN (2, 3) AND seq % 4 = 0 THEN '' ELSE text END"))
    return ms.unrelated_label(
        read, F.expr("line_no = 1 AND seq % 3 = 0"), F.expr("line_no = 3 AND text <> ''"), F.expr("line_no = 2 AND text <> ''"))


def _said(no: int) -> str:
    return f"max(text) FILTER (line_no = {no})"


_TAX_WORDING = ["INCLUSIVE OF ALL TAXES", "INCL. OF ALL TAXES", "INCL OF TAXES", "INCLUSIE", "TAES"]
query("five_section_eval", rf"""
SELECT inspection_id, CASE WHEN n IS NULL THEN 'REVIEW' ELSE 'PASS' END AS name_result,
  CASE WHEN p IS NULL OR pc < 60 THEN 'REVIEW' WHEN contains(upper(p), 'TAX') OR lt THEN 'PASS' ELSE 'FAIL' END AS price_result,
  CASE WHEN q IS NULL THEN 'REVIEW' WHEN lower(regexp_extract(q, '{_QTY_RX}', 2)) IN ('g', 'kg', 'ml', 'l', 'count') THEN 'PASS' ELSE 'FAIL' END AS quantity_result,
  CASE WHEN c IS NULL THEN 'REVIEW' WHEN contains(c, '@') AND contains(c, '1800') THEN 'PASS' ELSE 'FAIL' END AS care_result, d IS NOT NULL OR m IS NOT NULL AS dated, sus AS is_suspicious
FROM (SELECT inspection_id, {_said(1)} AS n, {_said(2)} AS q, {_said(3)} AS p, max(confidence) FILTER (line_no = 3) AS pc, {_said(4)} AS d,
  {_said(8)} AS c, {_said(10)} AS m, bool_or({sql_any('upper(text)', _TAX_WORDING)}) AS lt, bool_or({SQL_SUSPICIOUS} IS NOT NULL) AS sus
  FROM fx_label_lines GROUP BY inspection_id) t
""")(lambda spark, sf: ms.five_sections(ms.tagged_boxes(fx.label_lines(spark, sf))).select(
    "inspection_id", "name_result", "price_result", "quantity_result", "care_result", (F.col("date_result") == "PASS").alias("dated"), "is_suspicious"))
