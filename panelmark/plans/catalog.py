"""Constant tables: the rule catalogue and the look-up tables, as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmark import constants as C

CONDITION_SCHEMA = (
    "operator string, values array<string>, expected_value string, value string, substring string, "
    "pattern string, min double, max double, min_value double, max_value double, "
    "compare_with string, if_condition struct<field: string, operator: string, value: string>, "
    "then_condition struct<field: string>"
)

RULE_SCHEMA = (
    "rule_id string, rule_name string, regulation string, regulation_section string, "
    "product_category string, field_name string, rule_type string, condition string, "
    "is_mandatory boolean, required boolean, severity string, error_message string, "
    "explanation string, expected_requirement string, version string, effective_from date, "
    "effective_to date, is_active boolean, source_reference string, statutory_reference string, "
    "target_parameter string, compliance_condition string, violation_condition string"
)

_PACKAGED = "Packaged Commodities Rules"
_FOOD = "Food Labelling Regulations"


def _rule(rule_id, section, category, field, kind, condition, required, severity, message, **more):
    row = {
        "rule_id": rule_id,
        "rule_name": None,
        "regulation": _FOOD if category.startswith("Food") else _PACKAGED,
        "regulation_section": section,
        "product_category": category,
        "field_name": field,
        "rule_type": kind,
        "condition": json.dumps(condition),
        "is_mandatory": None,
        "required": required,
        "severity": severity,
        "error_message": message,
        "explanation": None,
        "expected_requirement": None,
        "version": "2026.1.0",
        "effective_from": None,
        "effective_to": None,
        "is_active": True,
        "source_reference": section,
        "statutory_reference": section,
        "target_parameter": field,
        "compliance_condition": None,
        "violation_condition": message,
    }
    return row | more


RULES = [
    _rule("PK-06-1-A", "Rule 6(1)(a)", "ALL", "manufacturer", "MANDATORY_FIELD",
          {"operator": "present"}, True, "HIGH", "Maker is not named."),
    _rule("PK-06-1-B", "Rule 6(1)(b)", "ALL", "product_name", "MANDATORY_FIELD",
          {"operator": "present"}, True, "HIGH", "Commodity is not named."),
    _rule("PK-06-1-C-QTY", "Rule 6(1)(c)", "ALL", "net_quantity", "MANDATORY_FIELD",
          {"operator": "present"}, True, "CRITICAL", "Net quantity is missing."),
    _rule("PK-06-1-C-UNIT", "Rule 6(1)(c)", "ALL", "unit_of_measurement", "VALUE_CHECK",
          {"operator": "one_of", "values": ["g", "kg", "mg", "ml", "l"]}, True, "HIGH",
          "Unit is not a standard one."),
    _rule("PK-06-1-C-RANGE", "Rule 6(1)(c)", "ALL", "net_quantity", "RANGE_CHECK",
          {"min": 2, "max": 45}, False, "LOW", "Quantity is out of range."),
    _rule("PK-06-1-D-MFG", "Rule 6(1)(d)", "ALL", "manufacturing_date", "PRESENCE",
          {"operator": "present"}, True, "HIGH", "Packing date is missing."),
    _rule("PK-06-1-D-PAST", "Rule 6(1)(d)", "ALL", "manufacturing_date", "DATE_CHECK",
          {"operator": "is_past_or_today"}, False, "MEDIUM", "Packing date lies ahead."),
    _rule("PK-06-1-E-MRP", "Rule 6(1)(e)", "ALL", "mrp", "MANDATORY_FIELD",
          {"operator": "present"}, True, "CRITICAL", "Retail price is missing."),
    _rule("PK-06-1-E-TAX", "Rule 6(1)(e)", "ALL", "mrp_inclusive_tax", "TEXT_CHECK",
          {"operator": "contains_any", "values": ["inclusive of all taxes", "incl. of all taxes"]},
          True, "HIGH", "Price does not say it includes taxes."),
    _rule("PK-06-2-CARE", "Rule 6(2)", "ALL", "consumer_care", "TEXT_CHECK",
          {"operator": "contains_all", "values": ["1800", "@"]}, True, "HIGH",
          "Care contact is incomplete."),
    _rule("PK-06-1-BATCH", "Rule 6(1)", "ALL", "batch_number", "FORMAT_CHECK",
          {"operator": "regex", "pattern": "^B[0-9]{2,3}-X$"}, False, "LOW", "Batch code is odd."),
    _rule("PK-10-USP", "Rule 10", "ALL", "unit_sale_price", "FORMAT_CHECK",
          {"operator": "regex", "pattern": "(?:per|\\/)\\s*(?:g|kg|ml|l|piece|n|unit|count)"},
          False, "MEDIUM", "Unit price has no unit."),
    _rule("PK-06-1-AA", "Rule 6(1)(aa)", "Imported Products, ALL", "country_of_origin",
          "CONDITIONAL_RULE",
          {"if_condition": {"field": "country_of_origin", "operator": "equals", "value": "Nepal"},
           "then_condition": {"field": "batch_number"}}, True, "MEDIUM",
          "Imports need a batch code."),
    _rule("FD-05-1-ING", "Reg 5(1)", "Food & Beverages", "ingredients", "MANDATORY_FIELD",
          {"operator": "present"}, True, "HIGH", "Ingredients are missing."),
    _rule("FD-05-3-EXP", "Reg 5(3)", "Food & Beverages", "expiry_date", "DATE_CHECK",
          {"operator": "date_after_or_equal", "compare_with": "manufacturing_date"}, True, "HIGH",
          "Expiry precedes packing."),
    _rule("FD-05-7-LIC", "Reg 5(7)", "Food & Beverages", "fssai_license", "FORMAT_CHECK",
          {"operator": "regex", "pattern": "^[0-9]{14}$"}, True, "HIGH",
          "Licence number is malformed."),
    _rule("FD-OLD", "Reg 2", "Food & Beverages", "mrp", "MANDATORY_FIELD",
          {"operator": "present"}, True, "LOW", "Superseded.", effective_to="2020-01-01"),
    _rule("FD-OFF", "Reg 3", "Food & Beverages", "mrp", "MANDATORY_FIELD",
          {"operator": "present"}, True, "LOW", "Switched off.", is_active=False),
]


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A constant table: one literal, no Python worker, size known beforehand."""
    array = F.from_json(F.lit(json.dumps(rows)), T.ArrayType(T._parse_datatype_string(schema)))
    return spark.range(1).select(F.explode(array).alias("r")).select("r.*")


def rules(spark: SparkSession) -> DataFrame:
    return literal_table(spark, RULES, RULE_SCHEMA)


def alias_table(spark: SparkSession) -> DataFrame:
    """field, candidate, priority: which declaration may answer for which field."""
    rows = [
        {"field": field, "candidate": candidate, "priority": i + 1}
        for field, candidates in C.FIELD_ALIASES.items()
        for i, candidate in enumerate(candidates)
    ]
    return literal_table(spark, rows, "field string, candidate string, priority int")


def answer_table(spark: SparkSession) -> DataFrame:
    """candidate, answers, sources: fields a declaration may answer for, and those worked out from it (priority 1000)."""
    answers: dict[str, list[dict]] = {}
    for field, candidates in C.FIELD_ALIASES.items():
        for i, candidate in enumerate(candidates):
            answers.setdefault(candidate, []).append({"field": field, "priority": i + 1})
    sources = {"mrp": C.TAX_FIELDS + C.UNIT_PRICE_FIELDS, "net_quantity": C.UNIT_FIELDS + C.UNIT_PRICE_FIELDS}
    rows = [
        {"candidate": name, "answers": answers.get(name, []), "sources": [{"field": f, "priority": 1000} for f in sources.get(name, [])]}
        for name in dict.fromkeys([*answers, *sources])
    ]
    routes = "array<struct<field: string, priority: int>>"
    return literal_table(spark, rows, f"candidate string, answers {routes}, sources {routes}")


def explain_alias_table(spark: SparkSession) -> DataFrame:
    rows = [{"field": f, "candidate": c} for f, c in C.EXPLAIN_ALIASES.items()]
    return literal_table(spark, rows, "field string, candidate string")


def box_fallback_table(spark: SparkSession) -> DataFrame:
    rows = [
        {"field": field, "candidate": candidate, "priority": i + 1}
        for field, candidates in C.BOX_FALLBACKS.items()
        for i, candidate in enumerate(candidates)
    ]
    return literal_table(spark, rows, "field string, candidate string, priority int")


def unit_table(spark: SparkSession) -> DataFrame:
    rows = [
        {"spelling": s, "shown_unit": u, "base_unit": b, "multiplier": m}
        for s, (u, b, m) in C.UNITS.items()
    ]
    return literal_table(
        spark, rows, "spelling string, shown_unit string, base_unit string, multiplier double"
    )
