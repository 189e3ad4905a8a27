"""Rules as data: one plan judges every (package, rule) pair.

packages -> applicable rules -> resolved declaration per field -> verdict.
The declarations of a package travel as one map from field to entry, limited
to the fields the rules ask about, so that rules that compare two fields need
no further join and the whole plan shuffles by package only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions import values as vx
from panelmark.functions.text import has_any, norm_whitespace, text, valid_value
from panelmark.plans import applicability as ap
from panelmark.plans import catalog
from panelmark.session import spread

ENTRY_COLUMNS = {
    "value": "string",
    "confidence": "double",
    "x1": "double",
    "y1": "double",
    "x2": "double",
    "y2": "double",
    "image_index": "int",
    "numeric_value": "double",
    "unit": "string",
    "verdict": "string",
    "tax_in_block": "boolean",
    "raw_line": "string",
}


def standard_declarations(decl: DataFrame) -> DataFrame:
    """Declarations with every entry column present (missing ones null)."""
    columns = [
        (F.col(n) if n in decl.columns else F.lit(None)).cast(t).alias(n)
        for n, t in ENTRY_COLUMNS.items()
    ]
    return decl.select("inspection_id", "field_name", *columns)


def _entry(**replaced: Column) -> Column:
    return F.struct(
        *[replaced.get(n, F.col(n)).cast(t).alias(n) for n, t in ENTRY_COLUMNS.items()]
    )


# --------------------------------------------------------------- resolution


def wanted_fields(rules: DataFrame) -> DataFrame:
    """Fields the rules read: their own, compared, if- and then-fields."""
    fields = F.array(
        F.col("field_name"),
        F.coalesce("cond.compare_with", F.lit("manufacturing_date")),
        F.col("cond.if_condition.field"),
        F.col("cond.then_condition.field"),
    )
    one = rules.select(F.explode(fields).alias("field")).where("field IS NOT NULL")
    return one.select(F.lower(F.trim("field")).alias("field")).distinct()


def _raw_entry() -> Column:
    return F.struct(*ENTRY_COLUMNS)


def derived_declarations(decl: DataFrame) -> DataFrame:
    """Unit from quantity, tax clause from price, unit price from both."""
    source = decl.where(F.col("field_name").isin("mrp", "net_quantity"))
    pick = F.max(F.when(F.col("field_name") == "mrp", _entry()))
    pick_quantity = F.max(F.when(F.col("field_name") == "net_quantity", _entry()))
    wide = source.groupBy("inspection_id").agg(pick.alias("p"), pick_quantity.alias("q"))
    unit, tax, unit_price = _derived_entries(F.col("p"), F.col("q"))

    def item(fields: list[str], entry: Column) -> Column:
        return F.when(entry.isNotNull(), F.struct(F.array(*[F.lit(f) for f in fields]).alias("fields"), entry.alias("entry")))

    items = F.array(item(C.UNIT_FIELDS, unit), item(C.TAX_FIELDS, tax), item(C.UNIT_PRICE_FIELDS, unit_price))
    return (
        wide.select("inspection_id", F.explode(F.array_compact(items)).alias("d"))
        .select("inspection_id", F.explode("d.fields").alias("field"), F.lit(DERIVED).alias("priority"), "d.entry")
    )


def _derived_entries(p: Column, q: Column) -> tuple[Column, Column, Column]:
    """Entries of unit, tax clause and unit price from the price ``p`` and the quantity ``q``; null where they say nothing."""
    unit_pattern = r"(?i)(?:^|\s|[0-9])(g|kg|ml|l|ltr|gm|gms|pcs|units|pieces|n|u)\b"
    number_pattern, amount_pattern = r"([0-9]+(?:\.[0-9]+)?)", r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)"
    stated_unit = F.nullif(q["unit"], F.lit(""))
    default = F.lit(C.DEFAULT_CONFIDENCE)
    unit = F.coalesce(stated_unit, vx.found(text(q["value"]), unit_pattern))
    taxed = (
        F.coalesce(p["tax_in_block"], F.lit(False))
        | F.coalesce(p["verdict"] == "CONFORMING", F.lit(False))
        | has_any(F.lower(F.concat_ws("\n", p["raw_line"], p["value"])), C.TAX_WORDS)
    )
    price = F.coalesce(p["numeric_value"], vx.number(vx.found(text(p["value"]), number_pattern)))
    amount = F.coalesce(q["numeric_value"], vx.number(vx.found(text(q["value"]), amount_pattern)))
    per = F.coalesce(
        F.when(q["numeric_value"].isNull(), vx.found(text(q["value"]), amount_pattern, 2)), stated_unit, F.lit("g"))
    own = F.coalesce(F.nullif(p["confidence"], F.lit(0.0)), default)
    other = F.coalesce(F.nullif(q["confidence"], F.lit(0.0)), default)
    unit_price = F.round(F.try_divide(price, F.when(amount > 0, amount)), 2)

    def entry(source: Column, condition: Column, **replaced: Column) -> Column:
        columns = [replaced.get(n, source[n]).cast(t).alias(n) for n, t in ENTRY_COLUMNS.items()]
        return F.when(source.isNotNull() & condition, F.struct(*columns))

    null = F.lit(None)
    price_text = F.concat(F.lit("Rs. "), vx.plain_number(unit_price), F.lit(" / "), per)
    return (
        entry(q, valid_value(unit), value=unit, confidence=other, numeric_value=null, verdict=null),
        entry(p, taxed, value=F.lit("Inclusive of all taxes"), confidence=own),
        entry(
            p, F.coalesce((price > 0) & unit_price.isNotNull(), F.lit(False)),
            value=price_text, confidence=F.least(own, other), numeric_value=unit_price, unit=per,
            verdict=null, tax_in_block=null, raw_line=null,
        ),
    )


#: priority of what is derived from price and quantity: behind every synonym
DERIVED = 1000


def resolve_aliases(decl: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Best valid declaration per (package, field), synonyms in priority order.

    Each declaration is read once and goes to the fields it may answer for
    (the table of answers is a constant of about a hundred rows, hence the
    broadcast); price and quantity also go to the fields derived from them.
    The choice is a partial aggregate, so a package of any size is reduced
    before the shuffle, and what is derived is worked out from the choice.
    """
    standard = standard_declarations(decl)
    answers = F.broadcast(catalog.answer_table(decl.sparkSession))
    known = standard.join(answers, standard.field_name == answers.candidate, "left")
    none = F.array().cast(answers.schema["answers"].dataType)
    itself = F.array(F.struct(F.col("field_name").alias("field"), F.lit(0).alias("priority")))
    routes = F.concat(
        F.when(valid_value("value"), F.concat(itself, F.coalesce("answers", none))).otherwise(none), F.coalesce("sources", none))
    rows = known.select("inspection_id", "field_name", *ENTRY_COLUMNS, F.explode(routes).alias("_r")).select(
        "inspection_id", "_r.field", "_r.priority", "field_name", _raw_entry().alias("entry"))
    if fields is not None:
        rows = rows.join(fields, "field", "left_semi")
    source = F.col("priority") == DERIVED
    picked = rows.groupBy("inspection_id", "field").agg(
        F.min(F.when(~source, F.struct("priority", "entry"))).alias("_given"),
        F.max(F.when(source & (F.col("field_name") == "mrp"), F.col("entry"))).alias("p"),
        F.max(F.when(source & (F.col("field_name") == "net_quantity"), F.col("entry"))).alias("q"),
    )

    def derived(known: Column) -> Column:
        unit, tax, unit_price = _derived_entries(known["p"], known["q"])
        return (
            F.when(known["field"].isin(C.UNIT_FIELDS), unit).when(known["field"].isin(C.TAX_FIELDS), tax)
            .when(known["field"].isin(C.UNIT_PRICE_FIELDS), unit_price)
        )

    # only worked out where nothing is given; written out in the projection it makes one method too long to be compiled
    picked = picked.withColumn("_derived", F.when(F.col("_given").isNull(), vx.let(F.struct("field", "p", "q"), derived)))
    given = F.struct(*[
        (vx.scaled_confidence("_given.entry.confidence") if n == "confidence" else F.col(f"_given.entry.{n}")).alias(n) for n in ENTRY_COLUMNS])
    return picked.where("_given IS NOT NULL OR _derived IS NOT NULL").select(
        "inspection_id", "field",
        F.when(F.col("_given").isNotNull(), given).otherwise(F.col("_derived")).alias("entry"),
        F.coalesce("_given.priority", F.lit(DERIVED)).alias("priority"),
    )


def normalise_entries(resolved: DataFrame) -> DataFrame:
    """Adds the normalised value and the date to every entry.

    Done once per package and field, before rules multiply the rows; a text is
    cleaned and read as a date once.
    """
    cleaned = resolved.withColumns({"_kind": vx.value_kind(F.col("field")), "_clean": norm_whitespace("entry.value")})
    dated = cleaned.withColumn("_date", vx.date_part(F.col("_kind"), F.col("_clean")))
    normal = F.when(F.col("entry.value").isNotNull(), vx.normal_text(F.col("_kind"), F.col("_clean"), F.col("_date")))
    known = dated.withColumn("_normal", normal)
    entry = F.struct(
        *[F.col(f"entry.{n}").alias(n) for n in ENTRY_COLUMNS],
        F.col("_normal").alias("normalized_value"), F.col("_date").alias("date_value"),
    )
    return known.select("inspection_id", "field", entry.alias("entry"))


def field_maps(resolved: DataFrame) -> DataFrame:
    """One map per package; its size is bounded by the rules' field list.

    The entries of a package lie apart by field, so they are moved as they are:
    a partial list of each would be a list of one, written and read for nothing.
    """
    pairs = F.collect_list(F.struct("field", "entry"))
    return resolved.repartition("inspection_id").groupBy("inspection_id").agg(F.map_from_entries(pairs).alias("fields"))


# --------------------------------------------------------------- evaluation


def _outcome(status: Column | str, reason: Column | str) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(status.alias("status"), reason.alias("reason"))


def _soft_fail(confidence: Column) -> Column:
    """A clear reading fails, an unclear one goes to review."""
    return F.when(confidence >= C.PRESENT_MIN_CONFIDENCE, F.lit("FAIL")).otherwise(F.lit("REVIEW"))


def adjudicate_missing(field: Column, mandatory: Column, confidence: Column, quality_ok: Column) -> Column:
    named = F.concat(F.lit("'"), field, F.lit("' was not found"))
    return (
        F.when(~mandatory, _outcome("NOT_APPLICABLE", "Optional declaration not detected; check bypassed."))
        .when(~quality_ok, _outcome("NEEDS_REVIEW", F.concat(named, F.lit(": image quality is too low."))))
        .when(
            confidence >= C.MISSING_FAIL_CONFIDENCE,
            _outcome("FAIL", F.concat(named, F.lit(" on a clear scan."))),
        )
        .otherwise(_outcome("NEEDS_REVIEW", F.concat(named, F.lit(": the scan is not clear enough."))))
    )


def eval_mandatory(missing: Column, detected: Column, confidence: Column) -> Column:
    return (
        F.when(~detected, missing)
        .when(confidence >= C.PRESENT_MIN_CONFIDENCE, _outcome("PASS", "Present and clearly read."))
        .otherwise(_outcome("NEEDS_REVIEW", "Present, but below the confidence threshold."))
    )


def eval_format(field: Column, missing: Column, detected: Column, raw: Column, normal: Column,
                confidence: Column, error: Column) -> Column:
    operator = F.coalesce("cond.operator", F.lit("regex"))
    listed = F.transform(
        F.coalesce("cond.values", F.array().cast("array<string>")), lambda v: F.lower(v)
    )
    trimmed = F.trim(text(raw))
    target = F.trim(text(F.coalesce(normal, raw)))
    both = F.lower(F.concat(target, F.lit(" "), trimmed))
    fail = _outcome(_soft_fail(confidence), F.coalesce(error, F.lit("Format is not as required.")))
    ok = _outcome("PASS", "Format is as required.")
    measured = (field == "quantity_by_number_wording") & (
        F.lower(target).isin(C.MEASURE_UNITS) | F.lower(trimmed).isin(C.MEASURE_UNITS)
    )
    in_list = F.array_contains(listed, F.lower(target)) | F.array_contains(listed, F.lower(trimmed))
    pattern = F.concat(F.lit("(?i)"), F.when(F.col("pattern_ok"), F.col("pattern")).otherwise(""))
    logo = (field == "fssai_license") & both.rlike("fssai|logo|verified")
    by_pattern = (
        F.when(logo, ok)
        .when(~F.col("pattern_ok"), _outcome("REVIEW", "The rule's pattern is not readable."))
        .when(F.call_function("rlike", target, pattern) | F.call_function("rlike", trimmed, pattern), ok)
        .otherwise(fail)
    )
    return (
        F.when(~detected, missing)
        .when(operator == "contains_all", F.when(F.forall(listed, lambda v: both.contains(v)), ok).otherwise(fail))
        .when(operator == "contains_any", F.when(F.exists(listed, lambda v: both.contains(v)), ok).otherwise(fail))
        .when(operator == "one_of", F.when(measured | in_list, ok).otherwise(fail))
        .when((operator == "regex") | (F.col("pattern") != ""), by_pattern)
        .otherwise(ok)
    )


def eval_range(missing: Column, detected: Column, mandatory: Column, raw: Column, normal: Column,
               overall: Column, confidence: Column, error: Column) -> Column:
    number = F.coalesce(vx.number(normal), vx.number(vx.found(text(raw), r"([0-9]+(?:\.[0-9]+)?)")))
    low = F.coalesce("cond.min_value", "cond.min")
    high = F.coalesce("cond.max_value", "cond.max")
    outside = F.coalesce(number < low, F.lit(False)) | F.coalesce(number > high, F.lit(False))
    return (
        F.when(~detected, missing)
        .when(number.isNull(), _unreadable(mandatory, overall, error))
        .when(outside, _outcome(_soft_fail(confidence), F.coalesce(error, F.lit("Out of range."))))
        .otherwise(_outcome("PASS", "Within range."))
    )


def _unreadable(mandatory: Column, overall: Column, error: Column) -> Column:
    return (
        F.when(
            mandatory & (overall >= C.MISSING_FAIL_CONFIDENCE),
            _outcome("FAIL", F.coalesce(error, F.lit("Could not be read."))),
        )
        .when(mandatory, _outcome("REVIEW", "Could not be read."))
        .otherwise(_outcome("NOT_APPLICABLE", "Optional declaration not detected; check bypassed."))
    )


def _if_field() -> Column:
    return F.lower(F.trim(text("cond.if_condition.field")))


def eval_conditional(field: Column, mandatory: Column, overall: Column) -> Column:
    if_field, if_value, then_value = F.col("if_key"), F.col("if_value"), F.col("then_value")
    shown = F.lower(F.coalesce(if_value, F.lit("")))
    wanted = F.lower(F.coalesce("cond.if_condition.value", F.lit("none")))
    operator = F.coalesce("cond.if_condition.operator", F.lit("equals"))
    fires = (if_field != "") & (
        ((operator == "equals") & (shown == wanted))
        | ((operator == "present") & if_value.isNotNull())
        | ((operator == "contains") & shown.contains(wanted))
    )
    then_field = F.coalesce("cond.then_condition.field", field)
    return (
        F.when(~fires, _outcome("PASS", "Condition does not apply."))
        .when(then_value.isNull(), adjudicate_missing(then_field, mandatory, overall, F.lit(True)))
        .otherwise(_outcome("PASS", "Condition is met."))
    )


def eval_value(missing: Column, detected: Column, raw: Column, normal: Column, confidence: Column,
               error: Column) -> Column:
    operator = F.coalesce("cond.operator", F.lit("one_of"))
    listed = F.transform(
        F.coalesce("cond.values", F.array().cast("array<string>")), lambda v: F.lower(v)
    )
    expected = F.lower(text("cond.expected_value"))
    shown = F.lower(F.trim(text(F.coalesce(normal, raw))))
    ok = _outcome("PASS", "Value is allowed.")
    fail = _outcome(_soft_fail(confidence), F.coalesce(error, F.lit("Value is not allowed.")))
    return (
        F.when(~detected, missing)
        .when(operator.isin("one_of", "in"), F.when(F.array_contains(listed, shown), ok).otherwise(fail))
        .when(operator == "equals", F.when(shown == expected, ok).otherwise(fail))
        .when(
            (operator == "not_equals") & (shown == expected),
            _outcome("FAIL", F.coalesce(error, F.lit("Value is prohibited."))),
        )
        .otherwise(ok)
    )


def eval_date(missing: Column, detected: Column, mandatory: Column, raw: Column, when_: Column,
              overall: Column, confidence: Column, error: Column) -> Column:
    operator = F.coalesce("cond.operator", F.lit("is_valid_date"))
    other_date = F.col("compared_date")
    today = F.col("evaluation_date")
    relative = F.lower(text(raw)).rlike(r"\b(month|months|year|years|days)\b")
    fail = _outcome(_soft_fail(confidence), F.coalesce(error, F.lit("Date is not in order.")))
    ok = _outcome("PASS", "Date is in order.")
    return (
        F.when(~detected, missing)
        .when(when_.isNull() & relative, _outcome("PASS", "Relative shelf life is stated."))
        .when(when_.isNull(), _unreadable(mandatory, overall, error))
        .when(
            operator == "is_past_or_today",
            F.when(when_ <= today, ok)
            .when(F.date_diff(when_, today) <= C.FUTURE_GRACE_DAYS, _outcome("REVIEW", "Slightly ahead of today."))
            .otherwise(fail),
        )
        .when(
            operator == "date_after_or_equal",
            F.when(other_date.isNull(), _outcome("REVIEW", "Nothing to compare with."))
            .when(when_ >= other_date, ok)
            .otherwise(fail),
        )
        .when(operator == "is_future_or_today", F.when(when_ >= today, ok).otherwise(fail))
        .otherwise(ok)
    )


def eval_text(missing: Column, detected: Column, raw: Column, confidence: Column, error: Column) -> Column:
    operator = F.coalesce("cond.operator", F.lit("contains"))
    phrase = F.lower(F.coalesce("cond.value", "cond.substring", F.lit("")))
    listed = F.transform(
        F.coalesce("cond.values", F.array().cast("array<string>")), lambda v: F.lower(v)
    )
    shown = F.lower(text(raw))
    ok = _outcome("PASS", "Wording is as required.")
    fail = _outcome(_soft_fail(confidence), F.coalesce(error, F.lit("Required wording is missing.")))
    return (
        F.when(~detected, missing)
        .when(operator == "contains", F.when(shown.contains(phrase), ok).otherwise(fail))
        .when(operator == "contains_any", F.when(F.exists(listed, lambda v: shown.contains(v)), ok).otherwise(fail))
        .when(operator == "contains_all", F.when(F.forall(listed, lambda v: shown.contains(v)), ok).otherwise(fail))
        .otherwise(ok)
    )


def eval_price(field: Column, mandatory: Column, detected: Column, entry: Column, effective: Column,
               quality_ok: Column) -> Column:
    confidence = F.coalesce(F.nullif(effective, F.lit(0.0)), F.lit(C.DEFAULT_CONFIDENCE))
    verdict = F.coalesce(entry["verdict"], F.lit(""))
    tax_rule = field.isin("mrp_inclusive_tax", "mrp_label_format")
    tax_seen = F.coalesce(entry["tax_in_block"], F.lit(False)) | has_any(
        F.lower(text(entry["value"])), C.TAX_WORDS
    )
    unclear = (confidence < C.PRICE_MIN_CONFIDENCE) | (verdict == "CANNOT_VERIFY")
    return (
        F.when(
            unclear,
            _outcome("NEEDS_REVIEW", F.when(~quality_ok, "Price: image quality is too low.").otherwise(
                "Price was not read clearly enough.")),
        )
        .when(~detected & mandatory, _outcome("FAIL", "Price was not found on a clear scan."))
        .when(~detected, _outcome("NOT_APPLICABLE", "Optional declaration not detected; check bypassed."))
        .when(verdict == "CONFORMING", _outcome("PASS", "Price and tax clause are both stated."))
        .when(tax_rule & tax_seen, _outcome("PASS", "Tax clause is stated."))
        .when(verdict == "VIOLATION", _outcome("FAIL", "Price lacks the tax clause."))
        .when(tax_rule, _outcome("FAIL", "Tax clause is absent."))
        .otherwise(_outcome("PASS", "Price is stated."))
    )


def rule_facts(rules: DataFrame) -> DataFrame:
    """What the rule alone tells, worked out before rules multiply: the keys of the fields it reads, its kind, whether its field is mandatory."""
    return rules.withColumns({
        "field_key": F.lower(F.trim(text("field_name"))),
        "kind": ap.canonical_type(F.col("rule_type")),
        "mandatory": ap.mandatory_flag(rules),
        "if_key": _if_field(),
        "then_key": F.lower(F.trim(F.coalesce("cond.then_condition.field", "field_name"))),
        "compared_key": F.lower(F.trim(F.coalesce("cond.compare_with", F.lit("manufacturing_date")))),
    })


def evaluate(pairs: DataFrame) -> DataFrame:
    """Verdict for every (package, rule) pair.

    ``pairs``: applicable rules with ``cond``, ``pattern``, ``pattern_ok`` and their ``rule_facts``,
    ``fields``, ``evaluation_date``, ``overall_confidence`` and ``quality_ok``.
    """
    def of_kind(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    prepared = pairs.withColumns(
        {
            "overall": vx.scaled_confidence("overall_confidence"),
            # all that a verdict needs of the package's map, which then stays behind
            "entry": F.try_element_at("fields", F.col("field_key")),
            "if_value": of_kind("CONDITIONAL_RULE", F.try_element_at("fields", F.col("if_key"))["value"]),
            "then_value": of_kind("CONDITIONAL_RULE", F.try_element_at("fields", F.col("then_key"))["value"]),
            "compared_date": of_kind("DATE_CHECK", F.try_element_at("fields", F.col("compared_key"))["date_value"]),
        }
    ).drop("fields")
    raw = F.col("entry.value")
    prepared = prepared.withColumns(
        {
            "detected": raw.isNotNull(),
            "field_confidence": F.coalesce("entry.confidence", F.lit(0.0)),
            "normalized_value": F.col("entry.normalized_value"),
            "date_value": F.col("entry.date_value"),
        }
    )
    name, mandatory, detected = F.col("field_name"), F.col("mandatory"), F.col("detected")
    overall, confidence = F.col("overall"), F.col("field_confidence")
    quality, error, normal = F.col("quality_ok"), F.col("error_message"), F.col("normalized_value")
    effective = F.when(detected, confidence).otherwise(overall)
    missing = adjudicate_missing(name, mandatory, overall, quality)
    missing_clear = adjudicate_missing(name, mandatory, overall, F.lit(True))
    kind = F.col("kind")
    outcome = (
        F.when(F.col("field_key") == "", _outcome("PASS", "General provision."))
        .when(
            F.col("field_key").isin(C.PRICE_RULE_FIELDS),
            eval_price(F.col("field_key"), mandatory, detected, F.col("entry"), effective, quality),
        )
        .when(kind == "MANDATORY_FIELD", eval_mandatory(missing, detected, confidence))
        .when(kind == "VALUE_CHECK", eval_value(missing_clear, detected, raw, normal, confidence, error))
        .when(
            kind == "FORMAT_CHECK",
            eval_format(name, missing_clear, detected, raw, normal, confidence, error),
        )
        .when(
            kind == "RANGE_CHECK",
            eval_range(missing_clear, detected, mandatory, raw, normal, overall, confidence, error),
        )
        .when(
            kind == "DATE_CHECK",
            eval_date(missing_clear, detected, mandatory, raw, F.col("date_value"), overall, confidence, error),
        )
        .when(kind == "TEXT_CHECK", eval_text(missing_clear, detected, raw, confidence, error))
        .when(kind == "CONDITIONAL_RULE", eval_conditional(name, mandatory, overall))
        .otherwise(F.when(~detected, missing).otherwise(_outcome("PASS", "Declared.")))
    )
    general = F.col("field_key") == ""
    observed = (
        F.when(general, "Conforming")
        .when(detected, F.coalesce(normal, raw))
        .when(mandatory, "Cannot Verify / Not Detected")
        .otherwise("Not Detected (Optional - Bypassed)")
    )
    boxed = F.array("entry.x1", "entry.y1", "entry.x2", "entry.y2")
    has_box = F.col("entry.x1").isNotNull() & F.exists(boxed, lambda v: v != 0)
    judged = prepared.withColumn("outcome", outcome)
    return judged.select(
        "inspection_id",
        "rule_id",
        F.when(general, "general_provision").otherwise(name).alias("field_name"),
        F.col("kind").alias("rule_type"),
        "severity",
        (mandatory & ~general).alias("is_mandatory"),
        "outcome.status",
        "outcome.reason",
        F.when(general, 100.0).otherwise(F.round(effective, 2)).alias("confidence"),
        observed.alias("observed"),
        F.when(detected, raw).alias("extracted_value"),
        F.when(detected, normal).alias("normalized_value"),
        ap.expected_text(mandatory, F.col("expected_requirement")).alias("expected_requirement"),
        F.when(detected & has_box, "FOUND").otherwise("NO_RELIABLE_OCR_EVIDENCE_FOUND").alias("evidence_status"),
        F.when(detected & has_box, F.struct("entry.x1", "entry.y1", "entry.x2", "entry.y2")).alias("box"),
        F.col("entry.image_index").alias("image_index"),
        F.lit("2026.1.0").alias("rule_version") if "version" not in pairs.columns else F.col("version").alias("rule_version"),
    )


def screen(
    packages: DataFrame,
    decl: DataFrame,
    rules: DataFrame,
    evaluation_date: date,
    regulation: str | None = None,
) -> DataFrame:
    """Packages and declarations in, one verdict row per applicable rule out."""
    ready = rule_facts(ap.parse_conditions(rules))
    maps = field_maps(normalise_entries(resolve_aliases(decl, wanted_fields(ready))))
    with_fields = packages.join(spread(maps), "inspection_id", "left")
    empty = F.create_map().cast(maps.schema["fields"].dataType)
    with_fields = with_fields.withColumn("fields", F.coalesce("fields", empty))
    return evaluate(ap.applicable_rules(with_fields, ready, evaluation_date, regulation))


# ----------------------------------------------------------------- category


def infer_category(packages: DataFrame, decl: DataFrame) -> DataFrame:
    """The chosen category, else one inferred from what the label declares."""
    chosen = F.trim(F.coalesce("category", F.lit("")))
    given = ~chosen.isin("", "ALL", "Auto-Detect", "None")

    def value_of(name: str) -> Column:
        return F.max(F.when(F.col("field_name") == name, F.nullif("value", F.lit(""))))

    seen = (
        decl.where(F.col("field_name").isin(
            "fssai_license", "ingredients", "allergen_declaration", "product_name", "generic_name"))
        .groupBy("inspection_id")
        .agg(
            value_of("fssai_license").alias("_licence"),
            value_of("ingredients").alias("_ingredients"),
            value_of("allergen_declaration").alias("_allergen"),
            F.coalesce(value_of("product_name"), value_of("generic_name")).alias("_name"),
        )
    )
    name = F.upper(F.coalesce("_name", F.lit("")))
    is_food = F.col("_licence").isNotNull() | (
        F.col("_ingredients").isNotNull() & F.col("_allergen").isNotNull()
    )
    inferred = (
        F.when(is_food | has_any(name, C.FOOD_TERMS), "Food & Beverages")
        .when(has_any(name, C.COSMETIC_TERMS), "Cosmetics")
        .when(has_any(name, C.PHARMA_TERMS), "Pharmaceuticals")
        .otherwise("ALL")
    )
    joined = packages.join(spread(seen), "inspection_id", "left")
    return (
        joined.withColumn("category_inferred", ~given)
        .withColumn("category", F.when(given, chosen).otherwise(inferred))
        .drop("_licence", "_ingredients", "_allergen", "_name")
    )
