"""Geometry, quantity and quality measures, and the explained report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions import values as vx
from panelmark.functions.text import has_any, lookup, suspicious_text, text
from panelmark.operators import tokens as tk
from panelmark.session import cut, spread


def _bracket(value: Column, brackets: list[tuple], column: int) -> Column:
    """Value of the bracket ``low < value <= high`` as one expression."""
    result = None
    for row in brackets:
        high = row[1]
        if high is None:
            return result.otherwise(row[column]) if result is not None else F.lit(row[column])
        condition = value <= high
        result = F.when(condition, row[column]) if result is None else result.when(condition, row[column])
    return result


def bracket_lookup(df: DataFrame, value: str, brackets: list[tuple], names: list[str]) -> DataFrame:
    """Constant brackets become a CASE: no range join at all."""
    known = F.col(value).isNotNull()
    return df.withColumns(
        {n: F.when(known, _bracket(F.col(value), brackets, 2 + i)) for i, n in enumerate(names)}
    )


def panel_area(shape: Column, height: Column, width: Column) -> Column:
    round_ = F.lower(F.coalesce(shape, F.lit("rectangular"))) == "cylindrical"
    return F.when(round_, F.round(0.40 * height * (F.pi() * width), 2)).otherwise(F.round(height * width, 2))


def letter_height(df: DataFrame) -> DataFrame:
    """Required letter height by panel area and print, and the verdict."""
    known = F.coalesce(F.col("area") > 0, F.lit(False))
    raised = F.lower(F.coalesce("printing", F.lit("normal"))).isin(C.RAISED_PRINTS)
    required = F.when(raised, _bracket(F.col("area"), C.LETTER_HEIGHTS, 3)).otherwise(
        _bracket(F.col("area"), C.LETTER_HEIGHTS, 2)
    )
    usable = known & F.coalesce("scale_ok", F.lit(True)) & F.col("height").isNotNull()
    return (
        df.withColumn("required", F.when(known, required))
        .withColumn("difference", F.when(usable, F.round(F.col("height") - F.col("required"), 2)))
        .withColumn(
            "result",
            F.when(~usable | (F.coalesce("confidence", F.lit(90.0)) < 85.0), "NEEDS_OFFICER_VERIFICATION")
            .when(F.col("difference") >= 0, "COMPLIANT")
            .otherwise("POTENTIAL_VIOLATION"),
        )
    )


def standard_size(df: DataFrame) -> DataFrame:
    large = F.lower(F.coalesce("unit", F.lit("g"))).isin("kg", "l")
    base = F.when(large, F.col("quantity") * 1000.0).otherwise(F.col("quantity"))
    return df.withColumn("in_base", base).withColumn("is_standard", F.col("in_base").isin(C.STANDARD_SIZES))


def tolerance(df: DataFrame) -> DataFrame:
    """Permissible error: the schedule in g or ml, and the display variant."""
    unit = F.lower(F.coalesce("unit", F.lit("g")))
    value = _bracket(F.col("quantity"), C.DISPLAY_TOLERANCES, 2)
    fixed = _bracket(F.col("quantity"), C.DISPLAY_TOLERANCES, 3) == "fixed"
    small = F.when(fixed, F.concat(value.cast("string"), F.lit(" "), unit)).otherwise(F.concat(value.cast("string"), F.lit("%")))
    large = F.when(F.col("quantity") <= 1.0, F.concat(F.lit("15.0 "), F.when(unit == "kg", "g").otherwise("ml"))).otherwise("1.5%")
    shown = F.when(F.col("quantity").isNull(), "1.5%").when(unit.isin("g", "ml"), small).when(unit.isin("kg", "l"), large).otherwise("1.5%")
    return df.withColumns(
        {
            "error": _bracket(F.col("base_quantity"), C.TOLERANCES, 2),
            "kind": _bracket(F.col("base_quantity"), C.TOLERANCES, 3),
            "shown": shown,
        }
    )


def panel_shape(df: DataFrame) -> DataFrame:
    """Shape, confidence band, area and minimum height from panel features."""
    score = (
        F.lit(70.0)
        + F.when(F.col("corners") == 4, 20.0).otherwise(0.0)
        + F.when(F.col("solidity").between(0.75, 1.0), 10.0).otherwise(0.0)
        - F.when(F.abs("skew") > 25.0, 15.0).otherwise(0.0)
    )
    confidence = F.when(F.col("has_contour"), F.greatest(F.lit(10.0), F.least(F.lit(99.0), score))).otherwise(45.0)
    df = df.withColumn("confidence", confidence)
    ratio = F.col("width_px") / F.greatest("height_px", F.lit(1.0))
    df = df.withColumn(
        "band",
        F.when(F.col("confidence") >= 80, "ACCEPTED").when(F.col("confidence") >= 50, "REVIEW_REQUIRED").otherwise("CANNOT_VERIFY"),
    ).withColumn(
        "shape",
        F.when(F.col("confidence") < 50, "unknown")
        .when((ratio < 0.65) | (ratio > 1.8), "cylindrical")
        .when(F.col("solidity") < 0.85, "flexible_pouch")
        .otherwise("rectangular"),
    )
    wide, tall = F.greatest(F.lit(2.0), F.col("width_px") / 30), F.greatest(F.lit(2.0), F.col("height_px") / 30)
    area = (
        F.when(F.col("shape") == "rectangular", F.round(wide * tall, 1))
        .when(F.col("shape") == "cylindrical", F.round(0.40 * tall * (wide * 3.14159), 1))
        .otherwise(F.round(0.40 * wide * tall, 1))
    )
    return bracket_lookup(df.withColumn("area", area), "area", C.PANEL_MIN_HEIGHTS, ["min_height"])


def physical_height(df: DataFrame) -> DataFrame:
    """Pixel height in millimetres: by the panel's size, else by a usual scale."""
    readable = F.coalesce(F.col("height_px") > 0, F.lit(False))
    scaled = F.coalesce((F.col("panel_cm") > 0) & (F.col("image_px") > 0), F.lit(False))
    exact = F.round(F.col("height_px") * (F.col("panel_cm") * 10.0 / F.col("image_px")), 2)
    return df.withColumn(
        "mm", F.when(readable, F.when(scaled, exact).otherwise(F.round(F.col("height_px") / 3.0, 1)))
    ).withColumn("calibrated", readable & scaled)


def image_quality(df: DataFrame) -> DataFrame:
    blur = F.when(F.col("blur") < 80, 35).when(F.col("blur") < 150, 15).otherwise(0)
    contrast = F.when(F.col("contrast") < 35, 25).when(F.col("contrast") < 50, 10).otherwise(0)
    light = F.col("brightness")
    bright = F.when((light < 50) | (light > 220), 25).when((light < 70) | (light > 200), 10).otherwise(0)
    score = F.greatest(F.lit(10), F.least(F.lit(100), 100 - blur - contrast - bright))
    return df.withColumn("score", score).withColumn("passed", (F.col("score") >= 60) & (F.col("blur") >= 80))


# --------------------------------------------------------------- explained rows


def explain_checks(checks: DataFrame, decl: DataFrame, aliases: DataFrame, fallbacks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Checks as the report shows them: clean status, value, reason and box."""
    entries = decl.where(text("value") != "").select(
        "inspection_id", F.col("field_name").alias("_field"), F.col("value").alias("_value"),
        F.when(F.col("x1").isNotNull(), F.struct("x1", "y1", "x2", "y2")).alias("_box"), F.col("image_index").alias("_image"),
    )
    direct = entries.select("inspection_id", F.col("_field").alias("_key"), F.lit(0).alias("_rank"), F.struct("_value", "_box", "_image").alias("_e"))
    by_alias = entries.join(aliases, F.col("_field") == F.col("candidate")).select(
        "inspection_id", F.col("field").alias("_key"), F.lit(1).alias("_rank"), F.struct("_value", "_box", "_image").alias("_e"))
    best = direct.unionByName(by_alias).groupBy("inspection_id", "_key").agg(
        F.min_by("_e", F.struct("_rank", "_e._value")).alias("_e"))
    joined = checks.withColumn("_key", F.lower("field_name")).join(spread(best), ["inspection_id", "_key"], "left")
    status = (
        F.when(F.col("status").isin("NOT_APPLICABLE", "BYPASSED", "N/A"), "NOT_APPLICABLE")
        .when(F.col("status").isin("PASS", "FAIL"), F.col("status"))
        .otherwise("CANNOT_VERIFY")
    )
    shown = F.coalesce(F.nullif("extracted_value", F.lit("")), F.nullif("observed", F.lit("")), "_e._value")
    rows = joined.select(
        "inspection_id", "rule_id", "field_name", status.alias("status"), shown.alias("observed"), "expected_requirement",
        "reason", "severity", F.coalesce("_e._box", "box").alias("box"), F.coalesce("_e._image", F.lit(0)).alias("image_index"),
    )
    # read three times: to find large packages, their open checks, and for the result
    boxed = cut(tk.box_fallback(rows, decl, fallbacks))
    open_ = boxed.where("box IS NULL AND observed NOT LIKE '%Cannot Verify%' AND observed NOT LIKE '%Not Detected%'")
    read = tk.evidence_fallback(open_.select("inspection_id", "rule_id", "observed"), tokens)
    read = read.select("inspection_id", "rule_id", F.col("box").alias("_read"))
    return boxed.join(spread(read), ["inspection_id", "rule_id"], "left").withColumn("box", F.coalesce("box", "_read")).select(
        "inspection_id", "rule_id", "field_name", "status", "observed", "expected_requirement", "reason", "severity",
        "box.x1", "box.y1", "box.x2", "box.y2", "image_index", "from_fallback")


# ------------------------------------------------------------ five-section check


def unrelated_label(tokens: DataFrame, is_name: Column, is_price: Column, is_quantity: Column) -> DataFrame:
    """Labels without any anchor, from per-line flags (no text is put together)."""
    upper = F.upper(text("text"))

    def any_line(condition: Column) -> Column:
        return F.coalesce(F.max(condition), F.lit(False))

    flags = tokens.groupBy("inspection_id").agg(
        any_line(has_any(upper, ["REGRET THE INCONVENIENCE", "PAGE COULD NOT BE FOUND"])).alias("_error_page"),
        any_line(is_name).alias("_name"), any_line(is_price).alias("_price"), any_line(is_quantity).alias("_quantity"),
        any_line(F.trim("text") != "").alias("_text"), any_line(has_any(upper, ["MRP", "QTY"])).alias("_anchor"),
    )
    bare = ~F.col("_name") & ~F.col("_price") & ~F.col("_quantity") & F.col("_text") & ~F.col("_anchor")
    return flags.select("inspection_id", (F.col("_error_page") | bare).alias("unrelated"))


SECTION_TAGS = {1: "generic name", 2: "net qty", 3: "mrp", 4: "mfg date", 8: "consumer care", 10: "manufacturer address"}


def tagged_boxes(tokens: DataFrame) -> DataFrame:
    """Label lines with the section tag a detector would give them."""
    tag = lookup({str(k): v for k, v in SECTION_TAGS.items()}, F.col("line_no").cast("string"), F.lit("other"))
    return tokens.withColumn("tag", tag)


# Tax wordings the price section accepts
_TAX_ON_PRICE = ["INCLUSIVE OF ALL TAXES", "INCL. OF ALL TAXES", "INCL OF TAXES", "INCL. OF TAXS", "LNCL.OF TAXS", "TAXES", "TAX",
                 "INCLUSIE", "TAES"]
_TAX_ON_LABEL = ["INCLUSIVE OF ALL TAXES", "INCL. OF ALL TAXES", "INCL OF TAXES", "INCL. OF TAXS", "LNCL.OF TAXS",
                 "INCLUSIVE OF ALL TAXES,", "INCLUSIE OF ALL TAES", "INCLUSIE", "TAES"]


def five_sections(boxes: DataFrame) -> DataFrame:
    """The older seven-check evaluation on tagged boxes, one row per package.

    The tag decides the section in a fixed order of tests; the last box of a
    section counts, as a later reading replaces an earlier one.
    """
    tag = F.lower(text("tag"))
    section = (
        F.when(tag.rlike("generic|product name"), "name")
        .when(tag.rlike("mrp|price"), "price")
        .when(tag.rlike("net qty|quantity"), "quantity")
        .when(tag.rlike("mfg|manufacture|date"), "date")
        .when(tag.rlike("manufacturer|address|mfg address"), "maker")
        .when(tag.rlike("consumer care|helpline|consumer complaint"), "care")
        .when(tag.rlike("numeral height|font"), "height")
    )
    lead = (
        r"^(?:Product Generic Name: |Declared Net Quantity: |Net Qty: |Month/Year of Mfg: |Month/Year of Manufacture: |"
        r"Manufacturer Name & Address: |Consumer Care Contact: )"
    )
    lines = boxes.withColumns({"_s": section, "_t": F.trim(F.regexp_replace(text("text"), lead, "")), "_up": F.upper(text("text"))})

    def last(name: str, column: str = "_t") -> Column:
        return F.max_by(column, F.when(F.col("_s") == name, F.col("line_no")))

    wide = lines.groupBy("inspection_id").agg(
        *[F.nullif(last(n), F.lit("")).alias(n) for n in ("name", "price", "quantity", "date", "maker", "care", "height")],
        last("price", "confidence").alias("price_confidence"),
        F.max(has_any(F.col("_up"), _TAX_ON_LABEL)).alias("label_tax"),
        F.min_by(suspicious_text("text"), F.when(suspicious_text("text").isNotNull(), F.col("line_no"))).alias("suspicion"),
    )
    taxed = has_any(F.upper(text("price")), _TAX_ON_PRICE) | F.coalesce("label_tax", F.lit(False))
    amount = r"([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)"
    unit = F.lower(vx.found(text("quantity"), amount, 2))
    height = vx.number(vx.found(F.lower(text("height")), r"([0-9]+(?:\.[0-9]+)?)\s*mm"))
    reached = text("care").contains("@") & (text("care").contains("1800") | text("care").rlike("[0-9]{8,11}"))

    def present(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), "PASS").otherwise("REVIEW")

    judged = wide.withColumns(
        {
            "name_result": present("name"),
            "price_result": F.when(F.col("price").isNull() | (F.coalesce("price_confidence", F.lit(95.0)) < 60.0), "REVIEW")
            .when(taxed, "PASS").otherwise("FAIL"),
            "quantity_result": F.when(F.col("quantity").isNull(), "REVIEW")
            .when(unit.isin("g", "kg", "ml", "l", "count"), "PASS").otherwise("FAIL"),
            "maker_result": present("maker"),
            "date_result": present("date"),
            "care_result": F.when(F.col("care").isNull(), "REVIEW").when(reached, "PASS").otherwise("FAIL"),
            "height_result": F.when(height.isNull() | (height == 0), "REVIEW").when(height >= 2.5, "PASS").otherwise("FAIL"),
            "is_suspicious": F.col("suspicion").isNotNull(),
        }
    )
    results = ["name_result", "price_result", "quantity_result", "maker_result", "date_result", "care_result", "height_result"]
    violations = F.array_compact(
        F.array(
            F.when(F.col("price_result") == "FAIL", "RULE_6_1_E"),
            F.when((F.col("quantity_result") == "FAIL") & unit.isNotNull(), "RULE_6_1_C"),
            F.when(F.col("care_result") == "FAIL", "RULE_6_2"),
            F.when(F.col("height_result") == "FAIL", "RULE_7"),
            F.when(F.col("is_suspicious"), "FRAUD_ANOMALY_01"),
        )
    )
    judged = judged.withColumn("violations", F.array_join(violations, ","))
    reviewed = F.exists(F.array(*results), lambda r: r == "REVIEW")
    routed = (F.col("violations") != "") | reviewed | F.col("is_suspicious")
    return judged.select(
        "inspection_id", *results, "is_suspicious", "violations", routed.alias("route_7b_triggered"),
        F.when(routed, "7B: VIOLATION / MANUAL REVIEW").otherwise("7A: COMPLIANT").alias("overall_status"),
    )
