"""From verdict rows to one judgement per package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions import values as vx
from panelmark.functions.text import valid_value

REVIEW = ["NEEDS_REVIEW", "REVIEW", "CANNOT_VERIFY"]
UNVERIFIED = ["NEEDS_REVIEW", "NEEDS REVIEW", "CANNOT_VERIFY"]
BYPASSED = ["NOT_APPLICABLE", "BYPASSED", "N/A"]


def screening_summary(checks: DataFrame) -> DataFrame:
    """All counts of a package in one partial/final aggregate.

    ``review`` and ``unverified`` differ on purpose: the status REVIEW counts
    as review, but is not in the unverified list that the percentages use.
    """
    status = F.col("status")
    severity = F.upper(F.coalesce("severity", F.lit("")))
    return checks.groupBy("inspection_id").agg(
        F.count("*").alias("total"),
        F.count_if(status == "PASS").alias("passed"),
        F.count_if(status == "FAIL").alias("failed"),
        F.count_if(status.isin(REVIEW)).alias("review"),
        F.count_if(status.isin(UNVERIFIED)).alias("unverified"),
        F.count_if(status.isin(BYPASSED)).alias("bypassed"),
        F.count_if((status == "FAIL") & (severity == "CRITICAL")).alias("critical"),
        F.count_if((status == "FAIL") & (severity == "HIGH")).alias("high"),
    )


def overall_status() -> Column:
    return (
        F.when(F.col("failed") > 0, "NON-COMPLIANT")
        .when(F.col("review") > 0, "NEEDS REVIEW")
        .otherwise("COMPLIANT")
    )


def compliance_percent() -> Column:
    applicable = F.greatest(F.lit(1), F.col("total") - F.col("bypassed"))
    return F.round(F.col("passed") / applicable * 100.0, 1)


def risk_level() -> Column:
    return (
        F.when((F.col("critical") > 0) | (F.col("failed") >= 3) | (F.col("percent") < 60.0), "HIGH")
        .when((F.col("failed") > 0) | (F.col("unverified") >= 3) | (F.col("percent") < 85.0), "MEDIUM")
        .otherwise("LOW")
    )


def risk_reason() -> Column:
    return (
        F.when(F.col("risk") == "HIGH", F.concat(F.col("failed"), F.lit(" failed, "), F.col("critical"), F.lit(" critical")))
        .when(F.col("risk") == "MEDIUM", F.concat(F.col("failed"), F.lit(" failed, "), F.col("unverified"), F.lit(" unverified")))
        .otherwise(F.concat(F.lit("all "), F.col("passed"), F.lit(" passed")))
    )


def judge(checks: DataFrame) -> DataFrame:
    """Summary plus status, percentage, risk and the legacy verdict."""
    return (
        screening_summary(checks)
        .withColumn("overall_status", overall_status())
        .withColumn("percent", compliance_percent())
        .withColumn("risk", risk_level())
        .withColumn("risk_reason", risk_reason())
        .withColumn(
            "legacy_verdict",
            F.when(F.col("overall_status") == "COMPLIANT", "7A COMPLIANT").otherwise("7B VIOLATION"),
        )
        .withColumn("route_7b_triggered", F.col("overall_status") != "COMPLIANT")
    )


def inspection_confidence(quality: Column, ocr: Column, rate: Column) -> Column:
    mixed = F.round(0.30 * quality + 0.40 * ocr + 0.30 * rate, 1)
    return F.greatest(F.lit(10.0), F.least(F.lit(99.0), mixed))


def field_extraction_rate(decl: DataFrame) -> DataFrame:
    wanted = decl.where(
        F.col("field_name").isin(C.EXTRACTION_RATE_FIELDS) & (F.coalesce("value", F.lit("")) != "")
    )
    return wanted.groupBy("inspection_id").agg(
        (F.count_distinct("field_name") / len(C.EXTRACTION_RATE_FIELDS) * 100.0).alias("rate")
    )


def ocr_confidence_mean(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("inspection_id").agg(
        F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.0)).alias("mean_confidence")
    )


def low_confidence_warning(mean: Column, tokens: Column) -> Column:
    return F.when(mean < 75.0, "Text was not read with high confidence.").when(
        tokens == 0, "No legible text was found."
    )


def multi_image(images: DataFrame) -> DataFrame:
    """Front, back and side pictures of a package as one row."""
    has_code = F.coalesce("barcode", F.lit("")) != ""
    pieces = F.transform(
        F.array_sort(F.collect_list(F.struct("image_index", "raw_text"))), lambda p: p["raw_text"]
    )
    return images.groupBy("inspection_id").agg(
        F.max("quality_score").alias("quality_score"),
        F.max("confidence").alias("confidence"),
        F.min_by("barcode", F.when(has_code, F.col("image_index"))).alias("barcode"),
        F.array_join(pieces, "\n").alias("raw_text"),
        F.round(F.sum("ocr_ms"), 1).alias("ocr_ms"),
        F.count("*").alias("images"),
    )


def timing_breakdown(images: DataFrame) -> DataFrame:
    """Stage times of a package; panel detection is 40 % of extraction time."""
    return images.groupBy("inspection_id").agg(
        F.round(F.sum("pre_ms"), 1).alias("preprocessing_ms"),
        F.round(F.sum("decl_ms") * 0.4, 1).alias("panel_ms"),
        F.round(F.sum("ocr_ms"), 1).alias("ocr_ms"),
        F.round(F.sum("decl_ms"), 1).alias("extraction_ms"),
        F.round(F.sum(F.col("pre_ms") + F.col("ocr_ms") + F.col("decl_ms")), 1).alias("total_ms"),
    )


def batch_summary(packages: DataFrame) -> DataFrame:
    status = F.col("overall_status")
    followed = status == "COMPLIANT"
    against = status.contains("VIOLATION") | (status == "NON-COMPLIANT")
    counts = packages.groupBy("batch_id").agg(
        F.count("*").alias("total"),
        F.count_if(followed).alias("followed"),
        F.count_if(~followed & against).alias("against_rule"),
        F.count_if(~followed & ~against).alias("cannot_verify"),
        F.round(F.sum("seconds"), 2).alias("total_seconds"),
    )
    return counts.withColumn(
        "rate", F.round(F.col("followed") / F.greatest("total", F.lit(1)) * 100.0, 1)
    ).withColumn("mean_seconds", F.round(F.col("total_seconds") / F.greatest("total", F.lit(1)), 2))


def unit_sale_price(decl: DataFrame) -> DataFrame:
    """Declared price over declared quantity; the smaller confidence holds."""
    def pick(name: str, column: str) -> Column:
        return F.max(F.when(F.col("field_name") == name, F.col(column)))

    wide = decl.where(F.col("field_name").isin("mrp", "net_quantity") & valid_value("value")).groupBy(
        "inspection_id"
    ).agg(
        pick("mrp", "value").alias("price_text"),
        pick("mrp", "confidence").alias("_pc"),
        pick("net_quantity", "value").alias("quantity_text"),
        pick("net_quantity", "confidence").alias("_qc"),
    )
    price = vx.number(vx.found(F.col("price_text"), r"([0-9]+(?:\.[0-9]+)?)"))
    amount = vx.number(vx.found(F.col("quantity_text"), r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)"))
    unit = vx.found(F.col("quantity_text"), r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)", 2)
    default = F.lit(C.DEFAULT_CONFIDENCE)
    return wide.select(
        "inspection_id",
        F.round(F.try_divide(price, F.when(amount > 0, amount)), 2).alias("unit_price"),
        F.coalesce(unit, F.lit("g")).alias("unit"),
        F.least(
            F.coalesce(F.nullif("_pc", F.lit(0.0)), default),
            F.coalesce(F.nullif("_qc", F.lit(0.0)), default),
        ).alias("confidence"),
    ).where("unit_price IS NOT NULL AND unit_price > 0")


def review_triggers() -> Column:
    """Reasons for a human look, as an array."""
    return F.array_compact(
        F.array(
            F.when(F.col("ocr_confidence") < 75.0, "reading confidence is low"),
            F.when(F.col("panel_status").isin("REVIEW_REQUIRED", "CANNOT_VERIFY"), "panel is uncertain"),
            F.when(F.col("quality_score") < 70, "image quality is low"),
            F.when(F.col("unverified") >= 2, F.concat(F.col("unverified"), F.lit(" declarations unverified"))),
            F.when(F.col("panel_shape") == "unknown", "geometry is uncertain"),
        )
    )


def report_decision(checks: DataFrame) -> DataFrame:
    from panelmark.operators.ledger import with_check_tab

    tabbed = with_check_tab(checks)
    severity = F.upper(F.coalesce("severity", F.lit("")))
    counts = tabbed.groupBy("inspection_id").agg(
        F.count_if(F.col("tab") == "fail").alias("fails"),
        F.count_if(F.col("tab") == "pass").alias("passes"),
        F.count_if(F.col("tab") == "review").alias("reviews"),
        F.count_if((F.col("tab") == "fail") & (severity == "CRITICAL")).alias("criticals"),
    )
    decision = (
        F.when((F.col("criticals") > 0) | (F.col("fails") >= 3), "NON-COMPLIANT")
        .when(F.col("fails") > 0, "PARTIALLY COMPLIANT")
        .when(F.col("reviews") > 0, "PARTIALLY COMPLIANT")
        .otherwise("COMPLIANT")
    )
    return counts.withColumn("decision", decision)


def adjudication_branch(insp: DataFrame, checks: DataFrame) -> DataFrame:
    """PASS, FAIL or REVIEW from the status text and the check counts."""
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    bad = status.rlike("FAIL|VIOLATION|NON-COMPLIANT|NON_COMPLIANT|7B")
    open_ = ~bad & status.rlike("REVIEW|PARTIAL|CANNOT_VERIFY|PENDING")
    counts = checks.groupBy("inspection_id").agg(
        F.count_if(bad).alias("_bad"), F.count_if(open_).alias("_open")
    )
    joined = insp.join(counts, "inspection_id", "left").fillna(0, ["_bad", "_open"])
    overall = F.upper(F.trim(F.coalesce("overall_status", F.lit(""))))
    is_fail = overall.rlike("FAIL|7B|VIOLATION|NON-COMPLIANT|NON_COMPLIANT")
    is_review = overall.rlike("REVIEW|PARTIAL|CANNOT_VERIFY|PENDING")
    is_pass = overall.rlike("PASS|7A|COMPLIANT|FOLLOWED")
    clear = is_pass & (F.col("_bad") == 0) & ~is_fail & (~is_review | (F.col("_open") == 0))
    branch = F.when(clear, "PASS").when(is_fail | (F.col("_bad") > 0), "FAIL").otherwise("REVIEW")
    return joined.select("inspection_id", branch.alias("branch"))


def extraction_quality(decl: DataFrame) -> DataFrame:
    """Recall over all (package, expected field) pairs; no false positives by design."""
    expected = len(C.EXPECTED_FIELDS)
    found = (
        decl.where(F.col("field_name").isin(C.EXPECTED_FIELDS))
        .groupBy("inspection_id")
        .agg(F.count_distinct(F.when(F.coalesce("value", F.lit("")) != "", F.col("field_name"))).alias("n"))
    )
    sums = found.agg(
        F.sum("n").cast("long").alias("true_positives"),
        (F.count("*") * expected - F.sum("n")).cast("long").alias("false_negatives"),
    )
    tp, fn = F.col("true_positives"), F.col("false_negatives")
    precision = tp / F.greatest(tp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    return sums.select(
        "true_positives",
        "false_negatives",
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-6)), 4).alias("f1"),
    )


def character_error_rate(pairs: DataFrame) -> DataFrame:
    """Mean edit distance over reference length per variant, blanks removed."""
    reference = F.upper(F.regexp_replace(F.coalesce("reference", F.lit("")), r"\s+", ""))
    read = F.upper(F.regexp_replace(F.coalesce("hypothesis", F.lit("")), r"\s+", ""))
    rate = F.when(
        F.length(reference) == 0, F.when(F.length(read) == 0, 0.0).otherwise(1.0)
    ).otherwise(F.levenshtein(reference, read) / F.length(reference))
    return pairs.groupBy("variant").agg(F.round(F.avg(rate), 6).alias("cer"), F.count("*").alias("n"))
