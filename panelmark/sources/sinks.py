"""Sinks: sessions, ledger rows, audit events, exports, archives, schema changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.operators import ledger, rollup
from panelmark.operators.measures import tolerance
from panelmark.operators.tokens import joined_text
from panelmark.session import spread

BOX = ["x1", "y1", "x2", "y2"]


def session_rows(sessions: DataFrame, decl: DataFrame) -> DataFrame:
    """Every session with all fixed keys; missing ones get defaults."""
    keys = F.explode(F.array(*[F.lit(k) for k in C.SESSION_FIELDS]))
    wanted = sessions.select("inspection_id", keys.alias("field_name"))
    found = decl.where(F.col("field_name").isin(C.SESSION_FIELDS)).select(
        "inspection_id", "field_name", "value", F.col("confidence").alias("_c"),
        F.when(F.col("x1").isNotNull(), F.array(*BOX)).alias("_b"))
    joined = wanted.join(spread(found), ["inspection_id", "field_name"], "left")
    return joined.select(
        "inspection_id", "field_name", "value", F.coalesce("_c", F.lit(0.0)).alias("confidence"),
        F.coalesce("_b", F.array(*[F.lit(0.0)] * 4)).alias("bbox"),
        F.when(F.coalesce("value", F.lit("")) != "", "detected").otherwise("not_detected").alias("status"),
    )


def session_documents(sessions: DataFrame, decl: DataFrame) -> DataFrame:
    """One row per session with its declarations as JSON (eighteen keys each)."""
    rows = session_rows(sessions, decl)
    entry = F.struct("field_name", F.struct("value", "confidence", "bbox", "status").alias("d"))
    return rows.groupBy("inspection_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("normalized_declarations_json"))


def ledger_rows(packages: DataFrame, checks: DataFrame, decl: DataFrame) -> DataFrame:
    """One ledger row per package with verdict and JSON columns.

    The JSON columns hold a package's checks and fields, both bounded by the
    rule catalogue and the field list.
    """
    check = F.struct("rule_id", "field_name", "status", "severity", "observed")
    nested = checks.groupBy("inspection_id").agg(
        F.to_json(F.array_sort(F.collect_list(check))).alias("checks_json"),
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("status") == "FAIL", check)))).alias("violations_json"),
    )
    fields = decl.groupBy("inspection_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "value"))))).alias("technical_matrix_json"))
    verdicts = rollup.judge(checks).select("inspection_id", "legacy_verdict", "route_7b_triggered")
    return (
        packages.join(spread(verdicts), "inspection_id", "left").join(spread(nested), "inspection_id", "left").join(spread(fields), "inspection_id", "left")
        .withColumn("overall_status", F.coalesce("legacy_verdict", F.lit("7B VIOLATION"))).drop("legacy_verdict")
        .withColumn("route_7b_triggered", F.coalesce("route_7b_triggered", F.lit(True)))
    )


PROFILE_FIELDS = ["manufacturer", "fssai_license", "net_quantity", "consumer_care"]


def ledger_evidence(packages: DataFrame, decl: DataFrame, tokens: DataFrame) -> DataFrame:
    """Ledger rows with their evidence: profile, care, tolerance as shown, text, boxes and the quality flag.

    ``packages`` has inspection_id, product_name, category and quality_score;
    ``decl`` has numeric_value and unit beside value and confidence. Of several
    declarations of a field the surest counts. Text and boxes hold the whole
    page, put together in two levels; a package without lines has an empty text
    and an empty list.
    """
    entry = F.struct("value", "confidence", "numeric_value", "unit")
    surest = F.struct(-F.coalesce("confidence", F.lit(0.0)), "value")
    said = decl.where(F.col("field_name").isin(PROFILE_FIELDS)).groupBy("inspection_id").agg(
        *[F.min_by(entry, F.when(F.col("field_name") == f, surest)).alias(f"_{f}") for f in PROFILE_FIELDS])
    lines = joined_text(tokens, "inspection_id", "line_no", "text", "_text")
    box = F.to_json(F.struct("line_no", "text", "confidence", F.array(*BOX).alias("bbox")), {"ignoreNullFields": "false"})
    # JSON holds no raw line break, so the breaks between the entries are the only ones
    boxes = joined_text(tokens.withColumn("_box", box), "inspection_id", "line_no", "_box", "_boxes")
    joined = packages.join(spread(said), "inspection_id", "left").join(spread(lines), "inspection_id", "left").join(spread(boxes), "inspection_id", "left")

    def value(field: str) -> Column:
        return F.nullif(F.col(f"_{field}.value"), F.lit(""))

    sized = tolerance(joined.withColumns({
        "quantity": F.col("_net_quantity.numeric_value"), "unit": F.nullif(F.col("_net_quantity.unit"), F.lit("")),
        "base_quantity": F.lit(None).cast("double")}))
    missing, unnamed = F.lit("Not Detected"), F.coalesce(F.col("product_name"), F.lit("")).contains("Packaged Commodity")
    profile = F.struct(
        F.coalesce(value("manufacturer"), F.when(unnamed, missing).otherwise(F.col("product_name"))).alias("company_name"),
        F.when(unnamed, "Unidentified Product Label").otherwise(F.col("product_name")).alias("product_name"),
        "category", F.coalesce(value("fssai_license"), missing).alias("fssai_license"),
    )
    shown = F.struct(
        F.coalesce(value("net_quantity"), missing).alias("declared_quantity"),
        F.when(value("net_quantity").isNull(), "N/A").otherwise(F.col("shown")).alias("mpe_display"),
    )
    return sized.select(
        *packages.columns,
        F.col("quality_score").alias("image_blur_variance"),
        F.coalesce(F.col("quality_score") >= 70.0, F.lit(False)).alias("image_quality_passed"),
        F.coalesce("_text", F.lit("")).alias("ocr_raw_text_immutable"),
        F.concat(F.lit("["), F.coalesce(F.replace("_boxes", F.lit("\n"), F.lit(",")), F.lit("")), F.lit("]")).alias("bounding_boxes_json_immutable"),
        F.to_json(profile).alias("company_profile_json"), F.to_json(shown).alias("quantity_mpe_json"),
        F.coalesce(F.to_json("_consumer_care"), F.lit("{}")).alias("customer_care_json"),
    )


def audit_rows(changes: DataFrame, user: Column, action: Column, resource: Column, details: Column, now: datetime) -> DataFrame:
    return changes.select(
        user.alias("user_id"), action.alias("action"), resource.alias("resource_id"), details.alias("details"),
        F.lit(now).cast("timestamp_ntz").alias("timestamp"),
    )


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Appends parquet files; ``by`` names the partition columns."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(insp: DataFrame, path: str, scope: str = "all") -> None:
    """The export as quoted CSV parts with a header each."""
    ledger.export_rows(insp, scope).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def archive_rows(insp: DataFrame, tokens: DataFrame, decl: DataFrame, now: datetime) -> DataFrame:
    """A ledger row with its children as one payload, plus look-up columns."""
    reads = tokens.groupBy("inspection_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text", "confidence"))).alias("tokens"))
    fields = decl.groupBy("inspection_id").agg(
        F.array_sort(F.collect_list(F.struct("field_name", "value", "confidence"))).alias("declarations"))
    joined = insp.join(spread(reads), "inspection_id", "left").join(spread(fields), "inspection_id", "left")
    return joined.select(
        F.col("inspection_id").alias("original_inspection_id"), F.lit(now).cast("timestamp_ntz").alias("archived_at"),
        F.to_json(F.struct(*[F.col(c) for c in joined.columns])).alias("payload_json"),
        *[c for c in ("inspector_id", "overall_status", "officer_decision") if c in insp.columns],
    )


def evolve(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds each missing column with its type and default; the rest stays."""
    missing = {n: F.lit(d).cast(t) for n, (t, d) in wanted.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df
