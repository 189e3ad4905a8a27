"""Structured Streaming jobs. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.operators import changes, slices
from panelmark.plans import screening
from panelmark.session import cut


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def screen_batches(arriving: DataFrame, packages_of, decl_of, rules: DataFrame, evaluation_date: date, path: str):
    """Screens each micro-batch with the batch plan and appends the verdicts.

    ``packages_of`` and ``decl_of`` map a batch to its packages and their
    declarations, so a batch costs what it brings. The batch number
    is part of the path, so a retried batch replaces its own output.
    """

    def step(batch: DataFrame, number: int) -> None:
        # wide projections outgrow what the JIT compiles as one method; this session is the stream's own copy
        batch.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        checks = screening.screen(packages_of(batch), decl_of(batch), rules, evaluation_date)
        checks.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(step)


def new_inspections(insp: DataFrame) -> DataFrame:
    """Feed of new ledger rows."""
    return insp.select(
        F.lit("NEW_INSPECTION").alias("event"), "inspection_id", "product_name", "category", "location", "inspector_name",
        "overall_status", "route_7b_triggered", "officer_decision", "created_at")


def override_feed(amend: DataFrame) -> DataFrame:
    """Feed of overrides with their notice."""
    return changes.override_notice(amend.where(F.col("previous_verdict").isNotNull())).select(
        F.lit("INSPECTION_OVERRIDDEN").alias("event"), "inspection_id", "previous_verdict", "new_verdict", "severity", "message",
        "amended_at")


def dedup_scans(scans: DataFrame) -> DataFrame:
    """Lets each scan id through once, however late a repeat comes.

    The ids seen are the keys of a state store without a watermark, dealt by
    hash, so a batch costs what it brings, not what was stored before. Repeats
    within an Arrow batch go before the shuffle, as one id may fill a batch.
    """

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop_duplicates("scan_id")

    return scans.mapInPandas(thin, scans.schema).dropDuplicates(["scan_id"])


def kpi_stream(insp: DataFrame, span: str = "1 day") -> DataFrame:
    """Ledger counts per window and category, kept current (update mode).

    No watermark: a row of any age counts. The state is one row per window and
    category, as the ledger itself has.
    """
    status = F.col("overall_status")
    return (
        insp.groupBy(F.window("created_at", span), "category")
        .agg(
            F.count("*").alias("total"),
            F.count_if(status.like("%7A%")).alias("compliant"),
            F.count_if(status.like("%7B%")).alias("violations"),
            F.count_if(status == "PENDING").alias("pending"),
        )
        .select(F.col("window.start").alias("window_start"), "category", "total", "compliant", "violations", "pending")
    )


def audit_stream(audit: DataFrame, span: str = "1 day") -> DataFrame:
    """Running counts of audit actions per window (update mode, rows of any age count)."""
    return (
        audit.groupBy(F.window("event_time", span), "action")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "action", "n")
    )


_RUN = "user_id string, metric double, streak long"
_FRAME_ORDER = ["_turn", "event_time", "event_id"]


def frame_streaks(frames: DataFrame, known: DataFrame | None) -> DataFrame:
    """``frames`` with ``streak``, the number of steady frames of the device that end here.

    ``known`` (user_id, metric, streak) is how each device stood before. It
    goes in front of the device's frames as one row that weighs its streak.
    Frames are sorted by (device, time) in slices and only sums are carried
    over their borders, so one device may fill a batch.
    """
    columns = ["user_id", "event_id", "event_time", "metric"]
    rows = frames.select(*columns, F.lit(1).alias("_turn"), F.lit(1).cast("long").alias("_weight"), F.lit(None).cast("boolean").alias("_stood"))
    if known is not None:
        met = known.join(frames.select("user_id").distinct(), "user_id", "left_semi")
        rows = rows.unionByName(met.select(
            "user_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp").alias("event_time"), "metric",
            F.lit(0).alias("_turn"), F.col("streak").alias("_weight"), (F.col("streak") > 0).alias("_stood")))
    order = [F.col(c) for c in _FRAME_ORDER]
    after = slices.previous_value(rows, ["user_id"], order, {"metric": "_before"})
    motion = F.abs(F.col("metric") - F.coalesce("_before", "metric"))
    still = (F.col("metric") >= C.MIN_SHARPNESS) & (motion < C.MAX_MOTION)
    judged = after.withColumn("_steady", F.coalesce("_stood", still, F.lit(False)))
    counted = slices.running_sum(judged, ["user_id"], order, "_weight", "_so_far")
    broken = counted.withColumn("_broken", F.when(~F.col("_steady"), F.col("_so_far")))
    last = slices.running_max_before(broken, ["user_id"], order, "_broken", "_last_broken")
    streak = F.when(F.col("_steady"), F.col("_so_far") - F.coalesce("_last_broken", F.lit(0))).otherwise(F.lit(0))
    return last.withColumn("streak", streak.cast("long")).select(*columns, "_turn", "streak")


def stable_frames_stream(frames: DataFrame, path: str):
    """Captures per device: frames that are at least the second steady one in a row.

    Captures go to ``path``/out by batch, so a retry replaces its own. How each
    device stands (two numbers) goes to one of two folders in turn: a batch
    reads what the one before it left, and a retry finds that unchanged.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(_RUN).parquet(f"{path}/devices-{(number - 1) % 2}") if number > 0 else None
        done = cut(frame_streaks(batch, known))
        captures = done.where("_turn = 1 AND streak >= 2").select("user_id", "event_id", "streak")
        captures.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        last = F.max_by(F.struct("metric", "streak"), F.struct(*_FRAME_ORDER))
        stands = done.groupBy("user_id").agg(last.alias("_l")).select("user_id", "_l.*")
        if known is not None:
            stands = stands.unionByName(known.join(stands.select("user_id"), "user_id", "left_anti"))
        stands.write.mode("overwrite").parquet(f"{path}/devices-{number % 2}")

    return frames.writeStream.foreachBatch(step)
