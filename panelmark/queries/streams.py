"""Streaming queries: each drains the table as a stream and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark import fixtures as fx
from panelmark.plans import catalog
from panelmark.queries.history import _scratch
from panelmark.queries.registry import query
from panelmark.queries.rules import TODAY, declarations_of, packages_of
from panelmark.sources.readers import is_folder
from panelmark.streaming import jobs


def _stream(spark, sf: str, table: str) -> DataFrame:
    """The table as a file stream, be it one file or a folder of them."""
    reader = spark.readStream.schema(fx.table(spark, sf, table).schema)
    path = f"{sf}/{table}.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of its input; batches land in their own folder.

    Writing by batch number makes a retry replace its own output, and lets an
    update-mode result be reduced to the last value per key afterwards.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    running = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    running.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def _last(updates: DataFrame, keys: list[str]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in updates.columns if c != "batch"])
    return updates.groupBy(*keys).agg(F.max_by(row, "batch").alias("_row")).select("_row.*")


def _audit(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "cast(ts AS timestamp) AS event_time", "concat('USR-', cast(user_id AS string)) AS user_id",
        "CASE event_type WHEN 'signup' THEN 'CREATE_USER' WHEN 'purchase' THEN 'OFFICER_SIGN_OFF'"
        " WHEN 'view' THEN 'INSPECTION_SCAN_PROCESSED' WHEN 'click' THEN 'WORK_ASSIGNED' ELSE 'ADJUDICATION_OVERRIDE' END AS action",
        "value AS metric")


@query("stream_audit", """
SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d') AS day, action, count(*) AS n FROM fx_audit GROUP BY 1, 2
""")
def _stream_audit(spark, sf):
    counts = jobs.audit_stream(_audit(_stream(spark, sf, "events")))
    done = _last(_drain(counts, _scratch(spark, "stream-audit"), "update"), ["window_start", "action"])
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "action", "n")


def _ledger(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "concat('INS-', cast(o_orderkey AS string)) AS inspection_id", "concat('Item ', cast(o_custkey % 97 AS string)) AS product_name",
        "concat('C', cast(o_custkey % 5 AS string)) AS category", "'Depot' AS location", "'Inspector' AS inspector_name",
        "CASE o_orderstatus WHEN 'F' THEN '7A COMPLIANT' WHEN 'O' THEN '7B VIOLATION' ELSE 'PENDING' END AS overall_status",
        "o_orderpriority LIKE '1-%' AS route_7b_triggered", "cast(NULL AS string) AS officer_decision", "cast(o_orderdate AS timestamp) AS created_at")


@query("stream_kpi", """
SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day, concat('C', cast(o_custkey % 5 AS varchar)) AS category, count(*) AS total,
  count(*) FILTER (o_orderstatus = 'F') AS compliant, count(*) FILTER (o_orderstatus = 'O') AS violations, count(*) FILTER (o_orderstatus = 'P') AS pending
FROM orders GROUP BY 1, 2
""")
def _stream_kpi(spark, sf):
    counts = jobs.kpi_stream(_ledger(_stream(spark, sf, "orders")))
    done = _last(_drain(counts, _scratch(spark, "stream-kpi"), "update"), ["window_start", "category"])
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "category", "total", "compliant", "violations", "pending")


@query("stream_new_inspection", """
SELECT concat('INS-', cast(o_orderkey AS varchar)) AS inspection_id, 'NEW_INSPECTION' AS event,
  CASE o_orderstatus WHEN 'F' THEN '7A COMPLIANT' WHEN 'O' THEN '7B VIOLATION' ELSE 'PENDING' END AS overall_status FROM orders
""")
def _stream_new(spark, sf):
    feed = jobs.new_inspections(_ledger(_stream(spark, sf, "orders")))
    return _drain(feed, _scratch(spark, "stream-new")).select("inspection_id", "event", "overall_status")


@query("stream_override_feed", """
SELECT concat('CASE-', cast(o_custkey AS varchar)) AS inspection_id, o_orderkey % 5 AS desk, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 2 = 1 THEN 'WARNING' ELSE 'ALERT' END AS severity
FROM orders WHERE o_orderkey % 3 <> 0
""")
def _stream_override(spark, sf):
    new = "CASE o_orderstatus WHEN 'F' THEN '7A COMPLIANT' WHEN 'O' THEN '7B VIOLATION' ELSE 'PENDING' END"
    amend = _stream(spark, sf, "orders").selectExpr(
        "concat('CASE-', cast(o_custkey AS string), '|', cast(o_orderkey % 5 AS string)) AS inspection_id", f"{new} AS new_verdict",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 1 THEN 'HOLD' WHEN o_orderstatus = 'F' THEN '7B VIOLATION' ELSE '7A COMPLIANT' END AS previous_verdict",
        "o_orderdate AS amended_at")
    rows = _drain(jobs.override_feed(amend), _scratch(spark, "stream-override"))
    parts = F.split("inspection_id", r"\|")
    return rows.select(parts[0].alias("inspection_id"), parts[1].cast("long").alias("desk"), "severity")


@query("stream_dedup_scan", "SELECT DISTINCT concat('SCAN-', cast(event_id // 3 AS varchar)) AS scan_id FROM events")
def _stream_dedup(spark, sf):
    scans = _stream(spark, sf, "events").selectExpr(
        "concat('SCAN-', cast(event_id DIV 3 AS string)) AS scan_id", "cast(ts AS timestamp) AS event_time")
    folder = _scratch(spark, "stream-dedup")
    return stored_scans(scans, folder).select("scan_id")


def _keep_state_on_disk(spark: SparkSession) -> None:
    """State that grows with the stream belongs into RocksDB, not onto the heap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stored_scans(scans: DataFrame, folder: str) -> DataFrame:
    """Runs the de-duplication to the end of its input and reads what it stored."""
    _keep_state_on_disk(scans.sparkSession)
    return _drain(jobs.dedup_scans(scans), folder)


def captured_frames(frames: DataFrame, folder: str) -> DataFrame:
    """Runs the capture of steady frames to the end of its input and reads the captures."""
    running = jobs.stable_frames_stream(frames, folder).option("checkpointLocation", f"{folder}/state")
    running.trigger(availableNow=True).start().awaitTermination()
    return frames.sparkSession.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


_MOTION = """
SELECT event_id, event_time, user_id, metric, coalesce(abs(metric - lag(metric) OVER w), 0.0) AS delta
FROM fx_audit WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)
"""


@query("stream_stable_frames", f"""
SELECT user_id, event_id, streak FROM (
SELECT *, CASE WHEN steady THEN sum(CASE WHEN steady THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_time, event_id) ELSE 0 END::bigint AS streak FROM (
  SELECT *, sum(CASE WHEN steady THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS island FROM (
    SELECT *, metric >= 55.0 AND delta < 8.5 AS steady FROM ({_MOTION}) m) a) b) c WHERE streak >= 2
""")
def _stream_frames(spark, sf):
    frames = _audit(_stream(spark, sf, "events")).select("user_id", "event_id", "event_time", "metric")
    return captured_frames(frames, _scratch(spark, "stream-frames")).select("user_id", "event_id", "streak")


@query("stream_screening", "SELECT inspection_id, rule_id, status FROM vx_verdicts")
def _stream_screening(spark, sf):
    """The batch carries its packages and their declarations; no table is read beside the stream."""
    folder = _scratch(spark, "stream-screening")
    running = jobs.screen_batches(
        _stream(spark, sf, "part"), packages_of, declarations_of, catalog.rules(spark), TODAY, f"{folder}/out")
    running.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return done.select("inspection_id", "rule_id", "status")
