"""Streams over several files give what the batch twin gives."""

import random

from pyspark.sql import functions as F

from panelmark import fixtures as fx
from panelmark.operators import ledger
from panelmark.queries.streams import _audit, _drain, _last, _ledger, captured_frames, stored_scans
from panelmark.streaming import jobs

SF = "/root/testdata/sf0.001"


def cut_into_files(spark, folder, pieces=4):
    events = fx.audit(spark, SF).withColumn("event_time", F.col("event_time").cast("timestamp"))
    span = events.agg(F.min("event_id"), F.max("event_id")).first()
    width = (span[1] - span[0]) // pieces + 1
    for i in range(pieces):
        low = span[0] + i * width
        events.where((F.col("event_id") >= low) & (F.col("event_id") < low + width)).coalesce(1).write.mode("append").parquet(folder)
    return events.schema


def test_stable_frames_match_the_batch(spark, tmp_path):
    source = str(tmp_path / "frames")
    schema = cut_into_files(spark, source)
    got = {(r.user_id, r.event_id, r.streak) for r in captured_frames(jobs.file_stream(spark, source, schema), str(tmp_path / "out")).collect()}
    batch = ledger.stable_frames(fx.audit(spark, SF)).where("capture")
    assert got == {(r.user_id, r.event_id, r.streak) for r in batch.collect()}


def test_one_device_fills_the_batches(spark, tmp_path):
    """Runs go on over batches, a null metric breaks them, and devices that pause keep their standing."""
    source, metrics = str(tmp_path / "frames"), {}
    draw = random.Random(4)
    for i in range(3):
        rows = [("hot", i * 1000 + k, draw.choice([60.0, 61.0, 62.0, 63.0, 40.0, 90.0, None])) for k in range(900)]
        rows += [("rare", i * 1000 + 950 + k, 60.0) for k in range(2) if i != 1]
        for device, event, metric in rows:
            metrics.setdefault(device, []).append((event, metric))
        frame = spark.createDataFrame(rows, "user_id string, event_id long, metric double").withColumn("event_time", F.timestamp_seconds("event_id"))
        frame.coalesce(1).write.mode("append").parquet(source)
    expected = set()
    for device, frames in metrics.items():
        before, streak = None, 0
        for event, metric in frames:
            motion = 0.0 if before is None or metric is None else abs(metric - before)
            streak = streak + 1 if metric is not None and metric >= 55.0 and motion < 8.5 else 0
            before = metric
            if streak >= 2:
                expected.add((device, event, streak))
    stream = jobs.file_stream(spark, source, "user_id string, event_id long, metric double, event_time timestamp")
    got = {(r.user_id, r.event_id, r.streak) for r in captured_frames(stream, str(tmp_path / "out")).collect()}
    assert got == expected and ("rare", 2951, 4) in got


def shuffled_files(spark, rows, folder, pieces=4):
    """The rows in any order over several files, which a stream reads one per batch."""
    for i in range(pieces):
        rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(pieces)) == i).coalesce(1).write.mode("append").parquet(folder)
    return jobs.file_stream(spark, folder, rows.schema)


def test_scan_is_stored_once_over_batches(spark, tmp_path):
    folder = str(tmp_path / "scans")
    for i in range(3):
        spark.sql(f"SELECT 'S' || (id % 5) AS scan_id, timestamp'2024-01-01 00:00:00' + make_dt_interval({9 - 3 * i}) AS event_time FROM range(20)"
                  ).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.file_stream(spark, folder, "scan_id string, event_time timestamp")
    assert stored_scans(stream, str(tmp_path / "out")).count() == 5


def test_shuffled_scans_are_all_stored(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("concat('SCAN-', event_id DIV 3) AS scan_id", "cast(ts AS timestamp) AS event_time")
    stored = stored_scans(shuffled_files(spark, rows, str(tmp_path / "in")), str(tmp_path / "out"))
    assert sorted(r[0] for r in stored.select("scan_id").collect()) == sorted(r[0] for r in rows.select("scan_id").distinct().collect())


def test_shuffled_rows_all_count(spark, tmp_path):
    rows = _ledger(spark.read.parquet(f"{SF}/orders.parquet"))
    updates = _drain(jobs.kpi_stream(shuffled_files(spark, rows, str(tmp_path / "in"))), str(tmp_path / "out"), "update")
    assert _last(updates, ["window_start", "category"]).agg(F.sum("total")).first()[0] == rows.count()
    audit = _audit(spark.read.parquet(f"{SF}/events.parquet"))
    updates = _drain(jobs.audit_stream(shuffled_files(spark, audit, str(tmp_path / "in2"))), str(tmp_path / "out2"), "update")
    assert _last(updates, ["window_start", "action"]).agg(F.sum("n")).first()[0] == audit.count()
