"""Readers: rule catalogues, provenance tables, ledgers, uploads, nested scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.plans.catalog import RULE_SCHEMA

RAW_RULE_SCHEMA = (
    "rule_id string, provision_id string, field string, description string, validation_type string, parameters string, "
    "severity string, applicability string, effective_from string, effective_to string, verification_status string, notes string"
)
PROVENANCE_SCHEMAS = {
    "amendments": (
        "id string, gsr_number string, notification_date date, short_title string, commencement_date date, "
        "commencement_status string, amendment_type string, supersedes_amendment_id string, source_id string, summary string"
    ),
    "legal_provisions": (
        "provision_id string, rule_number string, sub_rule string, clause string, parent_provision_id string, title string, "
        "legal_text string, chapter string, status string, effective_from date, effective_to date, "
        "introduced_by_amendment_id string, last_amended_by_amendment_id string, source_id string, source_page string, "
        "verification_status string, confidence string"
    ),
    "source_documents": (
        "id string, filename string, doc_type string, gsr_number string, notification_date string, gazette_no string, pages int, "
        "language string, extraction_method string, extraction_quality string, title string, notes string"
    ),
    "product_categories": "category_id string, name string, description string",
    "compliance_rules": RAW_RULE_SCHEMA,
}


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def is_folder(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(location).isDirectory()


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, on whatever file system it lies."""
    for path in paths:
        if _exists(spark, path):
            return path
    return paths[0]


def read_rules_json(spark: SparkSession, paths: list[str], schema: str = RULE_SCHEMA) -> DataFrame:
    """Rules from a JSON list or from ``{"rules": [...]}``; conditions stay JSON text."""
    path = first_existing(spark, paths)
    both = f"{schema}, rules array<struct<{schema}>>"
    read = spark.read.schema(both).option("multiLine", True).json(path)
    wrapped = read.where("rules IS NOT NULL").select(F.explode("rules").alias("r")).select("r.*")
    listed = read.where("rules IS NULL").select(wrapped.columns)
    return listed.unionByName(wrapped).where("rule_id IS NOT NULL AND rule_id <> ''")


def read_rules_lines(spark: SparkSession, path: str, schema: str = RULE_SCHEMA) -> DataFrame:
    """One rule per line: splits over tasks, unlike a multi-line document."""
    return spark.read.schema(schema).json(path)


def read_provenance_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One provenance CSV, with quoted commas and JSON inside quotes."""
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"}
    return spark.read.options(**options).schema(PROVENANCE_SCHEMAS[name]).csv(f"{folder}/{name}.csv")


def read_provenance(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_provenance_table(spark, folder, name) for name in PROVENANCE_SCHEMAS}


def read_ledger(spark: SparkSession, location: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A ledger table from parquet files or from a live database.

    For a database give ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` in ``properties`` so that all executors read.
    """
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, dbtable=table, **(properties or {})).load()
    return spark.read.parquet(f"{location.rstrip('/')}/{table}")


def ingest_detections(scans: DataFrame) -> DataFrame:
    """One row per detected text, with the full text of its scan."""
    return scans.select(
        "inspection_id", "image_id", "full_text", F.posexplode("detections").alias("position", "d")
    ).select(
        "inspection_id", "image_id", "full_text", "position", F.col("d.text").alias("detected_text"),
        F.col("d.confidence").alias("confidence"), F.to_json("d.bbox").alias("bounding_box"),
    )


def ingest_declarations(scans: DataFrame) -> DataFrame:
    """The declarations map as rows; empty ones drop out, confidence defaults to the scan's."""
    rows = scans.select("inspection_id", "image_id", "overall_confidence", F.explode("declarations").alias("field_name", "d"))
    return rows.where(F.coalesce("d.value", F.lit("")) != "").select(
        "inspection_id", "field_name", F.col("d.value").alias("field_value"),
        F.coalesce("d.confidence", "overall_confidence").alias("confidence"), F.col("image_id").alias("source_ocr_id"),
    )


def judge_uploads(files: DataFrame) -> DataFrame:
    """Adds ``reason`` to path/length rows: why an upload is refused, else null."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn(
        "reason",
        F.when(F.coalesce("length", F.lit(0)) == 0, "empty file")
        .when(~extension.isin(C.IMAGE_EXTENSIONS), "format not allowed")
        .when(F.col("length") > C.MAX_FILE_BYTES, "larger than 25 MB"),
    )


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads with their verdict; only metadata is read, not the pictures."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return judge_uploads(files.select("path", "length", "modificationTime"))
