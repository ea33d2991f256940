"""Flat and nested exports whose totals reconcile with the history, plus record logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fettle.functions.columns import iso, n_where
from fettle.operators.history import HistoryFilter
from fettle.schemas import FAILURES, STATUSES
from fettle.sources.files import read_if_there

REGION_FIELDS = (
    "region_index", "class_code", "area_px", "length_px", "max_width_px", "bbox_x", "bbox_y", "bbox_width",
    "bbox_height", "centroid_x", "centroid_y",
)


def region_csv_rows(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """31 columns: one row per region, or one row for an inspection without regions."""
    r = regions.select("inspection_id", *REGION_FIELDS)
    return rows.join(r, "inspection_id", "left").select(
        "inspection_id", iso("captured_at").alias("captured_at"), "product_id", F.col("material_code").alias("material"),
        F.col("station_code").alias("station"), "status", "region_count", "region_index",
        F.col("class_code").alias("region_class"), *REGION_FIELDS[2:], "max_length_px", "latency_ms", "model_version",
        F.col("artefact_sha256").alias("model_sha256"), "profile_version", "crack_threshold", "scratch_threshold",
        "minimum_area_px", "minimum_skeleton_px", "image_sha256", "error_code", "error_message", "batch_run_id",
    )


def region_array(regions: DataFrame) -> DataFrame:
    """The regions of one inspection as an ordered array of structs."""
    item = F.struct(
        "region_index", "class_code", "area_px", "length_px", "max_width_px",
        F.struct(F.col("bbox_x").alias("x"), F.col("bbox_y").alias("y"), F.col("bbox_width").alias("width"),
                 F.col("bbox_height").alias("height")).alias("bbox"),
        F.struct(F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")).alias("centroid"),
    )
    return regions.groupBy("inspection_id").agg(F.array_sort(F.collect_list(item)).alias("regions"))


def nested(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """One struct per inspection: record, model, profile and region array."""
    joined = rows.join(region_array(regions), "inspection_id", "left")
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<region_index: INT, class_code: STRING, area_px: INT, length_px: DOUBLE,"
                   " max_width_px: DOUBLE, bbox: STRUCT<x: INT, y: INT, width: INT, height: INT>, centroid: STRUCT<x: DOUBLE, y: DOUBLE>>>)")
    document = F.struct(
        "inspection_id", iso("captured_at").alias("captured_at"), iso("processed_at").alias("processed_at"), "product_id",
        F.col("material_code").alias("material"), F.col("station_code").alias("station"), "status", "region_count",
        "latency_ms", "image_sha256", "error_code", "error_message", "batch_run_id",
        F.struct(F.col("model_version").alias("version"), F.col("model_file_name").alias("file_name"), "artefact_sha256").alias("model"),
        F.struct(F.col("profile_version").alias("version_no"), "crack_threshold", "scratch_threshold", "minimum_area_px",
                 "minimum_skeleton_px").alias("profile"),
        F.coalesce("regions", empty).alias("regions"),
    )
    return joined.select("inspection_id", document.alias("document"))


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select("inspection_id", F.to_json("document", {"ignoreNullFields": "false"}).alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    documents.select("document.*").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _with_counts(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Each inspection with the numbers of its regions by class, so that one pass over it gives all totals."""
    per = regions.groupBy("inspection_id").agg(
        n_where(F.col("class_code") == "crack").alias("__crack"), n_where(F.col("class_code") == "scratch").alias("__scratch"), F.count("*").alias("__regions"))
    return rows.select("inspection_id", "status").join(per, "inspection_id", "left")


def envelope(rows: DataFrame, regions: DataFrame, f: HistoryFilter) -> DataFrame:
    """The header of an export: totals, region totals, count and active filters, from one pass over the rows."""
    filters = ";".join(f"{k}={v}" for k, v in f.active().items())
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return _with_counts(rows, regions).agg(
        *[n_where(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("processed"), total("__crack").alias("crack"),
        total("__scratch").alias("scratch"), total("__regions").alias("regions"), F.count("*").alias("count"), F.lit(filters).alias("filters"))


def record_rows(records: DataFrame) -> DataFrame:
    """Flatten canonical records; a clean item still gives one row of type ``none``."""
    head = ["image_sha256", "model_version", "station_id", "product_id", "processed_at", "processing_profile"]
    flat = records.select(*head, F.explode_outer("regions").alias("r"))
    box = F.concat(F.lit("["), F.array_join(F.col("r.bbox_xywh").cast("array<string>"), ", "), F.lit("]"))
    return flat.select(
        *head,
        F.coalesce(F.col("r.id").cast("string"), F.lit("")).alias("region_id"),
        F.coalesce("r.type", F.lit("none")).alias("type"),
        F.coalesce("r.area_px", F.lit(0)).alias("area_px"),
        F.coalesce("r.length_px", F.lit(0.0)).alias("length_px"),
        F.coalesce("r.max_width_px", F.lit(0.0)).alias("max_width_px"),
        F.coalesce(box, F.lit("")).alias("bbox_xywh"),
    )


def records_of(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Canonical records built from the store: regions with ids, types and boxes."""
    item = F.struct(
        F.col("region_index").cast("int").alias("id"), F.col("class_code").alias("type"), "area_px", "length_px",
        "max_width_px", F.array("bbox_x", "bbox_y", "bbox_width", "bbox_height").alias("bbox_xywh"),
    )
    packed = regions.groupBy("inspection_id").agg(F.array_sort(F.collect_list(item)).alias("regions"))
    return rows.join(packed, "inspection_id", "left").select(
        "image_sha256", F.col("model_version_id").cast("string").alias("model_version"),
        F.col("station_code").alias("station_id"), "product_id", iso("processed_at").alias("processed_at"),
        F.col("profile_id").cast("string").alias("processing_profile"), F.col("regions").isNull().alias("empty"), "regions",
    )


def audit_rows(rows: DataFrame) -> DataFrame:
    """One audit line per input; an unreadable capture is an outcome, not an empty result."""
    failed = F.col("status") == "acquisition_failure"
    return rows.select(
        F.col("product_id").alias("path"), F.when(failed, "acquisition_failure").otherwise("ok").alias("status"),
        F.when(~failed, F.col("region_count")).alias("n_regions"), F.when(~failed, F.col("image_sha256")).alias("image_sha256"),
        F.col("station_code").alias("station_id"), F.col("profile_id").alias("processing_profile"),
    )


BATCH, ATTEMPT, COMMITS = "batch", "attempt", "commits"
MARK = f"{ATTEMPT} STRING, {BATCH} STRING"


def append_once(tables: dict[str, DataFrame], folder: str, batch: str, fmt: str = "parquet") -> bool:
    """Append one batch to the tables of ``folder``, all of them or none, and only once; False if it was there already.

    Every attempt writes under a name of its own, and a marker that names the attempt is written last: readers follow the markers, so what
    a killed job left behind is never seen, and a batch that is given again is not written again. Of two jobs that write
    one batch at the same time, the marker of the later one stands, and with it that job's rows alone. Texts are packed by gzip, which readers
    know by the file's name.
    """
    spark = next(iter(tables.values())).sparkSession
    if not _commits(spark, folder).where(F.col(BATCH) == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    packed = {"compression": "gzip"} if fmt == "json" else {}
    for name, rows in tables.items():
        marked = rows.withColumns({BATCH: F.lit(batch), ATTEMPT: F.lit(attempt)})
        marked.write.mode("append").partitionBy(BATCH, ATTEMPT).format(fmt).options(**packed).save(f"{folder}/{name}")
    mark = spark.range(1).select(F.lit(attempt).alias(ATTEMPT), F.lit(batch).alias(BATCH))
    mark.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{folder}/{COMMITS}")
    return True


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return read_if_there(spark, f"{folder}/{COMMITS}", MARK)


def committed(spark: SparkSession, folder: str, name: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    """The rows of a table whose batches are committed; no rows before the first one."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    rows = read_if_there(spark, f"{folder}/{name}", f"{ddl}, {BATCH} STRING, {ATTEMPT} STRING", fmt)
    return rows.join(_commits(spark, folder), [BATCH, ATTEMPT], "left_semi").drop(BATCH, ATTEMPT)


def reconcile(export: DataFrame, rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Export rows must equal regions + clean + failed, its ids the processed items. The store and the export are each read once."""
    quiet = F.col("status").isin("clean", *FAILURES)
    told = _with_counts(rows, regions).agg(
        F.count("*").alias("processed"), (n_where(quiet) + F.coalesce(F.sum("__regions"), F.lit(0))).alias("expected_rows")).select(F.struct("processed", "expected_rows").alias("t")).scalar()
    csv = export.agg(F.count("*").alias("csv_rows"), F.countDistinct("inspection_id").alias("csv_ids")).withColumn("t", told)
    return csv.select(
        "csv_rows", F.col("t.expected_rows").alias("expected_rows"), "csv_ids", F.col("t.processed").alias("processed"),
        ((F.col("csv_rows") == F.col("t.expected_rows")) & (F.col("csv_ids") == F.col("t.processed"))).alias("ok"),
    )


def store_rows(results: DataFrame, stations: DataFrame, materials: DataFrame, models: DataFrame) -> DataFrame:
    """Results with their foreign keys resolved, ready to append to the inspection table.

    Stations and materials are short lists, so a shuffle by them would leave as few tasks to write all results.
    """
    return (
        results.join(F.broadcast(stations.select("station_code", "station_id")), "station_code", "left")
        .join(F.broadcast(materials.select("material_code", "material_id")), "material_code", "left")
        .withColumn("model_version_id", models)
    )


def region_rows(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Regions with the id of their class, ready to append to the region table."""
    return regions.join(classes.select("class_code", "class_id"), "class_code", "left").drop("class_code")


def append_results(inspections: DataFrame, regions: DataFrame, folder: str, batch: str) -> bool:
    """Append a batch of inspections with all their regions to the store in ``folder``; False if it was there already."""
    return append_once({"defect_region": regions, "inspection": inspections}, folder, batch)
