"""Batch runs: reconciled totals, reports, completion and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.functions.columns import n_where, percent
from fettle.operators.history import class_breakdown, region_totals, status_totals
from fettle.schemas import CLASSES

# Admissible file types and the size limit of a batch folder.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tif", ".tiff")
MAX_FILE_BYTES = 64 * 1024 * 1024


TOTAL_COLUMNS = (
    "processed", "regions_found", "clean", "acquisition_failure", "processing_failure", "failed", "regions_total", "crack_regions",
    "scratch_regions", "regions_pct", "clean_pct", "latency_count",
)


def run_totals(inspections: DataFrame, regions: DataFrame, status: str | None = None,
               extra: dict[str, Column] | None = None) -> DataFrame:
    """Eleven figures per run, counted from the same rows the export writes.

    ``extra`` adds aggregates over the same rows, so that a dashboard needs no second pass.

    Regions are first folded to one row per inspection, so the join with the fact is one to
    one and a large run is combined on the map side.
    """
    rows = inspections.where(F.col("batch_run_id").isNotNull())
    if status:
        rows = rows.where(F.col("status") == status)
    per_item = region_totals(regions, ["inspection_id"])
    joined = rows.join(per_item, "inspection_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}_regions") for c in CLASSES]
    totals = joined.groupBy("batch_run_id").agg(
        F.count("*").alias("processed"),
        *[n_where(F.col("status") == s).alias(s)
          for s in ("regions_found", "clean", "acquisition_failure", "processing_failure")],
        *sums, *[c.alias(name) for name, c in (extra or {}).items()],
    )
    return finish_totals(totals)


def finish_totals(totals: DataFrame) -> DataFrame:
    return totals.select(
        *[c for c in totals.columns if c not in ("crack_regions", "scratch_regions")],
        (F.col("acquisition_failure") + F.col("processing_failure")).alias("failed"),
        (F.col("crack_regions") + F.col("scratch_regions")).alias("regions_total"),
        "crack_regions", "scratch_regions",
        percent("regions_found", "processed").alias("regions_pct"),
        percent("clean", "processed").alias("clean_pct"),
    )


def totals_for_runs(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Every run, with zeros where nothing was stored; other aggregates than counts and shares stay unknown."""
    joined = runs.select("batch_run_id").join(totals, "batch_run_id", "left")
    zero = [c for c in totals.columns if c in TOTAL_COLUMNS]
    return joined.select("batch_run_id", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) if c in zero else F.col(c) for c, t in totals.dtypes if c != "batch_run_id"])


def run_results(rows: DataFrame, regions: DataFrame, only_with_regions: bool = False) -> DataFrame:
    kept = rows.where(F.col("status") == "regions_found") if only_with_regions else rows
    return kept.join(class_breakdown(regions).select("inspection_id", "text"), "inspection_id", "left").withColumn(
        "class_breakdown", F.coalesce("text", F.lit("—"))
    ).drop("text")


def run_report(runs: DataFrame, inspections: DataFrame, regions: DataFrame, status: str) -> DataFrame:
    """Each run with its totals and with the totals under a status filter."""
    full = totals_for_runs(runs, run_totals(inspections, regions))
    some = totals_for_runs(runs, run_totals(inspections, regions, status))
    keep = ["processed", "regions_found", "clean", "failed", "regions_total"]
    some = some.select("batch_run_id", *[F.col(c).alias(f"filtered_{c}") for c in keep])
    return full.select("batch_run_id", *keep).join(some, "batch_run_id")


def recent_runs(runs: DataFrame, materials: DataFrame, n: int) -> DataFrame:
    top = runs.orderBy(F.col("batch_run_id").desc()).limit(n)
    return top.join(materials.select("material_code", "material_name"), "material_code", "left")


def finished_runs(runs: DataFrame, totals: DataFrame, finished_at: Column) -> DataFrame:
    """Run rows as they are written once at completion, counters taken from the totals."""
    t = totals.select("batch_run_id", "processed", "clean", "regions_found", "failed")
    zero = F.lit(0).cast("bigint")
    return runs.join(t, "batch_run_id", "left").select(
        "batch_run_id", "started_at", finished_at.alias("finished_at"),
        F.coalesce("processed", zero).alias("image_count"),
        F.coalesce("clean", zero).alias("clean_count"),
        F.coalesce("regions_found", zero).alias("regions_found_count"),
        F.coalesce("failed", zero).alias("failure_count"),
        F.lit("completed").alias("status"),
    )


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def candidate_files(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """Files a batch may read: known extension and not above the size limit."""
    return files.where(suffix_of(F.col(path)).isin(*IMAGE_SUFFIXES) & (F.col(size) <= MAX_FILE_BYTES))


def list_folder(spark, folder: str) -> DataFrame:
    """File metadata of a folder tree, without reading contents."""
    return candidate_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime"))


def folder_listing(folders: DataFrame) -> DataFrame:
    """(root_rank, name, files): the lowest root wins where folders share a name."""
    per_root = folders.groupBy("name", "root_rank").agg(F.sum("files").alias("files"))
    return per_root.groupBy("name").agg(
        F.min("root_rank").alias("root_rank"), F.min_by("files", "root_rank").alias("image_count")
    )


def dry_run(files: DataFrame) -> DataFrame:
    """Candidate files per run; nothing is inspected."""
    return candidate_files(files).groupBy("batch_run_id").agg(F.count("*").alias("image_count")).withColumn(
        "status", F.lit("dry_run")
    )


__all__ = [
    "candidate_files", "dry_run", "finished_runs", "folder_listing", "list_folder", "recent_runs", "run_report",
    "run_results", "run_totals", "status_totals", "suffix_of", "totals_for_runs",
]
