"""Row rules of the inspection store: defaults, banners, upserts and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.functions.columns import empty_to_null, n_where
from fettle.schemas import FAILURES, LIMITED_STATES, STATUSES
from fettle.sources.files import file_digest

MIB = 1024 * 1024


def banner(rows: DataFrame, breakdown: DataFrame) -> DataFrame:
    """State, headline, detail and reason of the result banner."""
    joined = rows.join(breakdown.select("inspection_id", "text"), "inspection_id", "left")
    found, clean = F.col("status") == "regions_found", F.col("status") == "clean"
    plural = F.when(F.col("region_count") == 1, "").otherwise("S")
    headline = F.concat(F.col("region_count").cast("string"), F.lit(" REGION"), plural, F.lit(" FOUND"))
    return joined.select(
        "inspection_id",
        F.when(found, "regions_found").when(clean, "clean").otherwise("could_not_process").alias("state"),
        F.when(found, headline).when(clean, "NO DEFECTS FOUND").otherwise("COULD NOT PROCESS").alias("headline"),
        F.when(found, F.coalesce("text", F.lit(""))).when(clean, "Recorded with an empty region list")
        .otherwise(F.coalesce("error_code", "status")).alias("detail"),
        F.when(~found & ~clean, F.col("error_message")).alias("reason"),
    )


def default_product_id(given: Column, file_name: Column, digest: Column, source: str) -> Column:
    """The given id, else the sanitised file stem of at most 32 characters, else a digest prefix."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    tidy = empty_to_null(F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", ""), 1, 32))
    return F.coalesce(empty_to_null(given), F.concat(F.lit(f"{source}/"), F.coalesce(tidy, F.substring(digest, 1, 8))))


def prefixed_product_id(path: Column, prefix: str | None) -> Column:
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.lit(prefix), stem) if prefix else stem


def within_limit(payload: Column, limit: int) -> Column:
    return F.octet_length(payload) <= limit


def portable_path(path: Column, roots: list[str]) -> Column:
    """The path below the first root that holds it; unchanged outside all roots."""
    choices = [F.when(path.startswith(r.rstrip("/") + "/"), F.substr(path, F.lit(len(r.rstrip("/")) + 2))) for r in roots]
    return F.coalesce(*choices, path)


def derived_status(status: Column, n_regions: Column) -> Column:
    """A missing status follows the region list; an unknown one is a failure, never clean."""
    given = empty_to_null(status)
    return (
        F.when(given.isNull(), F.when(n_regions > 0, "regions_found").otherwise("clean"))
        .when(given.isin(*STATUSES), given)
        .otherwise("processing_failure")
    )


def processed_at_default(recorded: Column, captured: Column, latency_ms: Column) -> Column:
    lag = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.coalesce(latency_ms, F.lit(0.0)) / 1000).cast("decimal(18,6)"))
    return F.coalesce(recorded, captured + lag)


def class_of_channel(channel: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(F.lit(1), F.lit("crack"), F.lit(2), F.lit("scratch")), channel), F.lit("crack"))


# Accepted producer keys per canonical column, in order of preference.
REGION_ALIASES = {
    "class_code": ("type", "class_code", "class", "class_name", "label"),
    "area_px": ("area_px", "area"),
    "length_px": ("length_px", "length"),
    "max_width_px": ("max_width_px", "max_width", "width_px"),
    "bbox": ("bbox_xywh", "bbox", "bounding_box", "box"),
    "centroid": ("centroid", "center", "centre"),
    "region_index": ("id", "region_index", "index"),
}


def canonical_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Producer columns renamed to canonical ones, the first present alias wins."""
    out = [F.col(c) for c in keep]
    for canonical, aliases in REGION_ALIASES.items():
        present = [F.col(a) for a in aliases if a in df.columns]
        if present:
            out.append(F.coalesce(*present).alias(canonical))
    return df.select(*out)


def canonical_from_json(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """The same for JSON payloads whose keys differ from row to row. A payload is parsed once; one that is no JSON has no values."""
    parsed = df.select(*keep, F.try_parse_json(payload).alias("__v"))
    fields = [F.coalesce(*[F.try_variant_get("__v", f"$.{a}", "string") for a in aliases]).alias(name) for name, aliases in REGION_ALIASES.items()]
    return parsed.select(*keep, *fields)


def model_info(models: DataFrame, metrics: DataFrame) -> DataFrame:
    """Stored model row, gaps filled from the measured file, field by field."""
    m = metrics.select(*[F.col(c).alias(f"m_{c}") if c != "artefact_sha256" else F.col(c) for c in metrics.columns])
    joined = models.join(m, "artefact_sha256", "left")
    sha = F.col("artefact_sha256")
    short = F.when(F.length(sha) > 10, F.concat(F.substring(sha, 1, 4), F.lit("…"), F.substring(sha, -3, 3))).otherwise(sha)
    filled = [F.coalesce(c, f"m_{c}").alias(c) for c in ("file_name", "version", "parameter_count", "latency_ms")]
    return joined.select("model_version_id", short.alias("sha_short"), *filled)


def coverage(materials: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured coverage joined onto the materials, with a flag for limited evidence."""
    joined = materials.join(measured, "material_code", "left")
    return joined.select(
        "material_code", "support_status", F.col("support_status").isin(*LIMITED_STATES).alias("is_limited"),
        "training_masks", F.coalesce(F.col("training_masks").cast("string"), F.lit("—")).alias("training_masks_display"),
        "cl_dice", F.coalesce(empty_to_null("measured_notes"), empty_to_null("notes"), F.lit("")).alias("notes"),
    )


def missing_codes(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore: incoming codes that are not stored, once each."""
    return incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def new_stations(stations: DataFrame, codes: DataFrame) -> DataFrame:
    fresh = missing_codes(stations, codes, "station_code").select("station_code")
    return fresh.select(
        "station_code", F.substring_index("station_code", "-cam", 1).alias("line_code"),
        F.lit(None).cast("double").alias("mm_per_pixel"), F.lit("ok").alias("camera_status"),
    )


def register_models(stored: DataFrame, incoming: DataFrame, newest: str = "registered_no") -> DataFrame:
    """Upsert by digest. Known values survive a null; the last registered model alone is active."""
    last = incoming.agg(F.max_by("artefact_sha256", newest).alias("sha")).scalar()
    new = incoming.groupBy("artefact_sha256").agg(
        F.max_by(F.struct("file_name", "version", "parameter_count", "latency_ms"), newest).alias("n")
    )
    joined = stored.join(new, "artefact_sha256", "full_outer")
    hit = F.col("n").isNotNull()
    return joined.select(
        "artefact_sha256",
        F.when(hit, F.col("n.file_name")).otherwise(F.col("file_name")).alias("file_name"),
        F.when(hit, F.col("n.version")).otherwise(F.col("version")).alias("version"),
        F.coalesce("n.parameter_count", "parameter_count").alias("parameter_count"),
        F.coalesce("n.latency_ms", "latency_ms").alias("latency_ms"),
        (F.col("artefact_sha256") == last).alias("is_active"),
        F.when(hit & F.col("model_version_id").isNull(), "registered").when(hit, "updated").otherwise("kept").alias("action"),
    )


def retention_candidates(rows: DataFrame, now: Column) -> DataFrame:
    """Media that may go: after 48 hours when clean, 90 days with regions. Rows always stay.

    The limits are hours on the clock and plain comparisons, so they reach the scan.
    """
    def older(span: str) -> Column:
        return F.col("captured_at") < now.cast("timestamp_ntz") - F.expr(f"INTERVAL {span}")

    expired = ((F.col("status") == "clean") & older("48 HOURS")) | ((F.col("status") == "regions_found") & older("90 DAYS"))
    return rows.where(expired).select("inspection_id", "status", F.datediff(now, F.col("captured_at")).cast("bigint").alias("age_days"))


def finding(name: str, rows: DataFrame) -> DataFrame:
    """A check as one row: its name and the number of offending rows."""
    return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    (fk, pk), = keys.items()
    parents = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(parents, fk, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def region_count_mismatch(inspections: DataFrame, regions: DataFrame) -> DataFrame:
    counts = regions.groupBy("inspection_id").agg(F.count("*").alias("found"))
    joined = inspections.join(counts, "inspection_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.where(~F.col("region_count").eqNullSafe(F.col("found")))


def with_unexpected_regions(inspections: DataFrame, regions: DataFrame, statuses: tuple[str, ...] = FAILURES) -> DataFrame:
    return inspections.where(F.col("status").isin(*statuses)).join(regions, "inspection_id", "left_semi")


def bad_geometry(regions: DataFrame, width: int, height: int) -> DataFrame:
    x, y, w, h = (F.col(f"bbox_{k}") for k in ("x", "y", "width", "height"))
    box = (x < 0) | (y < 0) | (x + w > width) | (y + h > height)
    values = [F.col(c).cast("double") for c in ("area_px", "length_px", "max_width_px")]
    bad = reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf")) for v in values])
    return regions.agg(n_where(box).alias("bad_box"), n_where(bad).alias("bad_number"))


def health_rollup(checks: DataFrame) -> DataFrame:
    """Worst state of (station, label, state) checks with the failing and degraded labels."""
    level = F.when(F.col("state") == "failed", 2).when(F.col("state") == "warning", 1).otherwise(0)

    def labels(state: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col("state") == state, F.col("label")))), ",")

    worst = F.max(level)
    return checks.groupBy("station_code").agg(
        F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("failed")), worst + 1).alias("overall"),
        labels("failed").alias("failing"), labels("warning").alias("degraded"), (worst == 2).alias("blocks_inspection"),
    )


def thresholds_in_sync(profiles: DataFrame, module: dict[str, float]) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in module.items()])
    return profiles.select("profile_id", same.alias("in_sync"))



MODEL_STATE = "model_version_id BIGINT, file_name STRING, expected STRING, actual STRING, state STRING"


def model_state(active: DataFrame, folder: str, configured: str | None = None) -> DataFrame:
    """Whether the file of the active model is the one expected: ``verified``, ``mismatch`` or ``missing``.

    ``active`` has the one active model, or none. Expected is the configured digest, else the one stored with the model; without
    either any file will do. Only that model's file is read, whatever else the folder holds.
    """
    spark, row = active.sparkSession, active.select("model_version_id", "file_name", "artefact_sha256").first()
    if row is None:
        return spark.createDataFrame([], MODEL_STATE)
    expected = (configured or row["artefact_sha256"] or "").strip().lower()
    found = file_digest(spark, f"{folder}/{row['file_name']}").agg(F.min("sha256").alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when((F.lit(expected) == "") | (F.col("actual") == expected), "verified").otherwise("mismatch")
    return found.select(F.lit(row["model_version_id"]).cast("bigint").alias("model_version_id"), F.lit(row["file_name"]).alias("file_name"), F.lit(expected).alias("expected"), "actual", state.alias("state"))
