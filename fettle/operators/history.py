"""Filtered inspection history: one predicate answers the table, the totals and the exports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fettle.functions.columns import all_of, n_where, percent
from fettle.operators.ranking import running
from fettle.schemas import CLASSES, STATUSES

PAGE_SIZE, MIN_PAGE, MAX_PAGE = 25, 5, 200


@dataclass(frozen=True)
class HistoryFilter:
    date_from: str | None = None
    date_to: str | None = None
    material: str | None = None
    status: str | None = None
    defect_class: str | None = None
    station: str | None = None
    product: str | None = None
    batch_run_id: int | None = None
    page: int = 1
    page_size: int = PAGE_SIZE

    def active(self) -> dict[str, Any]:
        shown = ("date_from", "date_to", "material", "status", "defect_class", "station", "product")
        return {("class" if k == "defect_class" else k): getattr(self, k) for k in shown if getattr(self, k)}


def parse_filter(params: Mapping[str, Any]) -> HistoryFilter:
    """Request parameters to a filter: blanks and unknown statuses dropped, page and size clamped."""

    def text(key: str) -> str | None:
        return (str(params.get(key) or "").strip()) or None

    def whole(key: str, default: int) -> int:
        try:
            return int(str(params.get(key, default)).strip())
        except ValueError:
            return default

    status = text("status")
    return HistoryFilter(
        date_from=text("date_from"),
        date_to=text("date_to"),
        material=text("material"),
        status=status if status in STATUSES else None,
        defect_class=text("class"),
        station=text("station"),
        product=text("product_id"),
        page=max(1, whole("page", 1)),
        page_size=min(MAX_PAGE, max(MIN_PAGE, whole("page_size", PAGE_SIZE))),
    )


def product_pattern(text: str) -> str:
    """``*`` is the wildcard; without one the text matches anywhere. A backslash is a plain character."""
    pattern = text.replace("\\", "\\\\").replace("*", "%")
    return pattern if "%" in pattern else f"%{pattern}%"


def predicate(f: HistoryFilter) -> Column:
    """The row conditions; they are plain comparisons, so they reach the parquet scan."""
    parts: list[Column] = []
    if f.date_from:
        parts.append(F.col("captured_at") >= F.lit(f.date_from).cast("timestamp_ntz"))
    if f.date_to:
        end = F.lit(f.date_to).cast("timestamp_ntz")
        whole_day = len(f.date_to) <= 10
        parts.append(F.col("captured_at") < end + F.expr("INTERVAL 1 DAY") if whole_day else F.col("captured_at") <= end)
    if f.material:
        parts.append(F.col("material_code") == f.material)
    if f.status:
        parts.append(F.col("status") == f.status)
    if f.station:
        parts.append(F.col("station_code") == f.station)
    if f.product:
        parts.append(F.col("product_id").ilike(product_pattern(f.product)))
    if f.batch_run_id is not None:
        parts.append(F.col("batch_run_id") == f.batch_run_id)
    return all_of(parts)


def matching(inspections: DataFrame, regions: DataFrame, f: HistoryFilter) -> DataFrame:
    """Inspections that satisfy every part of the filter."""
    kept = inspections.where(predicate(f))
    return having_class(kept, regions, f.defect_class) if f.defect_class else kept


def having_class(inspections: DataFrame, regions: DataFrame, class_code: str) -> DataFrame:
    hits = regions.where(F.col("class_code") == class_code).select("inspection_id")
    return inspections.join(hits, "inspection_id", "left_semi")


def regions_of(regions: DataFrame, inspections: DataFrame) -> DataFrame:
    """Regions whose inspection is in the given set."""
    return regions.join(inspections.select("inspection_id"), "inspection_id", "left_semi")


def longest_region(regions: DataFrame) -> DataFrame:
    return regions.groupBy("inspection_id").agg(F.max("length_px").alias("max_length_px"))


def with_dimensions(inspections: DataFrame, material: DataFrame, station: DataFrame, model: DataFrame,
                    profile: DataFrame) -> DataFrame:
    """Fact left joined to its four dimensions, without moving the fact.

    A dimension's key has a handful of values (five materials, two profiles), so a shuffle by it would put the fact into as
    many tasks, and Spark can't tell from a list that is derived from a large table how short it is. Materials, stations and
    profiles are lists of the plant's setup. Of the models, which pile up, only those that the fact names are sent.
    """
    m = material.select("material_code", "material_name", "support_status")
    s = station.select("station_code", "line_code", "mm_per_pixel")
    named = inspections.select("model_version_id").distinct()
    v = model.select("model_version_id", F.col("version").alias("model_version"),
                     F.col("file_name").alias("model_file_name"), "artefact_sha256").join(named, "model_version_id", "left_semi")
    p = profile.select("profile_id", F.col("version_no").alias("profile_version"), "crack_threshold",
                       "scratch_threshold", "minimum_area_px", "minimum_skeleton_px")
    return (
        inspections.join(F.broadcast(m), "material_code", "left")
        .join(F.broadcast(s), "station_code", "left")
        .join(F.broadcast(v), "model_version_id", "left")
        .join(F.broadcast(p), "profile_id", "left")
    )


HISTORY_COLUMNS = (
    "inspection_id", "product_id", "captured_at", "processed_at", "status", "region_count", "latency_ms",
    "image_sha256", "source_image_path", "overlay_image_path", "error_code", "error_message", "batch_run_id", "material_code", "material_name",
    "support_status", "station_code", "model_version", "model_file_name", "artefact_sha256", "profile_version",
    "crack_threshold", "scratch_threshold", "minimum_area_px", "minimum_skeleton_px", "max_length_px",
)


def history_rows(inspections: DataFrame, regions: DataFrame, material: DataFrame, station: DataFrame,
                 model: DataFrame, profile: DataFrame) -> DataFrame:
    """The wide history row: fact, dimensions and the longest region."""
    wide = with_dimensions(inspections, material, station, model, profile)
    return wide.join(longest_region(regions), "inspection_id", "left").select(*HISTORY_COLUMNS)


def newest_first() -> list[Column]:
    return [F.col("captured_at").desc(), F.col("inspection_id").desc()]


#: The last row of a page up to which each task keeps the rows before it; beyond, rows are numbered over the cluster.
SHALLOW = 10_000


def page(rows: DataFrame, f: HistoryFilter, shallow: int = SHALLOW) -> DataFrame:
    """One page in history order.

    For a page near the front each task keeps only the rows up to the page's end. A deep page is cut from rows that are numbered in
    cells of the order, so no task holds the pages before it.
    """
    before = (f.page - 1) * f.page_size
    if before + f.page_size <= shallow:
        return rows.orderBy(*newest_first()).offset(before).limit(f.page_size)
    numbered = running(rows, [], newest_first(), {}, "__place")
    return numbered.where((F.col("__place") > before) & (F.col("__place") <= before + f.page_size)).orderBy("__place").drop("__place")


def page_after(rows: DataFrame, captured_at: str, inspection_id: int, size: int = PAGE_SIZE) -> DataFrame:
    """The page after a cursor row. Cost does not grow with the depth of the page."""
    at = F.lit(captured_at).cast("timestamp_ntz")
    older = (F.col("captured_at") < at) | ((F.col("captured_at") == at) & (F.col("inspection_id") < inspection_id))
    return rows.where(older).orderBy(*newest_first()).limit(size)


def page_meta(rows: DataFrame, f: HistoryFilter) -> DataFrame:
    total = F.col("total")
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(total / f.page_size).cast("bigint"))
    first = F.when(total == 0, 0).otherwise((f.page - 1) * f.page_size + 1).cast("bigint")
    return rows.agg(F.count("*").alias("total")).select(
        "total",
        pages.alias("page_count"),
        F.lit(f.page > 1).alias("has_prev"),
        (F.lit(f.page) < pages).alias("has_next"),
        first.alias("first_index"),
        F.least(total, F.lit(f.page * f.page_size)).cast("bigint").alias("last_index"),
    )


def status_counts(*by: str):
    """Aggregates for one count per status, all present, plus their sum."""
    counts = [n_where(F.col("status") == s).alias(s) for s in STATUSES]
    return counts + [n_where(F.col("status").isin(*STATUSES)).alias("processed")]


def status_totals(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(*status_counts())


def region_totals(regions: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = [n_where(F.col("class_code") == c).alias(c) for c in CLASSES]
    return regions.groupBy(*(by or [])).agg(*counts, n_where(F.col("class_code").isin(*CLASSES)).alias("total"))


def class_breakdown(regions: DataFrame) -> DataFrame:
    """Per inspection: class -> count as a map, and as the text shown in tables."""
    counts = regions.groupBy("inspection_id", "class_code").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("class_code", "n")))
    return counts.groupBy("inspection_id").agg(pairs.alias("pairs")).select(
        "inspection_id",
        F.map_from_entries("pairs").alias("breakdown"),
        F.array_join(F.transform("pairs", lambda p: F.concat_ws(" ", p["n"].cast("string"), p["class_code"])), ", ").alias("text"),
    )


def outcome_share(rows: DataFrame) -> DataFrame:
    """Share of the total per present status; the window runs over the few status counts."""
    counts = rows.groupBy("status").agg(F.count("*").alias("n")).where(F.col("n") > 0)
    return counts.withColumn("share_pct", percent("n", F.sum("n").over(W.partitionBy()), 4))


def latest_per_station(rows: DataFrame) -> DataFrame:
    """Newest record per station by id, never by capture time."""
    fields = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("station_code").agg(F.max_by(fields, "inspection_id").alias("r")).select("r.*")


def latest_or_any(rows: DataFrame, station: str) -> DataFrame:
    """The station's newest record, or the newest of any station when it has none."""
    ranked = rows.orderBy((F.col("station_code") == station).desc_nulls_last(), F.col("inspection_id").desc())
    return ranked.limit(1)


def newest_with_regions(rows: DataFrame, station: str) -> DataFrame:
    """The live item when it has regions, else the newest item that has, else the live item."""
    live = latest_or_any(rows, station).select(F.struct("inspection_id", "region_count").alias("r")).scalar()
    other = rows.where(F.col("region_count") > 0).orderBy(*newest_first()).limit(1).select("inspection_id").scalar()
    pick = F.when(live["region_count"] > 0, live["inspection_id"]).otherwise(F.coalesce(other, live["inspection_id"]))
    return rows.agg(F.max(F.lit(1)).alias("one")).select(pick.alias("inspection_id"))


def region_neighbours(regions: DataFrame) -> DataFrame:
    """Previous and next region index within each inspection, which has a handful of regions by nature."""
    w = W.partitionBy("inspection_id").orderBy("region_index")
    near = [F.lag("region_index").over(w).alias("prev_index"), F.lead("region_index").over(w).alias("next_index")]
    return regions.select("inspection_id", "region_index", *near)


def pick_region(regions: DataFrame, wanted: int) -> DataFrame:
    """The requested region of each inspection, else its first, with neighbours."""
    nav = region_neighbours(regions)
    fields = F.struct(*nav.columns)
    order = F.struct((F.col("region_index") == wanted).cast("int").alias("hit"), (-F.col("region_index")).alias("i"))
    return nav.groupBy("inspection_id").agg(F.max_by(fields, order).alias("r")).select("r.*")


def active_profile(profiles: DataFrame, material: str | None) -> DataFrame:
    """The profile in force: the material's own first, then the global one, highest version."""
    specific = F.coalesce(F.col("material_code") == F.lit(material), F.lit(False))
    general = F.col("material_code").isNull()
    live = profiles.where("is_active")
    return live.orderBy(specific.desc(), general.desc(), F.col("version_no").desc()).limit(1)


def active_profile_per_material(profiles: DataFrame, materials: DataFrame) -> DataFrame:
    """The profile in force for every material: its own highest version, else the global one."""
    live, chosen = profiles.where("is_active"), F.struct("profile_id", "version_no")
    own = live.where("material_code IS NOT NULL").groupBy("material_code").agg(F.max_by(chosen, "version_no").alias("own"))
    general = live.where("material_code IS NULL").agg(F.max_by(chosen, "version_no")).scalar()
    joined = materials.select("material_code").join(own, "material_code", "left")
    return joined.select("material_code", F.coalesce("own", general).alias("p")).select("material_code", "p.*")


def active_model(models: DataFrame) -> DataFrame:
    return models.orderBy(F.col("is_active").desc(), F.col("model_version_id").desc()).limit(1)


def with_filter(f: HistoryFilter, **changes: Any) -> HistoryFilter:
    return replace(f, **changes)

