"""Queries over the inspection store: history, batches, analytics, exports, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.functions.columns import iso
from fettle.operators import analytics, batches, exports, history, store
from fettle.operators.history import HistoryFilter, parse_filter
from fettle.plans.catalog import query
from fettle.schemas import STATUSES
from fettle.session import work_path
from fettle.sources import files

DAYS = HistoryFilter(date_from="1996-03-01", date_to="1996-05-31")
MIXED = HistoryFilter(date_from="1995-01-01", date_to="1999-12-31", material="1-URGENT", status="regions_found",
                      defect_class="scratch", station="NATION_3", product="batch-1*")
BRIEF = ("inspection_id", "product_id", "status", "region_count")
B = "inspection_id, product_id, status, region_count"
PROC = "status IN ('regions_found','clean','acquisition_failure','processing_failure')"
COUNTS = ", ".join(f"count(*) FILTER (WHERE status='{s}') AS {s}" for s in STATUSES) + f", count(*) FILTER (WHERE {PROC}) AS processed"
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
MIXED_SQL = """captured_at >= TIMESTAMP '1995-01-01' AND captured_at < TIMESTAMP '2000-01-01' AND material_code='1-URGENT'
 AND status='regions_found' AND station_code='NATION_3' AND product_id ILIKE 'batch-1%'
 AND EXISTS (SELECT 1 FROM defect_region r WHERE r.inspection_id=i.inspection_id AND r.class_code='scratch')"""
WIDE_CTE = """wide AS (SELECT i.*, m.material_name, m.support_status, s.line_code, s.mm_per_pixel, v.version AS model_version, v.file_name AS model_file_name,
 v.artefact_sha256, p.version_no AS profile_version, p.crack_threshold, p.scratch_threshold, p.minimum_area_px, p.minimum_skeleton_px,
 (SELECT max(length_px) FROM defect_region r WHERE r.inspection_id=i.inspection_id) AS max_length_px
 FROM inspection i LEFT JOIN material m ON m.material_code=i.material_code LEFT JOIN station s ON s.station_code=i.station_code
 LEFT JOIN model_version v ON v.model_version_id=i.model_version_id LEFT JOIN profile p ON p.profile_id=i.profile_id)"""
TOTALS_CTE = f"""st AS (SELECT batch_run_id, count(*) AS processed, {", ".join(f"count(*) FILTER (WHERE status='{s}') AS {s}" for s in STATUSES)} FROM inspection WHERE batch_run_id IS NOT NULL GROUP BY batch_run_id),
 rg AS (SELECT i.batch_run_id, count(*) FILTER (WHERE class_code='crack') AS crack_regions, count(*) FILTER (WHERE class_code='scratch') AS scratch_regions
  FROM defect_region r JOIN inspection i ON i.inspection_id=r.inspection_id GROUP BY i.batch_run_id),
 totals AS (SELECT st.*, acquisition_failure+processing_failure AS failed, coalesce(crack_regions,0)+coalesce(scratch_regions,0) AS regions_total,
  coalesce(crack_regions,0) AS crack_regions, coalesce(scratch_regions,0) AS scratch_regions,
  round(regions_found*100.0::DOUBLE/processed,1) AS regions_pct, round(clean*100.0::DOUBLE/processed,1) AS clean_pct
  FROM st LEFT JOIN rg ON rg.batch_run_id=st.batch_run_id)"""
LAT_CTE = """lat AS (SELECT batch_run_id, round(avg(latency_ms),1) AS latency_avg, round(quantile_cont(latency_ms,0.5),1) AS latency_median,
 round(quantile_cont(latency_ms,0.95),1) AS latency_p95, round(max(latency_ms),1) AS latency_max, count(*) AS latency_count
 FROM inspection WHERE batch_run_id IS NOT NULL AND latency_ms IS NOT NULL GROUP BY batch_run_id)"""
DUR_CTE = """dur AS (SELECT batch_run_id, CASE WHEN finished_at>=started_at THEN epoch_us(finished_at)-epoch_us(started_at) END/1e6::DOUBLE AS seconds FROM batch_run)"""


def wide(v):
    return history.history_rows(v.inspection, v.defect_region, v.material, v.station, v.model_version, v.profile)


def filtered(v, f):
    return history.matching(v.inspection, v.defect_region, f).select(*BRIEF)


# --- filters -----------------------------------------------------------------
for _name, _f, _where in (
    ("hist_date_range", DAYS, "captured_at >= TIMESTAMP '1996-03-01' AND captured_at < TIMESTAMP '1996-06-01'"),
    ("hist_material", HistoryFilter(material="2-HIGH"), "material_code='2-HIGH'"),
    ("hist_status", parse_filter({"status": " clean "}), "status='clean'"),
    ("hist_station", HistoryFilter(station="NATION_7"), "station_code='NATION_7'"),
    ("hist_product_like", HistoryFilter(product="BATCH-7*/ITEM-*9"), "product_id ILIKE 'BATCH-7%/ITEM-%9'"),
    ("hist_batch", HistoryFilter(batch_run_id=199703), "batch_run_id=199703"),
    ("hist_has_class", HistoryFilter(defect_class="scratch"),
     "EXISTS (SELECT 1 FROM defect_region r WHERE r.inspection_id=i.inspection_id AND r.class_code='scratch')"),
    ("hist_combined", MIXED, MIXED_SQL),
    ("semi_has_class", HistoryFilter(defect_class="crack", status="regions_found"),
     "status='regions_found' AND inspection_id IN (SELECT inspection_id FROM defect_region WHERE class_code='crack')"),
):
    query(_name, f"SELECT {B} FROM inspection i WHERE {_where}")(lambda v, f=_f: filtered(v, f))


@query("filter_sanitise", "SELECT count(*) AS n, min(inspection_id) AS lo, max(inspection_id) AS hi FROM (SELECT inspection_id FROM inspection WHERE station_code='NATION_1' ORDER BY captured_at DESC, inspection_id DESC LIMIT 200)")
def _(v):
    f = parse_filter({"status": "unknown", "material": "  ", "station": "NATION_1", "page": "-3", "page_size": "9999"})
    p = history.page(history.matching(v.inspection, v.defect_region, f), f)
    return p.agg(F.count("*").alias("n"), F.min("inspection_id").alias("lo"), F.max("inspection_id").alias("hi"))


HROWS = ", ".join(c if c not in ("captured_at", "processed_at") else ISO.format(c) + f" AS {c}" for c in history.HISTORY_COLUMNS)


def iso_times(df):
    return df.withColumns({c: iso(c) for c in ("captured_at", "processed_at") if c in df.columns})


@query("history_rows", f"WITH {WIDE_CTE} SELECT {HROWS} FROM wide")
def _(v):
    return iso_times(wide(v))


@query("explain_one", f"WITH {WIDE_CTE} SELECT {HROWS} FROM wide WHERE inspection_id=42")
def _(v):
    return iso_times(wide(v).where("inspection_id = 42"))


# --- joins -------------------------------------------------------------------
@query("star_left", f"WITH {WIDE_CTE} SELECT inspection_id, material_name, line_code, model_version, profile_version FROM wide")
def _(v):
    w = history.with_dimensions(v.inspection, v.material, v.station, v.model_version, v.profile)
    return w.select("inspection_id", "material_name", "line_code", "model_version", "profile_version")


CLASS_DIM = "(SELECT DISTINCT class_code, upper(substr(class_code,1,1))||substr(class_code,2) AS display_name FROM defect_region)"


@query("region_inner", f"SELECT r.inspection_id, region_index, r.class_code, display_name, area_px, length_px FROM defect_region r JOIN {CLASS_DIM} c ON c.class_code=r.class_code ORDER BY 1,2")
def _(v):
    dim = v.defect_region.select("class_code").distinct().withColumn("display_name", F.initcap("class_code"))
    r = v.defect_region.join(dim, "class_code")
    return r.select("inspection_id", "region_index", "class_code", "display_name", "area_px", "length_px").orderBy("inspection_id", "region_index")


@query("region_three_way", "SELECT class_code, material_code, count(*) AS n FROM defect_region r JOIN inspection i ON i.inspection_id=r.inspection_id WHERE batch_run_id IS NOT NULL GROUP BY 1,2")
def _(v):
    items = v.inspection.where("batch_run_id IS NOT NULL").select("inspection_id", "material_code")
    per_item = v.defect_region.groupBy("inspection_id", "class_code").agg(F.count("*").alias("n"))
    return per_item.join(items, "inspection_id").groupBy("class_code", "material_code").agg(F.sum("n").alias("n"))


@query("in_subquery", f"SELECT inspection_id, region_index, class_code FROM defect_region WHERE inspection_id IN (SELECT inspection_id FROM inspection i WHERE {MIXED_SQL})")
def _(v):
    return history.regions_of(v.defect_region, history.matching(v.inspection, v.defect_region, MIXED)).select("inspection_id", "region_index", "class_code")


@query("scalar_subquery_max", "SELECT inspection_id, (SELECT max(length_px) FROM defect_region r WHERE r.inspection_id=i.inspection_id) AS max_length_px FROM inspection i")
def _(v):
    return v.inspection.select("inspection_id").join(history.longest_region(v.defect_region), "inspection_id", "left")


MEASURED = """(SELECT o_orderpriority AS material_code, count(*) AS training_masks, round(avg(o_totalprice)/1000000,9) AS cl_dice, '' AS measured_notes FROM orders WHERE o_orderpriority < '4' GROUP BY 1)"""


@query("coverage_join", f"""SELECT m.material_code, support_status, support_status IN ('one_product_only','thin_coverage','typing_unsupported','not_supported') AS is_limited,
 training_masks, coalesce(CAST(training_masks AS VARCHAR),'—') AS training_masks_display, cl_dice, coalesce(nullif(measured_notes,''),notes,'') AS notes FROM material m LEFT JOIN {MEASURED} q ON q.material_code=m.material_code""")
def _(v):
    measured = v.orders.where("o_orderpriority < '4'").groupBy(F.col("o_orderpriority").alias("material_code")).agg(
        F.count("*").alias("training_masks"), F.round(F.avg("o_totalprice") / 1000000, 9).alias("cl_dice"), F.lit("").alias("measured_notes"))
    return store.coverage(v.material, measured)


@query("profile_as_recorded", "SELECT i.inspection_id, p.version_no, p.crack_threshold, p.scratch_threshold FROM inspection i LEFT JOIN profile p ON p.profile_id=i.profile_id")
def _(v):
    p = v.profile.select("profile_id", "version_no", "crack_threshold", "scratch_threshold")
    return v.inspection.select("inspection_id", "profile_id").join(p, "profile_id", "left").drop("profile_id")


# --- counts and totals ---------------------------------------------------------
@query("hist_count", f"SELECT count(*) AS n FROM inspection i WHERE {MIXED_SQL}")
def _(v):
    return history.matching(v.inspection, v.defect_region, MIXED).agg(F.count("*").alias("n"))


@query("status_totals", f"SELECT {COUNTS} FROM inspection WHERE material_code='3-MEDIUM'")
def _(v):
    return history.status_totals(history.matching(v.inspection, v.defect_region, HistoryFilter(material="3-MEDIUM")))


@query("region_totals", "SELECT count(*) FILTER (WHERE class_code='crack') AS crack, count(*) FILTER (WHERE class_code='scratch') AS scratch, count(*) AS total FROM defect_region WHERE inspection_id IN (SELECT inspection_id FROM inspection WHERE material_code='3-MEDIUM')")
def _(v):
    f = HistoryFilter(material="3-MEDIUM")
    return history.region_totals(history.regions_of(v.defect_region, history.matching(v.inspection, v.defect_region, f)))


@query("class_breakdown", "SELECT inspection_id, string_agg(n||' '||class_code, ', ' ORDER BY class_code) AS text FROM (SELECT inspection_id, class_code, count(*) AS n FROM defect_region GROUP BY 1,2) GROUP BY 1")
def _(v):
    return history.class_breakdown(v.defect_region).select("inspection_id", "text")


TOT_COLS = "batch_run_id, processed, regions_found, clean, acquisition_failure, processing_failure, failed, regions_total, crack_regions, scratch_regions, regions_pct, clean_pct"
ALL_CTE = "every AS (SELECT b.batch_run_id, " + ", ".join(f"coalesce({c},0) AS {c}" for c in TOT_COLS.split(", ")[1:]) + " FROM batch_run b LEFT JOIN totals t ON t.batch_run_id=b.batch_run_id)"



@query("batch_totals", f"WITH {TOTALS_CTE} SELECT {TOT_COLS} FROM totals")
def _(v):
    return batches.run_totals(v.inspection, v.defect_region)


@query("batch_results", f"""WITH {WIDE_CTE}, bd AS (SELECT inspection_id, string_agg(n||' '||class_code, ', ' ORDER BY class_code) AS text FROM (SELECT inspection_id, class_code, count(*) AS n FROM defect_region GROUP BY 1,2) GROUP BY 1)
 SELECT w.inspection_id, batch_run_id, status, max_length_px, coalesce(text,'—') AS class_breakdown FROM wide w LEFT JOIN bd ON bd.inspection_id=w.inspection_id WHERE batch_run_id IS NOT NULL AND status='regions_found'""")
def _(v):
    rows = wide(v).where("batch_run_id IS NOT NULL").select("inspection_id", "batch_run_id", "status", "max_length_px")
    return batches.run_results(rows, v.defect_region, only_with_regions=True)


@query("batch_report", f"""WITH {TOTALS_CTE}, f AS (SELECT batch_run_id, count(*) AS n FROM inspection WHERE status='clean' AND batch_run_id IS NOT NULL GROUP BY 1)
 SELECT b.batch_run_id, coalesce(processed,0) AS processed, coalesce(regions_found,0) AS regions_found, coalesce(clean,0) AS clean, coalesce(failed,0) AS failed, coalesce(regions_total,0) AS regions_total, coalesce(n,0) AS filtered_processed, 0::BIGINT AS filtered_regions_found, coalesce(n,0) AS filtered_clean, 0::BIGINT AS filtered_failed, 0::BIGINT AS filtered_regions_total
 FROM batch_run b LEFT JOIN totals t ON t.batch_run_id=b.batch_run_id LEFT JOIN f ON f.batch_run_id=b.batch_run_id""")
def _(v):
    return batches.run_report(v.batch_run, v.inspection, v.defect_region, "clean")


@query("latency_stats", f"WITH {LAT_CTE} SELECT * FROM lat")
def _(v):
    return analytics.latency_stats(v.inspection)


@query("session_duration", f"WITH {DUR_CTE} SELECT batch_run_id, round(seconds/60,1) AS duration_min, round(seconds,1) AS duration_seconds FROM dur")
def _(v):
    return analytics.session_durations(v.batch_run).drop("seconds")


THR_CTE = "thr AS (SELECT d.batch_run_id, CASE WHEN seconds>=3 AND processed>0 THEN round(processed/(seconds/60),1) END AS throughput FROM dur d LEFT JOIN st ON st.batch_run_id=d.batch_run_id)"


@query("session_throughput", f"WITH {TOTALS_CTE}, {DUR_CTE}, {THR_CTE} SELECT * FROM thr")
def _(v):
    return analytics.throughput(analytics.session_durations(v.batch_run), batches.run_totals(v.inspection, v.defect_region))


@query("session_dashboard", f"""WITH {TOTALS_CTE}, {ALL_CTE}, {DUR_CTE}, {THR_CTE}, {LAT_CTE} SELECT t.{TOT_COLS}, round(seconds/60,1) AS duration_min, round(seconds,1) AS duration_seconds, throughput,
 latency_avg, latency_median, latency_p95, latency_max, coalesce(latency_count,0) AS latency_count FROM every t LEFT JOIN dur ON dur.batch_run_id=t.batch_run_id LEFT JOIN thr ON thr.batch_run_id=t.batch_run_id LEFT JOIN lat ON lat.batch_run_id=t.batch_run_id""")
def dashboard(v):
    return analytics.session_dashboard(v.inspection, v.defect_region, v.batch_run)


@query("overview_totals", f"WITH t AS (SELECT {COUNTS} FROM inspection WHERE batch_run_id IS NOT NULL) SELECT *, round(clean*100.0::DOUBLE/processed,1) AS clean_pct, round(regions_found*100.0::DOUBLE/processed,1) AS regions_pct FROM t")
def _(v):
    return analytics.overview_totals(v.inspection)


@query("overview_regions", "SELECT count(*) FILTER (WHERE class_code='crack') AS crack, count(*) FILTER (WHERE class_code='scratch') AS scratch, count(*) AS total FROM defect_region r JOIN inspection i ON i.inspection_id=r.inspection_id WHERE batch_run_id IS NOT NULL")
def _(v):
    return analytics.overview_regions(v.inspection, v.defect_region)


@query("clean_pct_trend", f"WITH {TOTALS_CTE}, {ALL_CTE} SELECT batch_run_id, 'Run '||batch_run_id AS label, clean_pct FROM every ORDER BY 1")
def _(v):
    return analytics.clean_pct_trend(batches.totals_for_runs(v.batch_run, batches.run_totals(v.inspection, v.defect_region)))


@query("defect_mix", f"WITH {TOTALS_CTE}, {ALL_CTE} SELECT batch_run_id, crack_regions, scratch_regions FROM every ORDER BY 1 DESC LIMIT 15")
def _(v):
    return analytics.defect_mix(batches.totals_for_runs(v.batch_run, batches.run_totals(v.inspection, v.defect_region)), 15)


@query("session_count", "SELECT count(*) AS n FROM batch_run")
def _(v):
    return v.batch_run.agg(F.count("*").alias("n"))


@query("outcome_share", "SELECT status, count(*) AS n, round(count(*)*100.0::DOUBLE/sum(count(*)) OVER (),4) AS share_pct FROM inspection GROUP BY status")
def _(v):
    return history.outcome_share(v.inspection)


@query("latest_batch_id", "SELECT max(batch_run_id) AS id FROM batch_run")
def _(v):
    return v.batch_run.agg(F.max("batch_run_id").alias("id"))


@query("distinct_options", "SELECT 'material' AS kind, material_code AS code FROM material UNION ALL SELECT 'station', station_code FROM station UNION ALL SELECT DISTINCT 'class', class_code FROM defect_region")
def _(v):
    def options(df, kind, column):
        return df.select(F.lit(kind).alias("kind"), F.col(column).alias("code")).distinct()
    return options(v.material, "material", "material_code").unionByName(options(v.station, "station", "station_code")).unionByName(
        options(v.defect_region, "class", "class_code"))


@query("run_finish", f"WITH {TOTALS_CTE} SELECT b.batch_run_id, {ISO.format('started_at')} AS started_at, {ISO.format('finished_at')} AS finished_at, coalesce(processed,0) AS image_count, coalesce(clean,0) AS clean_count, coalesce(regions_found,0) AS regions_found_count, coalesce(failed,0) AS failure_count, 'completed' AS status FROM batch_run b LEFT JOIN totals t ON t.batch_run_id=b.batch_run_id")
def _(v):
    done = batches.finished_runs(v.batch_run, batches.run_totals(v.inspection, v.defect_region), F.col("finished_at"))
    return done.withColumns({c: iso(c) for c in ("started_at", "finished_at")})


SUFFIX_SQL = "lower(regexp_extract(path,'(\\.[^./]+)$',1)) IN ('.png','.jpg','.jpeg','.bmp','.webp','.tif','.tiff') AND bytes <= 67108864"


@query("dry_run_plan", f"SELECT doc_id%10 AS batch_run_id, count(*) AS image_count, 'dry_run' AS status FROM file_list WHERE {SUFFIX_SQL} GROUP BY 1")
def _(v):
    return batches.dry_run(v.file_list.select("path", F.col("bytes").alias("length"), (F.col("doc_id") % 10).alias("batch_run_id")))


# --- ranking and paging ----------------------------------------------------------
PAGE3 = HistoryFilter(material="1-URGENT", page=3, page_size=25)


@query("history_page", f"WITH {WIDE_CTE} SELECT {HROWS}, (SELECT count(*) FROM inspection WHERE material_code='1-URGENT') AS total FROM wide WHERE material_code='1-URGENT' ORDER BY wide.captured_at DESC, inspection_id DESC LIMIT 25 OFFSET 50")
def _(v):
    kept = history.matching(v.inspection, v.defect_region, PAGE3)
    total = kept.agg(F.count("*").alias("n")).scalar()
    page = history.page(kept, PAGE3)
    regions = history.regions_of(v.defect_region, page)
    rows = history.history_rows(page, regions, v.material, v.station, v.model_version, v.profile)
    return iso_times(rows).withColumn("total", total)


@query("history_page_after", f"SELECT {B} FROM inspection WHERE captured_at < TIMESTAMP '1996-06-01' OR (captured_at = TIMESTAMP '1996-06-01' AND inspection_id < 5000) ORDER BY captured_at DESC, inspection_id DESC LIMIT 25")
def _(v):
    return history.page_after(v.inspection, "1996-06-01", 5000).select(*BRIEF)


@query("page_meta", "SELECT total, greatest(1, CAST(ceil(total/25) AS BIGINT)) AS page_count, true AS has_prev, 3 < greatest(1, CAST(ceil(total/25) AS BIGINT)) AS has_next, 51::BIGINT AS first_index, least(total,75) AS last_index FROM (SELECT count(*) AS total FROM inspection WHERE material_code='1-URGENT')")
def _(v):
    return history.page_meta(history.matching(v.inspection, v.defect_region, PAGE3), PAGE3)


@query("all_matching", f"SELECT {B} FROM inspection WHERE captured_at >= TIMESTAMP '1996-03-01' AND captured_at < TIMESTAMP '1996-06-01' ORDER BY captured_at DESC, inspection_id DESC")
def _(v):
    return history.matching(v.inspection, v.defect_region, DAYS).orderBy(*history.newest_first()).select(*BRIEF)


@query("latest_per_station", f"SELECT station_code, {B} FROM inspection QUALIFY row_number() OVER (PARTITION BY station_code ORDER BY inspection_id DESC)=1")
def _(v):
    return history.latest_per_station(v.inspection.select("station_code", *BRIEF))


@query("recent_runs", "SELECT b.batch_run_id, image_count, b.material_code, material_name FROM (SELECT * FROM batch_run ORDER BY batch_run_id DESC LIMIT 20) b LEFT JOIN material m ON m.material_code=b.material_code")
def _(v):
    return batches.recent_runs(v.batch_run, v.material, 20).select("batch_run_id", "image_count", "material_code", "material_name")


@query("run_timeline", "SELECT i.batch_run_id, inspection_id, row_number() OVER (PARTITION BY i.batch_run_id ORDER BY processed_at, inspection_id) AS processed, round(greatest(0.0, (epoch_us(processed_at)-epoch_us(started_at))/6e7::DOUBLE),4) AS elapsed_min FROM inspection i JOIN batch_run b ON b.batch_run_id=i.batch_run_id")
def _(v):
    return analytics.run_timeline(v.inspection, v.batch_run)


@query("region_nav", "SELECT inspection_id, region_index, lag(region_index) OVER w AS prev_index, lead(region_index) OVER w AS next_index FROM defect_region WINDOW w AS (PARTITION BY inspection_id ORDER BY region_index)")
def _(v):
    return history.region_neighbours(v.defect_region)


@query("region_pick", "SELECT * FROM (SELECT inspection_id, region_index, lag(region_index) OVER w AS prev_index, lead(region_index) OVER w AS next_index FROM defect_region WINDOW w AS (PARTITION BY inspection_id ORDER BY region_index)) QUALIFY row_number() OVER (PARTITION BY inspection_id ORDER BY CASE WHEN region_index=3 THEN 0 ELSE 1 END, region_index)=1")
def _(v):
    return history.pick_region(v.defect_region, 3)


@query("active_profile", "WITH m AS (SELECT DISTINCT o_orderpriority AS want FROM orders) SELECT want, profile_id, version_no FROM m JOIN profile ON is_active AND (material_code=want OR material_code IS NULL) QUALIFY row_number() OVER (PARTITION BY want ORDER BY material_code IS NULL, version_no DESC)=1")
def _(v):
    return history.active_profile_per_material(v.profile, v.material).withColumnRenamed("material_code", "want")


@query("active_profile_for", "SELECT profile_id, version_no, crack_threshold FROM profile WHERE is_active AND (material_code='1-URGENT' OR material_code IS NULL) ORDER BY material_code IS NULL, version_no DESC LIMIT 1")
def _(v):
    return history.active_profile(v.profile, "1-URGENT").select("profile_id", "version_no", "crack_threshold")


@query("active_model", "SELECT model_version_id, version, is_active FROM model_version ORDER BY is_active DESC, model_version_id DESC LIMIT 1")
def _(v):
    return history.active_model(v.model_version).select("model_version_id", "version", "is_active")


@query("newest_with_regions", "WITH live AS (SELECT inspection_id, region_count FROM inspection WHERE station_code='NATION_5' ORDER BY inspection_id DESC LIMIT 1) SELECT CASE WHEN region_count>0 THEN inspection_id ELSE (SELECT inspection_id FROM inspection WHERE region_count>0 ORDER BY captured_at DESC, inspection_id DESC LIMIT 1) END AS inspection_id FROM live")
def _(v):
    return history.newest_with_regions(v.inspection, "NATION_5")


# --- exports ---------------------------------------------------------------------
CSV_TAIL = "area_px, length_px, max_width_px, bbox_x, bbox_y, bbox_width, bbox_height, centroid_x, centroid_y, max_length_px, latency_ms, model_version, artefact_sha256 AS model_sha256, profile_version, crack_threshold, scratch_threshold, minimum_area_px, minimum_skeleton_px, image_sha256, error_code, error_message, batch_run_id"


@query("region_csv_rows", f"WITH {WIDE_CTE} SELECT w.inspection_id, {ISO.format('captured_at')} AS captured_at, product_id, material_code AS material, station_code AS station, status, region_count, region_index, class_code AS region_class, {CSV_TAIL} FROM wide w LEFT JOIN defect_region r ON r.inspection_id=w.inspection_id")
def _(v):
    return exports.region_csv_rows(wide(v), v.defect_region)


@query("inspection_json", f"""WITH {WIDE_CTE}, rg AS (SELECT inspection_id, list({{'region_index': region_index::INT, 'class_code': class_code, 'area_px': area_px, 'length_px': length_px, 'max_width_px': max_width_px,
 'bbox': {{'x': bbox_x, 'y': bbox_y, 'width': bbox_width, 'height': bbox_height}}, 'centroid': {{'x': centroid_x, 'y': centroid_y}}}} ORDER BY region_index) AS regions FROM defect_region GROUP BY 1)
 SELECT w.inspection_id, CAST(to_json({{'inspection_id': w.inspection_id, 'captured_at': {ISO.format('captured_at')}, 'processed_at': {ISO.format('processed_at')}, 'product_id': product_id, 'material': material_code, 'station': station_code,
 'status': status, 'region_count': region_count, 'latency_ms': latency_ms, 'image_sha256': image_sha256, 'error_code': error_code, 'error_message': error_message, 'batch_run_id': batch_run_id,
 'model': {{'version': model_version, 'file_name': model_file_name, 'artefact_sha256': artefact_sha256}},
 'profile': {{'version_no': profile_version, 'crack_threshold': crack_threshold, 'scratch_threshold': scratch_threshold, 'minimum_area_px': minimum_area_px, 'minimum_skeleton_px': minimum_skeleton_px}},
 'regions': coalesce(regions, [])}}) AS VARCHAR) AS json FROM wide w LEFT JOIN rg ON rg.inspection_id=w.inspection_id""")
def _(v):
    return exports.as_json(exports.nested(wide(v), v.defect_region))


ENV = HistoryFilter(material="1-URGENT", station="NATION_3")


@query("export_envelope", f"""WITH k AS (SELECT * FROM inspection WHERE material_code='1-URGENT' AND station_code='NATION_3'), r AS (SELECT count(*) FILTER (WHERE class_code='crack') AS crack, count(*) FILTER (WHERE class_code='scratch') AS scratch, count(*) AS regions FROM defect_region WHERE inspection_id IN (SELECT inspection_id FROM k))
 SELECT t.*, r.*, processed AS count, 'material=1-URGENT;station=NATION_3' AS filters FROM (SELECT {COUNTS} FROM k) t, r""")
def _(v):
    return exports.envelope(history.matching(v.inspection, v.defect_region, ENV), v.defect_region, ENV)


@query("record_rows", f"""SELECT image_sha256, CAST(model_version_id AS VARCHAR) AS model_version, station_code AS station_id, product_id, {ISO.format('processed_at')} AS processed_at, CAST(profile_id AS VARCHAR) AS processing_profile,
 coalesce(CAST(region_index AS VARCHAR),'') AS region_id, coalesce(class_code,'none') AS type, coalesce(area_px,0) AS area_px, coalesce(length_px,0.0) AS length_px, coalesce(max_width_px,0.0) AS max_width_px,
 CASE WHEN region_index IS NULL THEN '' ELSE '['||bbox_x||', '||bbox_y||', '||bbox_width||', '||bbox_height||']' END AS bbox_xywh FROM inspection i LEFT JOIN defect_region r ON r.inspection_id=i.inspection_id""")
def _(v):
    return exports.record_rows(exports.records_of(v.inspection, v.defect_region))


@query("audit_log", """SELECT product_id AS path, CASE WHEN status='acquisition_failure' THEN status ELSE 'ok' END AS status, CASE WHEN status<>'acquisition_failure' THEN region_count END AS n_regions,
 CASE WHEN status<>'acquisition_failure' THEN image_sha256 END AS image_sha256, station_code AS station_id, profile_id AS processing_profile FROM inspection""")
def _(v):
    rows, folder = exports.audit_rows(v.inspection), work_path(v.spark, "audit")
    for batch in ("run 1", "run 2", "run 1"):
        part = F.col("inspection_id") % 3 == 0 if batch == "run 1" else F.col("inspection_id") % 3 != 0
        exports.append_once({"audit": exports.audit_rows(v.inspection.where(part))}, folder, batch, "json")
    return exports.committed(v.spark, folder, "audit", rows.schema, "json")


@query("file_inventory", f"SELECT path, bytes AS length FROM file_list WHERE {SUFFIX_SQL}")
def _(v):
    return batches.candidate_files(v.file_list.select("path", F.col("bytes").alias("length")))


@query("folder_listing", """WITH f AS (SELECT folder AS name, doc_id%3 AS root_rank, count(*) AS files FROM file_list WHERE NOT (doc_id%3=0 AND length(folder)=4) GROUP BY 1,2) SELECT name, root_rank, files AS image_count FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY root_rank)=1""")
def _(v):
    f = v.file_list.where("NOT (doc_id%3=0 AND length(folder)=4)").groupBy(F.col("folder").alias("name"), F.expr("doc_id%3").alias("root_rank")).agg(F.count("*").alias("files"))
    return batches.folder_listing(f)


@query("store_results", """SELECT i.inspection_id, station_id, material_id, (SELECT model_version_id FROM model_version ORDER BY is_active DESC, model_version_id DESC LIMIT 1) AS model_version_id, status, region_count,
 coalesce(n,0) AS stored_regions, class_ids FROM inspection i LEFT JOIN station s ON s.station_code=i.station_code LEFT JOIN material m ON m.material_code=i.material_code
 LEFT JOIN (SELECT inspection_id, count(*) AS n, sum(CASE WHEN class_code='crack' THEN 1 ELSE 2 END)::BIGINT AS class_ids FROM defect_region GROUP BY 1) r ON r.inspection_id=i.inspection_id""")
def _(v):
    active = history.active_model(v.model_version).select("model_version_id").scalar()
    rows = exports.store_rows(v.inspection.drop("model_version_id"), v.station, v.material, active)
    classes = v.spark.createDataFrame([(1, "crack"), (2, "scratch")], "class_id BIGINT, class_code STRING")
    folder = work_path(v.spark, "store")
    half = F.col("inspection_id") % 2 == 0  # two batches, one after the other
    every = exports.region_rows(v.defect_region, classes)
    for batch, part in (("even", half), ("odd", ~half), ("even", half)):  # the first one is given again
        exports.append_results(rows.where(part), every.where(part), folder, batch)
    inspections, regions = (exports.committed(v.spark, folder, name, t.schema) for name, t in (("inspection", rows), ("defect_region", every)))
    held = regions.groupBy("inspection_id").agg(F.count("*").alias("stored_regions"), F.sum("class_id").alias("class_ids"))
    return inspections.join(held, "inspection_id", "left").select(
        "inspection_id", "station_id", "material_id", "model_version_id", "status", "region_count", F.coalesce("stored_regions", F.lit(0)).alias("stored_regions"), "class_ids")


@query("export_reconcile", f"SELECT c.csv_rows, x.expected_rows, c.csv_ids, t.processed, c.csv_rows=x.expected_rows AND c.csv_ids=t.processed AS ok FROM (SELECT count(*) AS csv_rows, count(DISTINCT i.inspection_id) AS csv_ids FROM inspection i LEFT JOIN defect_region r ON r.inspection_id=i.inspection_id) c, (SELECT {COUNTS} FROM inspection) t, (SELECT (SELECT count(*) FROM defect_region)+(SELECT count(*) FROM inspection WHERE status<>'regions_found') AS expected_rows) x")
def _(v):
    csv = v.inspection.select("inspection_id").join(v.defect_region.select("inspection_id", "region_index"), "inspection_id", "left")
    return exports.reconcile(csv, v.inspection, v.defect_region)


# --- row rules ---------------------------------------------------------------------
@query("banner_state", """WITH bd AS (SELECT inspection_id, string_agg(n||' '||class_code, ', ' ORDER BY class_code) AS text FROM (SELECT inspection_id, class_code, count(*) AS n FROM defect_region GROUP BY 1,2) GROUP BY 1)
 SELECT i.inspection_id, CASE status WHEN 'regions_found' THEN status WHEN 'clean' THEN status ELSE 'could_not_process' END AS state,
 CASE status WHEN 'regions_found' THEN region_count||' REGION'||CASE WHEN region_count=1 THEN '' ELSE 'S' END||' FOUND' WHEN 'clean' THEN 'NO DEFECTS FOUND' ELSE 'COULD NOT PROCESS' END AS headline,
 CASE status WHEN 'regions_found' THEN coalesce(text,'') WHEN 'clean' THEN 'Recorded with an empty region list' ELSE coalesce(error_code,status) END AS detail,
 CASE WHEN status NOT IN ('regions_found','clean') THEN error_message END AS reason FROM inspection i LEFT JOIN bd ON bd.inspection_id=i.inspection_id""")
def _(v):
    return store.banner(v.inspection, history.class_breakdown(v.defect_region))


@query("product_id_default", r"""SELECT doc_id, coalesce(CASE WHEN doc_id%5=0 THEN 'given-'||doc_id END, 'capture/'||coalesce(nullif(substr(regexp_replace(CASE WHEN doc_id%3=0 THEN '@@@' ELSE folder||' ('||doc_id||')' END,'[^A-Za-z0-9_-]','','g'),1,32),''), substr(sha256,1,8))) AS product_id FROM file_list""")
def _(v):
    given = F.when(F.expr("doc_id%5=0"), F.concat(F.lit("given-"), F.col("doc_id").cast("string"))).otherwise(F.lit(" "))
    name = F.when(F.expr("doc_id%3=0"), F.lit("@@@.png")).otherwise(F.concat(F.col("folder"), F.lit(" ("), F.col("doc_id").cast("string"), F.lit(").png")))
    return v.file_list.select("doc_id", store.default_product_id(given, name, F.col("sha256"), "capture").alias("product_id"))


@query("product_id_prefix", "SELECT path, 'lot7-'||doc_id AS product_id FROM file_list")
def _(v):
    return v.file_list.select("path", store.prefixed_product_id(F.col("path"), "lot7-").alias("product_id"))


@query("payload_size_gate", "SELECT doc_id, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) <= 4096")
def _(v):
    return v.documents.where(store.within_limit(F.col("text"), 4096)).select("doc_id", F.octet_length("text").cast("bigint").alias("size"))


@query("portable_path", "SELECT doc_id, CASE WHEN doc_id%3=2 THEN '/elsewhere/'||path ELSE path END AS path FROM file_list")
def _(v):
    root = F.expr("CASE doc_id%3 WHEN 0 THEN '/srv/run/' WHEN 1 THEN '/opt/bundle/' ELSE '/elsewhere/' END")
    return v.file_list.select("doc_id", store.portable_path(F.concat(root, F.col("path")), ["/srv/run", "/opt/bundle/"]).alias("path"))


@query("retention_candidates", "SELECT inspection_id, status, date_diff('day', captured_at, TIMESTAMP '1998-01-01') AS age_days FROM inspection WHERE (status='clean' AND captured_at < TIMESTAMP '1998-01-01' - INTERVAL 48 HOUR) OR (status='regions_found' AND captured_at < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY)")
def _(v):
    return store.retention_candidates(v.inspection, F.lit("1998-01-01").cast("date"))


@query("status_derive", f"SELECT inspection_id, CASE WHEN inspection_id%7=0 THEN CASE WHEN region_count>0 THEN 'regions_found' ELSE 'clean' END WHEN inspection_id%7=1 THEN 'processing_failure' ELSE status END AS status FROM inspection")
def _(v):
    raw = F.expr("CASE inspection_id%7 WHEN 0 THEN ' ' WHEN 1 THEN 'done' ELSE status END")
    return v.inspection.select("inspection_id", store.derived_status(raw, F.col("region_count")).alias("status"))


@query("processed_at_default", "SELECT inspection_id, strftime(CASE WHEN inspection_id%2=0 THEN processed_at ELSE captured_at + to_microseconds(CAST(round(coalesce(latency_ms,0)*1000) AS BIGINT)) END, '%Y-%m-%dT%H:%M:%S.%g') AS processed_at FROM inspection")
def _(v):
    recorded = F.expr("CASE WHEN inspection_id%2=0 THEN processed_at END")
    out = store.processed_at_default(recorded, F.col("captured_at"), F.col("latency_ms"))
    return v.inspection.select("inspection_id", F.date_format(out, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("processed_at"))


@query("class_channel_map", "SELECT DISTINCT item_id, class_id, CASE class_id WHEN 1 THEN 'crack' WHEN 2 THEN 'scratch' ELSE 'crack' END AS class_code FROM pixel")
def _(v):
    return v.pixel.select("item_id", "class_id").distinct().withColumn("class_code", store.class_of_channel(F.col("class_id")))


@query("model_info", """SELECT model_version_id, substr(m.artefact_sha256,1,4)||'…'||right(m.artefact_sha256,3) AS sha_short, m.file_name, m.version, coalesce(m.parameter_count, q.parameter_count) AS parameter_count, coalesce(m.latency_ms, q.latency_ms) AS latency_ms
 FROM model_version m LEFT JOIN (SELECT sha256(s_name) AS artefact_sha256, s_suppkey*7 AS parameter_count, 26.1::DOUBLE AS latency_ms FROM supplier WHERE s_suppkey%2=0) q ON q.artefact_sha256=m.artefact_sha256""")
def _(v):
    measured = v.supplier.where("s_suppkey%2=0").select(F.sha2("s_name", 256).alias("artefact_sha256"), F.lit(None).cast("string").alias("file_name"),
        F.lit(None).cast("string").alias("version"), (F.col("s_suppkey") * 7).alias("parameter_count"), F.lit(26.1).alias("latency_ms"))
    return store.model_info(v.model_version, measured)


@query("record_alias_normalise", """SELECT event_id, CASE event_id%3 WHEN 0 THEN 'crack' WHEN 1 THEN 'scratch' ELSE event_type END AS class_code, CAST(value AS VARCHAR) AS area_px, CASE WHEN event_id%3=2 THEN '9' END AS region_index FROM events""")
def _(v):
    value = F.col("value").cast("string")
    payload = F.expr("event_id%3").alias("k")
    raw = v.events.select("event_id", F.when(payload == 0, F.format_string('{"type":"crack","area":"%s"}', value))
        .when(payload == 1, F.format_string('{"class_name":"scratch","area_px":"%s"}', value))
        .otherwise(F.format_string('{"label":"%s","area":"%s","index":9}', "event_type", value)).alias("payload"))
    return store.canonical_from_json(raw, "payload", ["event_id"]).select("event_id", "class_code", "area_px", "region_index")


# --- dimensions -----------------------------------------------------------------------
@query("reference_seed", "SELECT p_type AS material_code, min(p_name) AS material_name FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1")
def _(v):
    existing = v.part.where("p_type = 'ECONOMY'").select(F.col("p_type").alias("material_code")).distinct()
    incoming = v.part.groupBy(F.col("p_type").alias("material_code")).agg(F.min("p_name").alias("material_name"))
    return store.missing_codes(existing, incoming, "material_code")


@query("get_or_create_station", "SELECT DISTINCT 'line-'||(s_suppkey%4)||'-cam'||s_nationkey AS station_code, 'line-'||(s_suppkey%4) AS line_code, NULL::DOUBLE AS mm_per_pixel, 'ok' AS camera_status FROM supplier WHERE s_suppkey%4<>0")
def _(v):
    codes = v.supplier.select("s_suppkey", F.format_string("line-%d-cam%d", F.expr("s_suppkey%4"), F.col("s_nationkey")).alias("station_code"))
    existing = codes.where("s_suppkey%4=0").select("station_code").distinct()
    return store.new_stations(existing, codes)


@query("register_model", """WITH inc AS (SELECT sha256(CASE WHEN c_custkey%2=0 THEN 'Supplier#'||lpad(CAST(c_custkey AS VARCHAR),9,'0') ELSE c_name END) AS artefact_sha256, 'new-'||c_custkey AS file_name, 'n'||c_nationkey AS version, CASE WHEN c_custkey%3=0 THEN NULL ELSE c_custkey END AS parameter_count, NULL::DOUBLE AS latency_ms, c_custkey AS registered_no FROM customer)
 SELECT coalesce(m.artefact_sha256, i.artefact_sha256) AS artefact_sha256, coalesce(i.file_name, m.file_name) AS file_name, coalesce(i.version, m.version) AS version, coalesce(i.parameter_count, m.parameter_count) AS parameter_count, m.latency_ms,
 coalesce(m.artefact_sha256, i.artefact_sha256) = (SELECT arg_max(artefact_sha256, registered_no) FROM inc) AS is_active, CASE WHEN i.artefact_sha256 IS NULL THEN 'kept' WHEN m.artefact_sha256 IS NULL THEN 'registered' ELSE 'updated' END AS action FROM model_version m FULL JOIN inc i ON i.artefact_sha256=m.artefact_sha256""")
def _(v):
    name = F.when(F.expr("c_custkey%2=0"), F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    incoming = v.customer.select(F.sha2(name, 256).alias("artefact_sha256"), F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("file_name"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("version"), F.expr("CASE WHEN c_custkey%3=0 THEN NULL ELSE c_custkey END").alias("parameter_count"),
        F.lit(None).cast("double").alias("latency_ms"), F.col("c_custkey").alias("registered_no"))
    return store.register_models(v.model_version, incoming)


# --- integrity --------------------------------------------------------------------------
@query("fk_orphans", """SELECT 'region_inspection' AS "check", (SELECT count(*) FROM defect_region r WHERE NOT EXISTS (SELECT 1 FROM inspection i WHERE i.inspection_id=r.inspection_id)) AS n
 UNION ALL SELECT 'inspection_model', (SELECT count(*) FROM inspection i WHERE NOT EXISTS (SELECT 1 FROM model_version m WHERE m.model_version_id=i.model_version_id AND m.is_active))
 UNION ALL SELECT 'inspection_profile', (SELECT count(*) FROM inspection i WHERE NOT EXISTS (SELECT 1 FROM profile p WHERE p.profile_id=i.profile_id)) UNION ALL SELECT 'inspection_batch', (SELECT count(*) FROM inspection i WHERE batch_run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM batch_run b WHERE b.batch_run_id=i.batch_run_id))""")
def _(v):
    return store.findings([
        store.finding("region_inspection", store.orphans(v.defect_region, v.inspection, {"inspection_id": "inspection_id"})),
        store.finding("inspection_model", store.orphans(v.inspection, v.model_version.where("is_active"), {"model_version_id": "model_version_id"})),
        store.finding("inspection_profile", store.orphans(v.inspection, v.profile, {"profile_id": "profile_id"})),
        store.finding("inspection_batch", store.orphans(v.inspection, v.batch_run, {"batch_run_id": "batch_run_id"})),
    ])


@query("unique_violations", """SELECT 'region_index' AS "check", (SELECT count(*) FROM (SELECT 1 FROM defect_region GROUP BY inspection_id, region_index HAVING count(*)>1)) AS n
 UNION ALL SELECT 'order_line', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1)) UNION ALL SELECT 'station_code', (SELECT count(*) FROM (SELECT 1 FROM station GROUP BY station_code HAVING count(*)>1))""")
def _(v):
    return store.findings([
        store.finding("region_index", store.duplicates(v.defect_region, ["inspection_id", "region_index"])),
        store.finding("order_line", store.duplicates(v.lineitem, ["l_orderkey", "l_linenumber"])),
        store.finding("station_code", store.duplicates(v.station, ["station_code"])),
    ])


@query("enum_violations", """SELECT 'inspection_status' AS "check", (SELECT count(*) FROM inspection WHERE status NOT IN ('regions_found','clean','acquisition_failure','processing_failure')) AS n
 UNION ALL SELECT 'event_type', (SELECT count(*) FROM events WHERE event_type NOT IN ('click','view')) UNION ALL SELECT 'support_status', (SELECT count(*) FROM material WHERE support_status NOT IN ('supported'))""")
def _(v):
    return store.findings([
        store.finding("inspection_status", store.outside(v.inspection, "status", STATUSES)),
        store.finding("event_type", store.outside(v.events, "event_type", ("click", "view"))),
        store.finding("support_status", store.outside(v.material, "support_status", ("supported",))),
    ])


@query("region_count_mismatch", "SELECT i.inspection_id, i.region_count, i.found FROM (SELECT inspection_id, CASE WHEN inspection_id%100=9 THEN region_count+1 ELSE region_count END AS region_count, region_count AS found FROM inspection) i WHERE region_count<>found")
def _(v):
    planted = v.inspection.withColumn("region_count", F.expr("CASE WHEN inspection_id%100=9 THEN region_count+1 ELSE region_count END"))
    return store.region_count_mismatch(planted, v.defect_region).select("inspection_id", "region_count", "found")


FLIP = "CASE WHEN inspection_id%500=1 THEN 'clean' WHEN inspection_id%500=2 THEN 'processing_failure' ELSE status END"


@query("failure_with_regions", f"SELECT inspection_id, s AS status FROM (SELECT *, {FLIP} AS s FROM inspection) WHERE s IN ('acquisition_failure','processing_failure') AND region_count>0")
def _(v):
    rows = v.inspection.withColumn("status", F.expr(FLIP))
    return store.with_unexpected_regions(rows, v.defect_region).select("inspection_id", "status")


@query("clean_with_regions", f"SELECT inspection_id, s AS status FROM (SELECT *, {FLIP} AS s FROM inspection) WHERE s='clean' AND region_count>0")
def _(v):
    rows = v.inspection.withColumn("status", F.expr(FLIP))
    return store.with_unexpected_regions(rows, v.defect_region, ("clean",)).select("inspection_id", "status")


@query("region_geometry_valid", "SELECT count(*) FILTER (WHERE bbox_x<0 OR bbox_y<0 OR bbox_x+bbox_width>210 OR bbox_y+bbox_height>200) AS bad_box, count(*) FILTER (WHERE area_px<=0 OR length_px<=0 OR max_width_px-1<=0) AS bad_number FROM defect_region")
def _(v):
    return store.bad_geometry(v.defect_region.withColumn("max_width_px", F.col("max_width_px") - 1), 210, 200)


@query("lock_verify", """SELECT path, abs(bytes-expected_bytes) <= greatest(4096, 0.01::DOUBLE*expected_bytes) AS size_ok, sha256=expected_sha256 AS hash_ok FROM file_list""")
def _(v):
    return store_lock(v.file_list)


def store_lock(files):
    slack = F.greatest(F.lit(4096.0), F.col("expected_bytes") * 0.01)
    return files.select("path", (F.abs(F.col("bytes") - F.col("expected_bytes")) <= slack).alias("size_ok"), (F.col("sha256") == F.col("expected_sha256")).alias("hash_ok"))


@query("hash_mismatch", "SELECT f.folder AS folder, count(*) AS n FROM file_list f WHERE lower(f.sha256)<>f.expected_sha256 GROUP BY 1")
def _(v):
    return v.file_list.where(F.lower("sha256") != F.col("expected_sha256")).groupBy("folder").agg(F.count("*").alias("n"))


ACTIVE_SQL = "a AS (SELECT model_version_id, file_name, artefact_sha256, sha256(s_name||chr(10)) AS actual FROM model_version JOIN supplier ON s_suppkey=model_version_id ORDER BY is_active DESC, model_version_id DESC LIMIT 1)"


@query("model_file_state", f"""WITH {ACTIVE_SQL} SELECT 'stored' AS check_name, model_version_id, file_name, artefact_sha256 AS expected, actual, CASE WHEN artefact_sha256=actual THEN 'verified' ELSE 'mismatch' END AS state FROM a
 UNION ALL SELECT 'configured', model_version_id, file_name, actual, actual, 'verified' FROM a UNION ALL SELECT 'absent', model_version_id, file_name, artefact_sha256, NULL, 'missing' FROM a""")
def _(v):
    active, folder = history.active_model(v.model_version), work_path(v.spark, "models")
    content = v.supplier.join(active.select(F.col("model_version_id").alias("s_suppkey"), "file_name"), "s_suppkey")
    name = active.first()["file_name"]
    content.select("s_name").coalesce(1).write.text(f"{folder}/{name}")
    written = files.file_digest(v.spark, f"{folder}/{name}").first()["sha256"]
    checks = {"stored": store.model_state(active, folder), "configured": store.model_state(active, folder, written.upper()), "absent": store.model_state(active, f"{folder}/elsewhere")}
    parts = [found.select(F.lit(check).alias("check_name"), "*") for check, found in checks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CHECKS_SQL = "SELECT n.n_name AS station_code, e.event_type AS label, CASE WHEN max(value)>40 AND user_id%3=0 THEN 'failed' WHEN avg(value)>11 THEN 'warning' ELSE 'ok' END AS state FROM events e JOIN nation n ON n.n_nationkey=e.user_id%25 GROUP BY 1,2,user_id%3"


@query("health_rollup", f"SELECT station_code, CASE max(CASE state WHEN 'failed' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'warning' ELSE 'ok' END AS overall, coalesce(string_agg(DISTINCT CASE WHEN state='failed' THEN label END, ',' ORDER BY CASE WHEN state='failed' THEN label END),'') AS failing, coalesce(string_agg(DISTINCT CASE WHEN state='warning' THEN label END, ',' ORDER BY CASE WHEN state='warning' THEN label END),'') AS degraded, count(*) FILTER (WHERE state='failed')>0 AS blocks_inspection FROM ({CHECKS_SQL}) GROUP BY 1")
def _(v):
    third, state = F.expr("user_id%3"), F.expr("CASE WHEN hi>40 AND third=0 THEN 'failed' WHEN mean>11 THEN 'warning' ELSE 'ok' END")
    per = v.events.withColumn("n_nationkey", F.expr("user_id%25")).groupBy("n_nationkey", F.col("event_type").alias("label"), third.alias("third")).agg(F.max("value").alias("hi"), F.avg("value").alias("mean"))
    checks = per.join(v.nation, "n_nationkey").select(F.col("n_name").alias("station_code"), "label", state.alias("state"))
    return store.health_rollup(checks)


@query("thresholds_in_sync", "SELECT profile_id, crack_threshold=0.30::DOUBLE AND scratch_threshold=0.20::DOUBLE AND minimum_area_px=24 AND minimum_skeleton_px=6 AS in_sync FROM profile")
def _(v):
    return store.thresholds_in_sync(v.profile, {"crack_threshold": 0.30, "scratch_threshold": 0.20, "minimum_area_px": 24, "minimum_skeleton_px": 6})


@query("mm_from_px", "SELECT r.inspection_id, region_index, round(length_px*mm_per_pixel,9) AS length_mm FROM defect_region r JOIN inspection i ON i.inspection_id=r.inspection_id LEFT JOIN station s ON s.station_code=i.station_code")
def _(v):
    items = v.inspection.select("inspection_id", "station_code").join(v.station.select("station_code", "mm_per_pixel"), "station_code", "left")
    return v.defect_region.join(items, "inspection_id").select("inspection_id", "region_index", F.round(F.col("length_px") * F.col("mm_per_pixel"), 9).alias("length_mm"))

