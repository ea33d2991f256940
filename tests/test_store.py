"""History, totals and exports on a small store with known contents."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fettle.operators import batches, exports, history, store
from fettle.operators.history import HistoryFilter, parse_filter

DAY = dt.datetime(2026, 8, 12)
ROWS = [
    # id, product, captured, material, station, run, latency, regions, status
    (1, "lot7/a-01", DAY, "steel", "line-1-cam-A", 1, 20.0, 2, "regions_found"),
    (2, "lot7/a-02", DAY + dt.timedelta(hours=23, minutes=59), "steel", "line-1-cam-B", 1, 30.0, 0, "clean"),
    (3, "lot8/b-01", DAY + dt.timedelta(days=1), "ceramic", "line-1-cam-A", 1, None, 0, "acquisition_failure"),
    (4, "lot8/B-02", DAY - dt.timedelta(days=2), None, "line-2-cam-A", 2, 50.0, 1, "regions_found"),
    (5, "x", DAY, "steel", "line-1-cam-A", None, 10.0, 0, "processing_failure"),
]
REGIONS = [(1, 1, "crack", 40, 10.5), (1, 2, "scratch", 30, 4.0), (4, 1, "crack", 25, 7.0)]


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(
        ROWS, "inspection_id BIGINT, product_id STRING, captured_at TIMESTAMP_NTZ, material_code STRING, station_code STRING,"
              " batch_run_id BIGINT, latency_ms DOUBLE, region_count BIGINT, status STRING")
    return df.withColumns({
        "processed_at": F.col("captured_at"), "image_sha256": F.sha2("product_id", 256), "model_version_id": F.lit(1), "profile_id": F.lit(1),
        "error_code": F.when(F.col("status") == "acquisition_failure", "DECODE_FAILED"), "error_message": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def regions(spark):
    df = spark.createDataFrame(REGIONS, "inspection_id BIGINT, region_index INT, class_code STRING, area_px INT, length_px DOUBLE")
    more = {c: F.lit(1) for c in ("bbox_x", "bbox_y", "bbox_width", "bbox_height")}
    return df.withColumns({**more, "max_width_px": F.lit(2.0), "centroid_x": F.lit(1.5), "centroid_y": F.lit(1.5)})


def ids(df):
    return sorted(r["inspection_id"] for r in df.collect())


@pytest.mark.parametrize("params, want", [
    ({"date_from": "2026-08-12", "date_to": "2026-08-12"}, [1, 2, 5]),
    ({"date_to": "2026-08-12T00:00:00"}, [1, 4, 5]),
    ({"material": "steel", "station": "line-1-cam-A"}, [1, 5]),
    ({"status": "clean"}, [2]),
    ({"status": "nonsense"}, [1, 2, 3, 4, 5]),
    ({"product_id": "LOT8"}, [3, 4]),
    ({"product_id": "lot*-01"}, [1, 3]),
    ({"product_id": "b-0"}, [3, 4]),
    ({"class": "scratch"}, [1]),
    ({"class": "crack", "status": "regions_found", "material": "  "}, [1, 4]),
])
def test_filters(items, regions, params, want):
    assert ids(history.matching(items, regions, parse_filter(params))) == want


def test_page_size_is_clamped():
    f = parse_filter({"page": "0", "page_size": "100000"})
    assert (f.page, f.page_size) == (1, 200)
    assert parse_filter({"page_size": "1"}).page_size == 5
    assert parse_filter({"page_size": "many"}).page_size == 25


def test_pages_cover_every_row_once(items):
    seen = []
    for page in (1, 2, 3):
        seen += [r["inspection_id"] for r in history.page(items, HistoryFilter(page=page, page_size=2)).collect()]
    assert seen == [3, 2, 5, 1, 4]
    first = history.page(items, HistoryFilter(page=1, page_size=2)).collect()[-1]
    after = history.page_after(items, first["captured_at"].isoformat(), first["inspection_id"], 2)
    assert [r["inspection_id"] for r in after.collect()] == [5, 1]


def test_totals_are_zero_filled(items, regions):
    none = history.status_totals(items.where("false")).first().asDict()
    assert set(none.values()) == {0}
    t = {r["batch_run_id"]: r.asDict() for r in batches.run_totals(items, regions).collect()}
    assert t[1]["processed"] == 3 and t[1]["failed"] == 1 and t[1]["regions_total"] == 2
    assert t[1]["regions_pct"] == 33.3 and t[2]["clean_pct"] == 0.0 and t[2]["crack_regions"] == 1


def test_run_without_rows_reports_zeros(spark, items, regions):
    runs = spark.createDataFrame([(1,), (9,)], "batch_run_id BIGINT")
    t = {r["batch_run_id"]: r for r in batches.totals_for_runs(runs, batches.run_totals(items, regions)).collect()}
    assert t[9]["processed"] == 0 and t[9]["clean_pct"] == 0.0


def test_export_reconciles_and_clean_items_keep_a_row(items, regions):
    flat = items.select("inspection_id").join(regions.select("inspection_id", "region_index"), "inspection_id", "left")
    r = exports.reconcile(flat, items, regions).first()
    assert r["ok"] and r["csv_rows"] == 6 and r["csv_ids"] == 5
    broken = exports.reconcile(flat.where("inspection_id <> 2"), items, regions).first()
    assert not broken["ok"]


def test_record_rows(items, regions):
    rows = exports.record_rows(exports.records_of(items, regions)).collect()
    kinds = sorted((r["product_id"], r["type"], r["bbox_xywh"]) for r in rows)
    assert ("lot7/a-02", "none", "") in kinds and ("lot7/a-01", "crack", "[1, 1, 1, 1]") in kinds and len(rows) == 6


def test_failure_is_never_clean(items):
    out = {r["path"]: r for r in exports.audit_rows(items).collect()}
    assert out["lot8/b-01"]["status"] == "acquisition_failure" and out["lot8/b-01"]["n_regions"] is None
    got = items.select(store.derived_status(F.lit("weird"), F.lit(0)).alias("s")).first()["s"]
    assert got == "processing_failure"


def test_banner(items, regions):
    b = {r["inspection_id"]: r for r in store.banner(items, history.class_breakdown(regions)).collect()}
    assert b[1]["headline"] == "2 REGIONS FOUND" and b[1]["detail"] == "1 crack, 1 scratch"
    assert b[4]["headline"] == "1 REGION FOUND" and b[3]["detail"] == "DECODE_FAILED" and b[5]["detail"] == "processing_failure"


def test_nested_export_has_explicit_empty_list(spark, items, regions):
    wide = items.withColumns({c: F.lit(None).cast("string") for c in ("model_version", "model_file_name", "artefact_sha256", "profile_version",
                              "crack_threshold", "scratch_threshold", "minimum_area_px", "minimum_skeleton_px")})
    docs = {r["inspection_id"]: json.loads(r["json"]) for r in exports.as_json(exports.nested(wide, regions)).collect()}
    assert docs[2]["regions"] == [] and docs[1]["regions"][1]["class_code"] == "scratch" and docs[1]["model"]["version"] is None


def test_latest_is_by_id_not_by_time(items):
    assert history.latest_or_any(items, "line-1-cam-A").first()["inspection_id"] == 5
    assert history.latest_or_any(items, "nowhere").first()["inspection_id"] == 5
    assert history.newest_with_regions(items, "line-1-cam-A").first()["inspection_id"] == 1


def test_product_id_default(spark):
    rows = spark.createDataFrame([(" p1 ", "a.png"), ("", "dir/mein bild (2).tar.png"), (None, "@@@.png"), (None, None)], "given STRING, file STRING")
    out = [r[0] for r in rows.select(store.default_product_id(F.col("given"), F.col("file"), F.lit("0123456789"), "capture")).collect()]
    assert out == ["p1", "capture/meinbild2tar", "capture/01234567", "capture/01234567"]


def test_candidate_files(spark):
    files = spark.createDataFrame([("/b/a.PNG", 10), ("/b/c.txt", 10), ("/b/d.tiff", 64 * 1024 * 1024), ("/b/e.jpg", 64 * 1024 * 1024 + 1)], "path STRING, length BIGINT")
    assert sorted(r["path"] for r in batches.candidate_files(files).collect()) == ["/b/a.PNG", "/b/d.tiff"]


def test_folder_files_are_listed_without_contents(spark, tmp_path):
    (tmp_path / "lot").mkdir()
    (tmp_path / "lot" / "a.png").write_bytes(b"12345")
    (tmp_path / "lot" / "notes.md").write_text("x")
    got = batches.list_folder(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["length"]) for r in got] == [("a.png", 5)]


def test_model_upsert_keeps_known_values(spark):
    cols = "model_version_id BIGINT, file_name STRING, version STRING, artefact_sha256 STRING, parameter_count BIGINT, latency_ms DOUBLE, is_active BOOLEAN"
    stored = spark.createDataFrame([(1, "a", "v1", "s1", 10, 5.0, True), (2, "b", "v2", "s2", 20, 6.0, False)], cols)
    new = spark.createDataFrame([("s2", "b2", "v3", None, 7.0, 1), ("s3", "c", "v1", 30, None, 2)],
                                "artefact_sha256 STRING, file_name STRING, version STRING, parameter_count BIGINT, latency_ms DOUBLE, registered_no INT")
    out = {r["artefact_sha256"]: r for r in store.register_models(stored, new).collect()}
    assert out["s2"]["parameter_count"] == 20 and out["s2"]["latency_ms"] == 7.0 and out["s2"]["action"] == "updated"
    assert [k for k, r in out.items() if r["is_active"]] == ["s3"]
    assert out["s1"]["action"] == "kept"


def test_portable_path(spark):
    rows = spark.createDataFrame([("/srv/run/a/b.png",), ("/srv/runner/b.png",), ("/opt/x.png",)], "p STRING")
    assert [r[0] for r in rows.select(store.portable_path(F.col("p"), ["/srv/run", "/opt/"])).collect()] == ["a/b.png", "/srv/runner/b.png", "x.png"]


def test_tables_are_found_and_not_listed_in_the_code(spark, tmp_path):
    from fettle.operators import gates
    from fettle.sources.views import Views

    spark.range(1).write.parquet(str(tmp_path / "region.parquet"))
    v = Views(spark, str(tmp_path))
    assert v.found(["region", "orders", "inspection"]) == ["region"]
    assert [r.table_name for r in gates.missing_tables(spark, v.found(["region", "inspection"]), ["region", "inspection"]).collect()] == ["inspection"]
