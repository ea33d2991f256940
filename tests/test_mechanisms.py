"""Appends that happen once, files as a source, payloads, packed rows, draws and gates on small tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fettle.operators import batches, corpus, exports, gates, history, metrics, sampling, store
from fettle.operators.split import SplitRules
from fettle.plans import catalog
from fettle.sources import buckets
from fettle.sources.views import Views

ROWS, REGIONS = "inspection_id BIGINT, status STRING", "inspection_id BIGINT, region_index INT"


def stored(spark, folder):
    return tuple(sorted(map(tuple, exports.committed(spark, folder, n, s).collect())) for n, s in (("inspection", ROWS), ("defect_region", REGIONS)))


def test_a_batch_is_there_once_or_not_at_all(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    rows = {b: spark.createDataFrame([(k, b) for k in ids], ROWS) for b, ids in (("one", (1, 2)), ("two", (3,)))}
    regions = {b: spark.createDataFrame([(k, r) for k in ids for r in (1, 2)], REGIONS) for b, ids in (("one", (1,)), ("two", (3,)))}
    assert stored(spark, folder) == ([], [])
    assert exports.append_results(rows["one"], regions["one"], folder, "one")
    once = stored(spark, folder)
    assert once == ([(1, "one"), (2, "one")], [(1, 1), (1, 2)])
    assert not exports.append_results(rows["one"], regions["one"], folder, "one") and stored(spark, folder) == once

    class Killed(RuntimeError):
        pass

    def dies(self, path, *a, save=type(rows["two"].write).save, **k):
        if path.endswith("/inspection"):
            raise Killed
        return save(self, path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(type(rows["two"].write), "save", dies)
        with pytest.raises(Killed):
            exports.append_results(rows["two"], regions["two"], folder, "two")
    assert (tmp_path / "defect_region" / "batch=two").exists() and stored(spark, folder) == once
    assert exports.append_results(rows["two"], regions["two"], folder, "two")
    assert stored(spark, folder) == ([*once[0], (3, "two")], [*once[1], (3, 1), (3, 2)])


def test_logs_as_json_are_appended_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "path STRING, n BIGINT")
    for batch in ("x", "y", "x"):
        exports.append_once({"audit": df}, str(tmp_path), batch, "json")
    assert sorted(map(str, exports.committed(spark, str(tmp_path), "audit", df.schema, "json").collect())) == sorted(map(str, df.collect() * 2))


def test_files_of_a_folder_and_their_digest(spark, tmp_path):
    for name, content in (("a.PNG", b"1"), ("b.txt", b"22"), ("deep/c.jpg", b"333")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in batches.list_folder(spark, str(tmp_path)).collect()) == [("a.PNG", 1), ("c.jpg", 3)]
    sha = hashlib.sha256(b"22").hexdigest()
    model = lambda digest: spark.createDataFrame([(7, "b.txt", digest)], "model_version_id BIGINT, file_name STRING, artefact_sha256 STRING")
    state = lambda *a: store.model_state(*a).first()["state"]
    assert state(model(sha), str(tmp_path)) == "verified" and state(model("0" * 64), str(tmp_path)) == "mismatch"
    assert state(model("0" * 64), str(tmp_path), f" {sha.upper()} ") == "verified" and state(model(None), str(tmp_path)) == "verified"
    assert state(model(sha), f"{tmp_path}/nowhere") == "missing"
    assert store.model_state(model(sha).where("false"), str(tmp_path)).collect() == []


def test_payloads_with_other_keys_or_no_json(spark):
    rows = [(1, '{"type":"crack","area":3}'), (2, '{"class_name":"scratch","area_px":"4.5","index":null}'), (3, "{"), (4, None), (5, "[1]")]
    got = {r["id"]: (r["class_code"], r["area_px"]) for r in store.canonical_from_json(spark.createDataFrame(rows, "id INT, payload STRING"), "payload", ["id"]).collect()}
    assert got == {1: ("crack", "3"), 2: ("scratch", "4.5"), 3: (None, None), 4: (None, None), 5: (None, None)}


@pytest.mark.parametrize("tol", [0, 1, 2, 5])
def test_packed_rows_equal_pixel_distances(spark, tol):
    rng = random.Random(tol)
    pixels = [(i, y, x, int(rng.random() < 0.02), int(rng.random() < 0.02)) for i in (1, 2) for y in range(-3, 40) for x in range(-5, 140)]
    df = spark.createDataFrame(pixels, "item_id INT, y INT, x INT, gt INT, pred INT")
    gt, pred = ({(i, y, x) for i, y, x, g, p in pixels if (g, p)[k]} for k in (0, 1))
    near = lambda other, i, y, x: any((i, y + dy, x + dx) in other for dy, dx in metrics.ellipse(tol))
    want = {(i, y, x): ((i, y, x) in pred, (i, y, x) in gt, near(pred, i, y, x), near(gt, i, y, x)) for i, y, x in gt | pred}
    got = {(r["item_id"], r["y"], r["x"]): (r["is_pred"], r["is_gt"], r["pred_near"], r["gt_near"]) for r in metrics.near_flags(df, tol).collect()}
    assert got == want
    counts = {r["item_id"]: (r["near_pred"], r["near_gt"]) for r in metrics.near_counts(df, tol).collect()}
    assert counts == {i: (sum(v[0] and v[3] for k, v in want.items() if k[0] == i), sum(v[1] and v[2] for k, v in want.items() if k[0] == i)) for i in (1, 2)}
    assert metrics.near_flags(df.limit(0), tol).collect() == []


def test_every_group_is_drawn_alike(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.when(F.col("id") < 20_000, F.lit(0)).otherwise(F.col("id") % 500).cast("string").alias("grp"))
    slots = spark.range(20_000).withColumnRenamed("id", "slot")
    drawn = sampling.group_balanced(slots, rows, "grp", "name", 7)
    counts = [r["count"] for r in drawn.groupBy("grp").count().collect()]
    assert sum(counts) == 20_000 and len(counts) == 500 and max(counts) < 100


def test_row_gates_are_counted_while_writing(spark):
    rules = SplitRules(unseen_material="wood", factory_materials=("steel",))
    rows = [("a", "g1", "h1", "train", "positive", "wood", "s", 3), ("a", "g1", "h2", "test_factory", "positive", "oak", "s", 3), ("b", "g2", "h3", "nowhere", "scratch", None, "s", 0)]
    df = spark.createDataFrame(rows, "name STRING, grp STRING, phash STRING, split STRING, role STRING, material STRING, subsource STRING, crack_px INT")
    got = {r["gate"]: r["n"] for r in gates.gate_report(df, rules).collect()}
    assert (got["unseen_in_train"], got["headline_foreign"], got["unknown_split"], got["leak_group"], got["leak_hash"], got["dup_names"]) == (1, 1, 1, 1, 0, 1)
    assert got["positive_in_train"] == 0 and got["scratch_in_train"] == 1


def test_deep_pages_equal_shallow_ones(spark):
    rows = spark.range(500).selectExpr("id AS inspection_id", "TIMESTAMP_NTZ'2026-01-01' + make_dt_interval(0, 0, 0, id % 37) AS captured_at")
    f = history.HistoryFilter(page=7, page_size=30)
    assert history.page(rows, f, shallow=0).collect() == history.page(rows, f).collect()


def test_rows_without_a_hash_stay_and_are_counted(spark):
    rows = [("a", "h", 1, "steel", "positive", 3), ("b", "h", 0, "wood", "positive", 3), ("c", "", 2, "wood", "negative", 0), ("c", "", 3, None, None, None), ("d", None, 4, "wood", "positive", None)]
    df = spark.createDataFrame(rows, "name STRING, phash STRING, doc_id INT, material STRING, role STRING, crack_px INT")
    assert sorted(r["doc_id"] for r in corpus.keep_first(df, "doc_id").collect()) == [0, 2, 3, 4]
    got = {(r["section"], r["key"]): r["n"] for r in corpus.kept_report(df, "doc_id").collect()}
    assert got == {("rows", "input"): 5, ("rows", "kept"): 4, ("positives", "wood"): 1, ("roles", "positive"): 2, ("roles", "negative"): 1, ("roles", None): 1}


def test_a_bucketed_store_is_joined_without_moving_the_fact(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        inspections = spark.range(2_000).selectExpr(
            "id AS inspection_id", "concat('p', id) AS product_id", "CASE WHEN id % 3 = 0 THEN 'regions_found' ELSE 'clean' END AS status", "id % 5 AS batch_run_id", "1.0D AS latency_ms")
        regions = spark.range(3_000).selectExpr(
            "id % 2001 AS inspection_id", "CAST(id % 4 AS INT) AS region_index", "'crack' AS class_code", "1 AS area_px", "1.0D AS length_px", "1.0D AS max_width_px", "1 AS bbox_x", "1 AS bbox_y",
            "1 AS bbox_width", "1 AS bbox_height", "1.0D AS centroid_x", "1.0D AS centroid_y").where("inspection_id % 3 = 0")
        stored = buckets.write_store(inspections, regions, "bucket_test", 8)
        told = lambda i, r: {
            "array": i.join(exports.region_array(r), "inspection_id", "left").select("inspection_id", "regions"), "breakdown": history.class_breakdown(r), "envelope": exports.envelope(i, r, history.HistoryFilter()),
            "totals": batches.run_totals(i, r)}
        for name, df in told(*stored).items():
            assert "hashpartitioning(inspection_id" not in df._jdf.queryExecution().executedPlan().toString(), name
            assert sorted(map(str, df.collect())) == sorted(map(str, told(inspections, regions)[name].collect())), name
    finally:
        buckets.drop_store(spark, "bucket_test")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["history_rows", "region_csv_rows", "inspection_json"])
def test_dimensions_of_few_keys_do_not_move_the_fact(spark, name):
    """A shuffle by material or profile would put all inspections into as many tasks as there are materials or profiles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if re.search(r"Join \[(material_code|station_code|model_version_id|profile_id)#.*LeftOuter", line)]
    assert len(joins) == 4 and all("BroadcastHashJoin" in line for line in joins)


def test_regions_are_dealt_once_by_their_inspection(spark):
    """The window that numbers regions deals them by inspection; packing and joining them must not deal them again."""
    v = Views(spark, "/root/testdata/sf0.001")
    plan = exports.records_of(v.inspection, v.defect_region)._jdf.queryExecution().executedPlan().toString()
    window = next(n for n, line in enumerate(plan.splitlines()) if "- Window [" in line)
    packed = next(n for n, line in enumerate(plan.splitlines()) if "ObjectHashAggregate(keys=[inspection_id" in line)
    assert packed < window and not any("Exchange" in line for line in plan.splitlines()[packed:window])


def test_text_logs_are_packed(spark, tmp_path):
    rows = spark.range(50).select(F.repeat(F.lit("record "), 40).alias("text"))
    assert exports.append_once({"log": rows}, str(tmp_path), "one", "json")
    files = [f for f in tmp_path.glob("log/*/*/part-*") if f.stat().st_size]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert exports.committed(spark, str(tmp_path), "log", "text STRING", "json").collect() == rows.collect()


def test_results_are_not_dealt_by_their_material(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = Views(spark, "/root/testdata/sf0.001")
        plan = exports.store_rows(v.inspection.drop("model_version_id"), v.station, v.material, F.lit(1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if re.search(r"Join \[(material_code|station_code)#.*LeftOuter", line)]
    assert len(joins) == 2 and all("BroadcastHashJoin" in line for line in joins)
