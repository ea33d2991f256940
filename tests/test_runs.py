"""Run records and summaries on small tables with known contents."""

from __future__ import annotations

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fettle.operators import runs
from fettle.operators.ranking import running
from fettle.sources import files

SCHEMA = "run STRING, tag STRING, args STRUCT<seed: BIGINT>, score DOUBLE"


def test_records_of_one_line_and_of_many(spark, tmp_path):
    record = {"run": "R1_4", "tag": "R1", "args": {"seed": 4}, "score": 0.5}
    (tmp_path / "flat.json").write_text(json.dumps(record))
    (tmp_path / "indented.json").write_text("\n " + json.dumps(record | {"run": "R1_5"}, indent=2) + "\n")
    (tmp_path / "report.json").write_text(json.dumps({"run": "R1_6", "tag": "R1"}))
    (tmp_path / "list.json").write_text(json.dumps([record], indent=2))
    (tmp_path / "broken.json").write_text(json.dumps(record, indent=2)[:30])
    (tmp_path / "empty.json").write_text("")
    runs = files.read_runs(spark, str(tmp_path), SCHEMA)
    assert sorted(r["run"] for r in runs.collect()) == ["R1_4", "R1_5", "R1_6"]
    assert sorted(r["run"] for r in files.find_run(runs, "R1").collect()) == ["R1_4", "R1_5"]
    points = spark.createDataFrame([("R1_4",), ("R1_7",)], "run STRING")
    assert [r["run"] for r in files.rescued_runs(points, runs).collect()] == ["R1_7"]


def test_prefix_sums_over_cells(spark):
    rows = [(k, f"g{k % 3 if k < 2_000 else 9}", k * 7919 % 1000, k % 5) for k in range(6_000)]
    df = spark.createDataFrame(rows, "id INT, g STRING, x INT, m INT")
    got = running(df, ["g"], [F.col("x").desc(), F.col("id").asc()], {"before": "m"}, "n").collect()
    sums, count, want = Counter(), Counter(), {}
    for i, g, _, m in sorted(rows, key=lambda r: (-r[2], r[0])):
        count[g] += 1
        want[i] = (sums[g], count[g])
        sums[g] += m
    assert {r["id"]: (r["before"], r["n"]) for r in got} == want
    assert running(df.limit(0), [], [F.col("id").asc()], {"before": "m"}, "n").collect() == []


def test_budgeted_take_on_many_shards(spark):
    n = 200_000
    df = spark.range(n).selectExpr("id AS shard", "(id * 7919) % 1009 AS hits", "1.0D AS gb")
    got = runs.budgeted_take(df, 1e6, 1.0, 100_000.0, 40_000.0)
    order = sorted(range(n), key=lambda i: (-((i * 7919) % 1009), i))[:60_000]
    assert [r["shard"] for r in got.orderBy("rank").collect()] == order
    assert runs.budgeted_take(df, 0.5, 1.0, 1e6, 0.0).collect() == []
    assert runs.budgeted_take(df.where("shard < 100"), 1e6, 1.0, 1e6, 0.0).count() == 100


def test_scores_of_records_by_split_and_metric(spark):
    full = {"tag": "C3B", "args": {"seed": 4}, "model": "m", "cost": {"params": 3}, "history": [1, 2],
            "test_seen": {"cldice": 0.5, "iou": None, "crack_class_recall": 0.25, "note": "n"}, "test_factory": {"cldice": float("nan")}}
    texts = [json.dumps(full, indent=1), json.dumps([full]), "{", json.dumps({"tag": "C4"})]
    got = {(r["tag"], r["seed"], r["split"], r["metric"]): r["score"] for r in runs.run_scores(spark.createDataFrame([(t,) for t in texts], "value STRING")).collect()}
    seen = {k[3]: v for k, v in got.items() if k[2] == "test_seen"}
    assert seen == {"cldice": 0.5, "iou": None, "crack_class_recall": 0.25, "note": None}
    assert math.isnan(got["C3B", 4, "test_factory", "cldice"]) and got["C3B", 4, "cost", "params"] == 3.0 and {k[0] for k in got} == {"C3B"}
    recalls = runs.class_recalls(runs.run_scores(spark.createDataFrame([(texts[0],)], "value STRING"))).collect()
    assert [(r["split"], r["class_code"], r["score"]) for r in recalls] == [("test_seen", "crack", 0.25)]


def test_targets_hold_for_their_metric_and_split(spark):
    rows = [("A", s, "factory", m, x) for s in (1, 2, 3) for m, x in (("detect", 0.7 + s / 20), ("area", 0.004), ("other", float("nan")))]
    df = spark.createDataFrame(rows, "tag STRING, seed BIGINT, split STRING, metric STRING, score DOUBLE")
    goals = spark.createDataFrame([("factory", "detect", 0.9, "ge"), ("factory", "area", 0.005, "le")], "split STRING, metric STRING, target DOUBLE, direction STRING")
    got = {r["metric"]: (r["verdict"], r["n"], r["per_seed"]) for r in runs.with_targets(df, goals).collect()}
    assert got == {"detect": ("MISSES", 3, "0.750000,0.800000,0.850000"), "area": ("MEETS", 3, "0.004000,0.004000,0.004000")}


@pytest.mark.parametrize("decay", [0.0, 1e-30, 0.3, 0.9, 0.9999, 1.0])
def test_running_average_equals_the_loop(spark, decay):
    rows = [("T", k % 2, "s", k, float((k * 7919) % 100) - 20) for k in range(3_000)] + [("T", 0, "s", 9_000, None)]
    got = runs.ema_series(spark.createDataFrame(rows, "tag STRING, seed INT, split STRING, epoch INT, metric DOUBLE"), decay).collect()
    want, e = {}, {}
    for _, seed, _, epoch, x in rows[:-1]:
        e[seed] = x if seed not in e else decay * e[seed] + (1 - decay) * x
        want[seed, epoch] = e[seed]
    assert len(got) == len(want)
    for r in got:
        assert r["ema"] == pytest.approx(want[r["seed"], r["epoch"]], abs=2e-9)
