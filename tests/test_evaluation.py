"""Metrics, decisions, regions and run selection on hand-made inputs."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fettle import session
from fettle.operators import decide, geometry, metrics, runs, sampling

PIXEL = "item_id INT, y INT, x INT, gt INT, pred INT, skel_gt INT, skel_pred INT"


def pixels(spark, *masks):
    rows = []
    for item, (gt, pred) in enumerate(masks):
        for (y, x), g in np.ndenumerate(gt):
            rows.append((item, y, x, int(g), int(pred[y, x]), int(g), int(pred[y, x])))
    return spark.createDataFrame(rows, PIXEL)


def grid(*cells, size=8):
    m = np.zeros((size, size), int)
    for y, x in cells:
        m[y, x] = 1
    return m


LINE = [(3, x) for x in range(8)]


def test_ellipse_shape():
    assert len(metrics.ellipse(2)) == 17 and len(metrics.ellipse(1)) == 5 and metrics.ellipse(0) == [(0, 0)]


def test_metrics_of_known_masks(spark):
    shifted = [(4, x) for x in range(8)]
    p = pixels(spark, (grid(*LINE), grid(*LINE)), (grid(*LINE), grid(*shifted)), (grid(*LINE), grid()), (grid(), grid()), (grid(), grid((0, 0))))
    m = {r["item_id"]: r for r in metrics.item_metrics(p).collect()}
    assert m[0]["iou"] == 1.0 and m[0]["dice"] == 1.0 and abs(m[0]["cldice"] - 1) < 1e-6
    assert m[1]["iou"] == 0.0 and m[1]["cldice"] == 0.0 and abs(m[1]["tf1"] - 1) < 1e-6
    assert m[2]["tf1"] == 0.0 and m[2]["cldice"] == 0.0
    assert m[3]["tf1"] == 1.0 and m[3]["cldice"] == 1.0 and m[4]["cldice"] == 0.0
    e = metrics.evaluate(metrics.item_metrics(p)).first()
    assert (e["n_pos"], e["n_neg"]) == (3, 2) and e["detect_rate"] == round(1 / 3, 6)
    assert abs(e["fp_area"] - 1 / 128) < 1e-6 and e["fp_image_rate"] == 0.5


def test_tolerant_f1_against_brute_force(spark):
    rng = random.Random(5)
    gt, pred = (np.array([[int(rng.random() < 0.15) for _ in range(12)] for _ in range(12)]) for _ in range(2))
    got = metrics.near_counts(pixels(spark, (gt, pred)), 2).first()
    def near(a, b):
        return sum(any(0 <= y + dy < 12 and 0 <= x + dx < 12 and b[y + dy, x + dx] for dy, dx in metrics.ellipse(2)) for y, x in zip(*np.nonzero(a)))
    assert (got["near_pred"], got["near_gt"]) == (near(pred, gt), near(gt, pred))


def test_predicting_nothing_scores_high_accuracy_and_no_detection(spark):
    p = metrics.predict_nothing(pixels(spark, (grid(*LINE), grid(*LINE))))
    e = metrics.evaluate(metrics.item_metrics(p)).first()
    assert e["detect_rate"] == 0 and e["cldice"] == 0


def test_class_confusion_ignores_background(spark):
    p = pixels(spark, (grid((0, 0), (0, 1)), grid((0, 0), (5, 5))))
    c = metrics.class_confusion(p).collect()
    assert [tuple(r) for r in c] == [(1, 1, 1, 0)]
    assert metrics.class_recall(metrics.class_confusion(p)).first()["recall"] == 0.5


def test_softmax_matches_numpy(spark):
    scores = [1.0, 3.0, 2.0]
    row = spark.createDataFrame([(scores,)], "s ARRAY<DOUBLE>").select(decide.softmax(F.col("s")).alias("p"), decide.argmax(F.col("s")).alias("a")).first()
    e = np.exp(np.array(scores) - 3)
    assert np.allclose(row["p"], e / e.sum()) and row["a"] == 1


@pytest.mark.parametrize("prob, want", [([0.2, 0.5, 0.4], 1), ([0.2, 0.4, 0.5], 2), ([0.5, 0.31, 0.1], 1), ([0.7, 0.2, 0.25], 2), ([0.9, 0.1, 0.1], 0), ([0.0, 0.4, 0.4], 1)])
def test_floor_decision(spark, prob, want):
    df = spark.createDataFrame([(prob,)], "p ARRAY<DOUBLE>")
    assert df.select(decide.floor_decision(F.col("p"), F.lit(0.3), F.lit(0.2)).alias("d")).first()["d"] == want


def components(mask):
    seen, out = set(), {}
    cells = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}
    for start in sorted(cells):
        if start in seen:
            continue
        stack, found = [start], []
        seen.add(start)
        while stack:
            y, x = stack.pop()
            found.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (y + dy, x + dx)
                    if n in cells and n not in seen:
                        seen.add(n)
                        stack.append(n)
        for c in found:
            out[c] = frozenset(found)
    return out


def spiral(n=17):
    m = np.zeros((n, n), int)
    y = x = d = 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    m[0, 0] = 1
    for length in [n - 1, n - 1, n - 1] + [k for k in range(n - 3, 0, -2) for _ in (0, 1)]:
        for _ in range(length):
            y, x = y + steps[d % 4][0], x + steps[d % 4][1]
            m[y, x] = 1
        d += 1
    return m


def test_components_of_noise_and_of_a_spiral(spark):
    rng = random.Random(9)
    noise = np.array([[int(rng.random() < 0.35) for _ in range(17)] for _ in range(17)])
    masks = [noise, spiral()]
    rows = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    got = geometry.label_regions(spark.createDataFrame(rows, "item_id INT, y INT, x INT"), ["item_id"]).collect()
    for i, m in enumerate(masks):
        want = components(m)
        groups = {}
        for r in got:
            if r["item_id"] == i:
                groups.setdefault(r["region"], set()).add((r["y"], r["x"]))
        assert {frozenset(g) for g in groups.values()} == set(want.values())


def test_components_are_joined_without_broadcasts(spark, monkeypatch):
    """Files of runs and roots are tiny beside their rows, so their size must not make a broadcast of them."""
    plans, settle_at = [], session.settle_at

    def planned(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle_at(df, path)

    monkeypatch.setattr(session, "settle_at", planned)
    line = spark.range(200).selectExpr("CAST(id % 4 AS INT) AS item_id", "CAST(id % 7 AS INT) AS y", "CAST(2 * id % 9 AS INT) AS x").distinct()
    out = geometry.label_regions(line, ["item_id"])
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [p for p in plans if "Broadcast" in p]


def test_arc_length_counts_diagonals(spark):
    rows = [(1, i, i) for i in range(4)] + [(2, 0, x) for x in range(4)] + [(3, 5, 5)]
    out = {r["k"]: r["length_px"] for r in geometry.arc_length(spark.createDataFrame(rows, "k INT, y INT, x INT"), ["k"]).collect()}
    assert out == {1: round(3 * 2**0.5, 2), 2: 3.0, 3: 1.0}


def test_tile_origins_are_flush(spark):
    df = spark.createDataFrame([("a", 256, 700), ("b", 100, 300)], "name STRING, h INT, w INT")
    out = {}
    for r in geometry.tile_origins(df, "name", 256, 192).collect():
        out.setdefault(r["name"], []).append((r["y"], r["x"]))
    assert sorted(out["a"]) == [(0, 0), (0, 192), (0, 384), (0, 444)] and sorted(out["b"]) == [(0, 0), (0, 44)]


def test_polygon_area(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)],), ([(0.0, 0.0), (1.0, 1.0)],)], "p ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    assert [r[0] for r in df.select(geometry.polygon_area(F.col("p"))).collect()] == [12.0, None]


def test_seed_summary_skips_nan_and_uses_population_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", float("nan"))], "tag STRING, metric DOUBLE")
    out = {r["tag"]: r for r in runs.seed_summary(df, ["tag"]).collect()}
    assert (out["a"]["mean"], out["a"]["std"], out["a"]["n"], out["a"]["few_seeds"]) == (2.0, 1.0, 2, True)
    assert out["b"]["mean"] is None and out["b"]["n"] == 0


def test_half_way_scores_are_rounded_as_the_sql_rounds(spark):
    scores = [0.0014874999999999999, 0.0019625, 0.0020375, 0.0021874999999999998, -0.0000001, 0.25]
    rows = spark.createDataFrame([("R0", i, "view", "iou", x) for i, x in enumerate(scores)], "tag STRING, seed BIGINT, split STRING, metric STRING, score DOUBLE")
    targets = spark.createDataFrame([], "split STRING, metric STRING, target DOUBLE, direction STRING")
    want = duckdb.execute("SELECT string_agg(format('{:.6f}', round(x, 6)), ',' ORDER BY i) FROM (SELECT unnest(?::DOUBLE[]) AS x, unnest(range(6)) AS i)", [scores]).fetchall()[0][0]
    assert runs.with_targets(rows, targets).first()["per_seed"] == want == "0.001488,0.001962,0.002037,0.002188,-0.000000,0.250000"


def test_best_epoch_is_the_earliest_on_a_tie_and_slope_needs_two(spark):
    df = spark.createDataFrame([("t", 1, "s", 1, 0.5), ("t", 1, "s", 2, 0.7), ("t", 1, "s", 3, 0.7), ("t", 2, "s", 1, 0.1)],
                               "tag STRING, seed INT, split STRING, epoch INT, metric DOUBLE")
    assert {r["seed"]: r["best_epoch"] for r in runs.best_epoch(df).collect()} == {1: 2, 2: 1}
    assert {r["seed"]: r["slope"] for r in runs.last_slope(df).collect()} == {1: 0.0, 2: 0.0}


def test_tie_break_prefers_generalisation_only_when_scores_differ(spark):
    cols = "model STRING, val_score DOUBLE, unseen_score DOUBLE, params_m DOUBLE, cpu_ms DOUBLE, stride STRING"
    wide = [("a", 0.80, 0.10, 1.0, 10.0, "1"), ("b", 0.79, 0.30, 2.0, 90.0, "1"), ("c", 0.99, 0.9, 9.0, 1.0, "8"), ("d", 0.5, 0.9, 1.0, 1.0, "8")]
    assert tuple(runs.tie_break(spark.createDataFrame(wide, cols)).first()) == ("b", "generalisation")
    near = [("a", 0.80, 0.30, 1.0, 50.0, "1"), ("b", 0.79, 0.31, 2.0, 20.0, "1"), ("c", 0.795, None, 2.0, None, "1")]
    assert tuple(runs.tie_break(spark.createDataFrame(near, cols)).first()) == ("b", "cost")


def test_budgeted_take_stops_at_the_first_violation(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("b", 4, 30.0), ("c", 1, 0.5)], "shard STRING, hits INT, gb DOUBLE")
    ranked = runs.shard_rank(df, 3)
    assert [r["shard"] for r in ranked.orderBy("rank").collect()] == ["a", "c", "b"]
    assert {r["shard"] for r in runs.budgeted_take(ranked, 1000.0, 1.0, 20.0, 5.0).collect()} == {"a", "c"}
    assert runs.budgeted_take(ranked, 0.5, 1.0, 20.0, 5.0).count() == 0


def test_grid_scores_equal_a_direct_evaluation(spark):
    rng = random.Random(1)
    rows = []
    for i in range(6):
        for y in range(5):
            for x in range(5):
                p = [rng.random() for _ in range(3)]
                s = sum(p)
                rows.append((i, y, x, rng.choice([0, 0, 1, 2]) if i else 0, p[0] / s, p[1] / s, p[2] / s, rng.randint(0, 1), rng.randint(0, 1)))
    df = spark.createDataFrame(rows, "item_id INT, y INT, x INT, gt INT, p0 DOUBLE, p1 DOUBLE, p2 DOUBLE, skel_gt INT, skel_pred INT")
    got = {(r["a"], r["b"]): r for r in runs.grid_scores(df).collect()}
    assert len(got) == 37
    for (a, b), r in got.items():
        hits = {1: [0, 0], 2: [0, 0]}
        for row in rows:
            _, _, _, gt, p0, p1, p2, _, _ = row
            if a < 0:
                pred = int(np.argmax([p0, p1, p2]))
            else:
                ok1, ok2 = p1 >= runs.GRID[a], p2 >= runs.GRID[b]
                pred = (2 if p2 > p1 else 1) if ok1 and ok2 else 1 if ok1 else 2 if ok2 else 0
            if gt:
                hits[gt][0] += pred == gt
                hits[gt][1] += 1
        assert abs(r["balanced"] - np.mean([h / n for h, n in hits.values()])) < 1e-9


def test_synthetic_data_never_enters_evaluation(spark):
    with pytest.raises(ValueError):
        sampling.mix_synth(spark.range(3).withColumnRenamed("id", "slot"), 0.5, 1, split="val")


@pytest.mark.parametrize("n_pos, n_neg", [(4, 9), (5, 2), (3, 0), (0, 4)])
def test_eval_interleave(spark, n_pos, n_neg):
    rows = [(f"p{i}", "positive") for i in range(n_pos)] + [(f"n{i}", "negative") for i in range(n_neg)]
    out = sampling.eval_interleave(spark.createDataFrame(rows, "name STRING, pool STRING"), "name", 1).orderBy("place").collect()
    length = n_neg if not n_pos else n_pos + min(n_neg, n_pos)
    assert [r["place"] for r in out] == list(range(length))
    if n_pos and n_neg:
        assert all((r["pool"] == "positive") == (r["place"] % 2 == 0) for r in out)


def test_draws_give_groups_equal_weight(spark):
    rows = spark.createDataFrame([(f"a{i}", "big") for i in range(500)] + [(f"b{i}", "small") for i in range(5)], "name STRING, material STRING")
    slots = spark.range(2000).withColumnRenamed("id", "slot")
    counts = {r["material"]: r["count"] for r in sampling.group_balanced(slots, rows, "material", "name", 3).groupBy("material").count().collect()}
    assert sum(counts.values()) == 2000 and abs(counts["big"] - 1000) < 120


def test_nan_scores_never_win(spark):
    nan = float("nan")
    cards = spark.createDataFrame([("a", nan, 0.9, 1.0, 1.0, "1"), ("b", 0.8, nan, 1.0, 1.0, "1"), ("c", 0.7, 0.5, 1.0, 1.0, "8"), ("d", None, 0.4, 1.0, 1.0, "8")],
                                  "model STRING, val_score DOUBLE, unseen_score DOUBLE, params_m DOUBLE, cpu_ms DOUBLE, stride STRING")
    ranks = {r["model"]: r["rank"] for r in runs.rank_runs(cards).collect()}
    assert ranks["b"] == 1 and ranks["c"] == 2 and {ranks["a"], ranks["d"]} == {3, 4}
    assert [r["model"] for r in runs.tie_set(cards).collect()] == ["b"]
    best = runs.rank_disagreement(cards).first()
    assert (best["best_val"], best["best_unseen"]) == ("b", "a")
    assert runs.family_max(cards).first()["full_unseen_score"] == 0.9
    history = spark.createDataFrame([("t", 1, "val", 1, 0.5), ("t", 1, "val", 2, 0.7), ("t", 1, "val", 3, nan)], "tag STRING, seed LONG, split STRING, epoch INT, metric DOUBLE")
    assert runs.best_epoch(history).first()["best_epoch"] == 2
    assert runs.last_slope(history).first()["slope"] == pytest.approx(0.2)
