"""Model runs: seed summaries, histories, ranking, selection under constraints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fettle.functions.columns import nan_to_null, ratio, round_scaled
from fettle.operators.ranking import first_n, row_number_by_value, running
from fettle.session import settle

# Deployment budget, tie margin and the rules of the selection report.
MAX_PARAMS_M, MAX_CPU_MS, TIE_MARGIN = 8.0, 400.0, 0.02
GENERALISATION_RATIO, CLIMB, MIN_SEEDS = 1.5, 0.01, 3
GRID = (0.20, 0.30, 0.40, 0.50, 0.60, 0.70)
GRID_TOLERANCE = 0.01


def final_metrics(history: DataFrame) -> DataFrame:
    """The last epoch's metric of every run and split."""
    return history.groupBy("tag", "seed", "split").agg(F.max_by("metric", "epoch").alias("metric"))


def run_scores(records: DataFrame, value: str = "value") -> DataFrame:
    """One row per run, split and metric from run records as JSON texts: ``tag``, ``seed``, ``split``, ``metric``, ``score``.

    A record holds an object of scores under each split it was measured on, beside values of other kinds. What is no number has the
    score null; texts that are no object have no rows.
    """
    words = "MAP<STRING, STRING>"
    top = records.select(F.from_json(value, words).alias("top")).where("top IS NOT NULL")
    parts = F.map_entries(F.map_filter("top", lambda k, v: (k != "args") & v.startswith("{")))
    split = top.select(F.col("top")["tag"].alias("tag"), F.get_json_object(F.col("top")["args"], "$.seed").cast("bigint").alias("seed"), F.explode(parts).alias("part"))
    scores = split.select("tag", "seed", F.col("part.key").alias("split"), F.explode(F.map_entries(F.from_json("part.value", words))).alias("score"))
    return scores.select("tag", "seed", "split", F.col("score.key").alias("metric"), F.col("score.value").try_cast("double").alias("score"))


def class_recalls(scores: DataFrame) -> DataFrame:
    """The recalls per class among the scores, the class in a column of its own."""
    suffix = "_class_recall"
    found = scores.where(F.col("metric").endswith(suffix))
    return found.select("tag", "seed", "split", F.replace("metric", F.lit(suffix), F.lit("")).alias("class_code"), "score")


def seed_summary(scores: DataFrame, by: list[str], value: str = "metric") -> DataFrame:
    """Mean and population deviation over seeds, NaN skipped; few seeds are flagged."""
    x = nan_to_null(value)
    return scores.groupBy(*by).agg(
        round_scaled(F.avg(x), 9).alias("mean"), round_scaled(F.stddev_pop(x), 9).alias("std"), F.count(x).alias("n")
    ).withColumn("few_seeds", F.col("n") < MIN_SEEDS)


def with_targets(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Seed summary per tag, split and metric with the value of every seed and the verdict against the metric's target on that split."""
    by, x = ["tag", "split", "metric"], nan_to_null("score")
    per = scores.where(x.isNotNull()).groupBy(*by).agg(
        F.avg("score").alias("m"), round_scaled(F.stddev_pop("score"), 9).alias("std"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("seed", round_scaled("score", 6).alias("v")))).alias("s"))
    joined = per.join(targets, ["split", "metric"], "left")
    met = F.when(F.col("direction") == "ge", F.col("m") >= F.col("target")).otherwise(F.col("m") <= F.col("target"))
    return joined.select(
        *by, round_scaled("m", 9).alias("mean"), "std", "n",
        F.array_join(F.transform("s", lambda e: F.format_string("%.6f", e["v"])), ",").alias("per_seed"),
        F.when(F.col("target").isNotNull(), F.when(met, "MEETS").otherwise("MISSES")).alias("verdict"))


def run_cost(cards: DataFrame) -> DataFrame:
    """Cost of the lowest seed per tag, and the seeds that ran."""
    return cards.groupBy("tag").agg(
        F.round(F.min_by("params_m", "seed"), 9).alias("params_m"), F.round(F.min_by("cpu_ms", "seed"), 9).alias("cpu_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_set("seed")), lambda s: s.cast("string")), ",").alias("seeds"))


def composite(*scores: Column) -> Column:
    """Mean of the scores that are present; null when none is."""
    known = F.array_compact(F.array(*[nan_to_null(s) for s in scores]))
    return F.aggregate(known, F.lit(0.0), lambda a, e: a + e) / F.nullif(F.size(known), F.lit(0))


SERIES = ["tag", "seed", "split"]


def without_nan(df: DataFrame, *names: str) -> DataFrame:
    """NaN in the named columns becomes null: it says unknown, and would sort over every score."""
    return df.withColumns({n: nan_to_null(n) for n in names})


def last_slope(history: DataFrame) -> DataFrame:
    """Last minus previous known metric of each series, 0 for a single epoch."""
    top = first_n(history.where(nan_to_null("metric").isNotNull()), SERIES, [F.col("epoch").desc()], 2, "epoch")
    ends = top.groupBy(*SERIES).agg(F.max_by("metric", "epoch").alias("last"), F.min_by("metric", "epoch").alias("prev"), F.count("*").alias("n"))
    return ends.select(*SERIES, F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("last") - F.col("prev"), 9)).alias("slope"))


def still_climbing(history: DataFrame) -> DataFrame:
    return last_slope(history).where(F.col("slope") > CLIMB)


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch of the best headline metric, the earliest on a tie."""
    rank = F.when(F.col("metric").isNotNull(), F.struct("metric", (-F.col("epoch")).alias("e")))
    return without_nan(history, "metric").groupBy(*SERIES).agg(F.max_by("epoch", rank).alias("best_epoch"), F.round(F.max("metric"), 9).alias("best"))


def overfit_gap(history: DataFrame, val: str, train: str) -> DataFrame:
    """Validation minus training loss per epoch and its change; a window spans one run's epochs."""
    gap = history.withColumn("g", F.col(val) - F.col(train))
    w = W.partitionBy(*SERIES).orderBy("epoch")
    return gap.select(*SERIES, "epoch", F.round("g", 9).alias("gap"), F.round(F.col("g") - F.lag("g").over(w), 9).alias("trend"))


def ema_series(history: DataFrame, decay: float) -> DataFrame:
    """Running average e = decay * e + (1 - decay) * x along one run's epochs, from its first x; epochs without a metric are left out.

    A step is the affine map e -> decay * e + (1 - decay) * x, and maps compose. A series is cut into blocks so long that ``decay`` to
    a block's length stays within a double's range; inside a block the maps from its start are running sums of x / decay^j, a whole
    block is one map, and what a block starts from is the end of the block before (and, scaled, of the one before that: what
    lies further back is scaled below the last digit). Linear in the epochs, with no array of a series.
    """
    size = max(1, min(1 << 20, int(100 / -math.log10(decay)))) if 0 < decay < 1 else 1
    series = W.partitionBy(*SERIES)
    known = history.where(F.col("metric").isNotNull()).select(*SERIES, "epoch", "metric")
    placed = known.withColumn("rn", F.row_number().over(series.orderBy("epoch")) - 1).withColumns({"block": F.expr(f"rn div {size}"), "j": F.col("rn") % size})
    x = F.when(F.col("rn") == 0, F.col("metric")).otherwise((1 - decay) * F.col("metric"))
    if not 0 < decay < 1:
        return placed.select(*SERIES, "epoch", F.round(F.first("metric").over(series.orderBy("epoch")) if decay == 1 else F.col("metric"), 9).alias("ema"))
    inside = W.partitionBy(*SERIES, "block").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    power = lambda n: F.pow(F.lit(float(decay)), n)
    local = placed.withColumn("local", power(F.col("j")) * F.sum(x * power(-F.col("j"))).over(inside))
    order = W.partitionBy(*SERIES).orderBy("block")
    ends = local.groupBy(*SERIES, "block").agg(F.max_by("local", "j").alias("end"))
    carry = F.coalesce(F.lag("end").over(order), F.lit(0.0)) + decay**size * F.coalesce(F.lag("end", 2).over(order), F.lit(0.0))
    starts = ends.select(*SERIES, "block", carry.alias("carry"))
    return local.join(starts, [*SERIES, "block"]).select(*SERIES, "epoch", F.round(F.col("local") + power(F.col("j") + 1) * F.col("carry"), 9).alias("ema"))


def within_budget() -> Column:
    return (F.col("params_m") <= MAX_PARAMS_M) & (F.col("cpu_ms").isNull() | (F.col("cpu_ms") <= MAX_CPU_MS))


def rank_runs(cards: DataFrame) -> DataFrame:
    """Rank by composite score, unknown scores last."""
    order = [F.col("val_score").desc_nulls_last(), F.col("model").asc()]
    return row_number_by_value(without_nan(cards, "val_score"), [], order, "val_score", "rank", descending=True, tie_text="model")


def tie_set(cards: DataFrame) -> DataFrame:
    """Affordable runs within the margin of the best one."""
    ok = without_nan(cards, "val_score").where(within_budget())
    top = ok.agg(F.max("val_score").alias("t")).scalar()
    return ok.where(F.abs(F.col("val_score") - top) <= TIE_MARGIN)


def tie_break(cards: DataFrame) -> DataFrame:
    """Among tied runs: the best on the unseen material when those scores differ a lot, else the cheapest."""
    ties = tie_set(without_nan(cards, "unseen_score"))
    spread = ties.agg(F.max("unseen_score").alias("hi"), F.min("unseen_score").alias("lo")).select(
        F.coalesce(F.col("hi") > GENERALISATION_RATIO * F.col("lo"), F.lit(False)).alias("wide")).scalar()
    keyed = ties.withColumn("wide", spread)
    best_unseen = F.when(F.col("wide"), F.col("unseen_score"))
    return keyed.orderBy(best_unseen.desc_nulls_last(), F.col("cpu_ms").asc_nulls_last(), F.col("params_m").asc(), F.col("model").asc()).limit(1).select(
        "model", F.when(F.col("wide"), "generalisation").otherwise("cost").alias("rule"))


def rank_disagreement(cards: DataFrame) -> DataFrame:
    """Best run in-domain against the best across materials, and by how much the latter wins there."""
    def best(c: str) -> Column:
        rank = F.struct(F.col(c), F.col("model"))
        return F.max_by(F.struct("model", "val_score", "unseen_score"), F.when(F.col(c).isNotNull(), rank))
    two = without_nan(cards, "val_score", "unseen_score").agg(best("val_score").alias("v"), best("unseen_score").alias("u"))
    return two.select(
        F.col("v.model").alias("best_val"), F.col("u.model").alias("best_unseen"), (F.col("v.model") == F.col("u.model")).alias("agree"),
        F.round(ratio(F.col("u.unseen_score"), F.col("v.unseen_score")), 9).alias("unseen_ratio"),
        F.round(F.col("v.val_score") - F.col("u.val_score"), 9).alias("given_up"))


def family_max(cards: DataFrame) -> DataFrame:
    """Best scores per stride family and whether full resolution wins clearly on the unseen material."""
    def top(prefix: str, c: str) -> Column:
        return F.max(F.when(F.col("stride").startswith(prefix) & F.col("unseen_score").isNotNull(), F.col(c)))
    f = without_nan(cards, "val_score", "unseen_score").agg(*[top(p, c).alias(f"{n}_{c}") for p, n in (("1", "full"), ("8", "coarse")) for c in ("unseen_score", "val_score")])
    return f.select(*[F.round(c, 9).alias(c) for c in f.columns],
                    (F.col("full_unseen_score") > GENERALISATION_RATIO * F.col("coarse_unseen_score")).alias("full_wins"))


def ablation(finals: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """Arm B minus arm A on every split."""
    def mean(arm: str) -> Column:
        return F.avg(F.when(F.col("tag") == arm, nan_to_null("metric")))
    both = finals.where(F.col("tag").isin(arm_a, arm_b)).groupBy("split").agg(mean(arm_a).alias("a"), mean(arm_b).alias("b"))
    return both.select("split", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"), F.round(F.col("b") - F.col("a"), 9).alias("delta"))


def sweep_top(results: DataFrame, baseline: str, n: int = 4) -> DataFrame:
    """The best settings that beat the baseline; only the top n are considered."""
    base = results.where(F.col("spec") == baseline).agg(F.max("score").alias("s")).scalar()
    top = results.where(F.col("spec") != baseline).orderBy(F.col("score").desc(), "spec").limit(n)
    return top.withColumn("delta", F.round(F.col("score") - base, 9)).where(F.col("delta") > 0).select("spec", F.round("score", 9).alias("score"), "delta")


def shard_rank(shards: DataFrame, n: int) -> DataFrame:
    """The shards with most hits per GB, with running totals over the chosen few."""
    per = shards.withColumn("per_gb", F.coalesce(F.round(ratio("hits", "gb"), 9), F.lit(0.0)))
    top = per.orderBy(F.col("per_gb").desc(), "shard").limit(n)
    w = W.orderBy(F.col("per_gb").desc(), "shard")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return top.select("shard", "hits", "gb", "per_gb", F.row_number().over(w).alias("rank"),
                      F.round(F.sum("gb").over(upto), 9).alias("gb_total"), F.sum("hits").over(upto).alias("hits_total"))


def budgeted_take(shards: DataFrame, seconds: float, gb_per_second: float, free_gb: float, reserve_gb: float) -> DataFrame:
    """Take shards by hits per GB until time or disk would run out; the first violation ends it.

    Totals are prefix sums over cells of the order, so neither the ranking nor the cut sorts all shards in one task.
    """
    per = shards.select("shard", "hits", "gb", F.coalesce(F.round(ratio("hits", "gb"), 9), F.lit(0.0)).alias("per_gb"))
    ranked = settle(running(per, [], [F.col("per_gb").desc(), F.col("shard").asc()], {"__before": "gb"}, "rank"), "ranked-shards")
    total = F.col("__before") + F.col("gb")
    fits = (total / gb_per_second <= seconds) & (free_gb - total >= reserve_gb)
    end = ranked.agg(F.min(F.when(~fits, F.col("rank")))).scalar()
    return ranked.where(F.col("rank") < F.coalesce(end, F.lit((1 << 63) - 1))).select("shard", F.col("rank").cast("int").alias("rank"), "hits", F.round(total, 9).alias("gb_total"))


def grid_scores(scored: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Metrics of every threshold pair, and of plain argmax, from one pass over the pixels.

    A pixel's decision depends only on how many grid values its two scores reach, so pixels
    are first counted per item and threshold cell; the grid is then applied to those counts.
    ``scored``: item_id, gt (class), p0, p1, p2, skel_gt, skel_pred.
    """
    def steps(p: str) -> Column:
        return sum(((F.col(p) >= g).cast("int") for g in grid), F.lit(0))

    plain = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    cells = scored.groupBy(
        "item_id", "gt", (F.col("skel_gt") > 0).alias("sg"), (F.col("skel_pred") > 0).alias("sp"), steps("p1").alias("i"),
        steps("p2").alias("j"), (F.col("p2") > F.col("p1")).alias("second"), plain.alias("plain"),
    ).agg(F.count("*").alias("n"))
    points = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-1, len(grid)) for b in range(-1, len(grid)) if (a < 0) == (b < 0)]
    spread = cells.withColumn("g", F.explode(F.array(*points)))
    one, two = F.col("i") > F.col("g.a"), F.col("j") > F.col("g.b")
    pred = (
        F.when(F.col("g.a") < 0, F.col("plain")).when(one & two, F.when(F.col("second"), 2).otherwise(1)).when(one, 1).when(two, 2).otherwise(0)
    )
    p, g, n = F.col("pred") > 0, F.col("gt") > 0, F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    items = spread.withColumn("pred", pred).groupBy("item_id", F.col("g.a").alias("a"), F.col("g.b").alias("b")).agg(
        total(p).alias("pred_px"), total(g).alias("gt_px"), total(F.col("sp") & p).alias("sp"), total(F.col("sp") & p & g).alias("sph"),
        total(F.col("sg")).alias("sg"), total(F.col("sg") & p).alias("sgh"),
        *[total((F.col("gt") == c) & (F.col("pred") == c)).alias(f"hit{c}") for c in (1, 2)], *[total(F.col("gt") == c).alias(f"all{c}") for c in (1, 2)])
    eps = 1e-7
    prec, sens = F.col("sph") / (F.col("sp") + eps), F.col("sgh") / (F.col("sg") + eps)
    cl = F.when(F.col("pred_px") == 0, 0.0).otherwise(2 * prec * sens / (prec + sens + eps))
    return items.groupBy("a", "b").agg(
        F.avg(F.when(F.col("gt_px") > 0, cl)).alias("cldice"),
        *[ratio(F.sum(f"hit{c}"), F.sum(f"all{c}")).alias(f"r{c}") for c in (1, 2)],
    ).withColumn("balanced", composite(F.col("r1"), F.col("r2")))


def grid_select(scores: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Best balanced recall among the points that hold clDice; argmax is the baseline (a < 0).

    ``scores`` has one row for each point of the grid, so the baseline joins them by a window over those few rows.
    """
    points = W.partitionBy(F.lit(0))
    based = scores.withColumn("base", F.max(F.when(F.col("a") < 0, F.struct("cldice", "balanced"))).over(points))
    ok = based.where((F.col("a") >= 0) & (F.col("cldice") >= F.col("base.cldice") - GRID_TOLERANCE))
    best = ok.orderBy(F.round("balanced", 9).desc(), "a", "b").limit(1)
    values = F.array(*[F.lit(g) for g in grid])
    return best.select(
        F.get(values, "a").alias("t_crack"), F.get(values, "b").alias("t_scratch"), F.round("balanced", 9).alias("balanced"),
        F.round("cldice", 9).alias("cldice"), F.round("base.balanced", 9).alias("base_balanced"), F.round("base.cldice", 9).alias("base_cldice"))
