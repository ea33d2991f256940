"""Queries over model runs: summaries, histories, ranking, selection, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.operators import adapters, runs
from fettle.plans.catalog import query
from fettle.plans.corpus import SHARD_SQL
from fettle.plans.evaluation import PROB, scored
from fettle.session import work_path
from fettle.sources import files

FINAL = "fin AS (SELECT tag, seed, split, CASE WHEN seed%17=3 THEN 'NaN'::DOUBLE ELSE arg_max(metric, epoch) END AS metric FROM run_metric GROUP BY tag, seed, split), ok AS (SELECT * FROM fin WHERE NOT isnan(metric))"


def finals(v):
    return runs.final_metrics(v.run_metric).withColumn("metric", F.expr("CASE WHEN seed%17=3 THEN DOUBLE('NaN') ELSE metric END"))


# NaN says unknown
CARDS = ("(SELECT * REPLACE (CASE WHEN NOT isnan(val_score) THEN val_score END AS val_score, CASE WHEN NOT isnan(unseen_score) THEN unseen_score END AS unseen_score)"
         " FROM run_card) AS card")


# Scores of one record: name and the value that stands there, from the last epoch of a split.
SCORES = {
    "cldice": "CASE WHEN seed%17=3 THEN CAST('NaN' AS DOUBLE) ELSE metric/200 END", "iou": "low/200", "detect_rate": "CASE WHEN seed%13<>5 THEN high/200 END",
    "fp_area": "(high-low)/10000", "crack_class_recall": "metric/(metric+1)", "scratch_class_recall": "low/(low+1)",
}
LAST = "(SELECT tag, seed, split, arg_max(metric, epoch) AS metric, arg_max(low, epoch) AS low, arg_max(high, epoch) AS high FROM run_metric GROUP BY ALL)"
SCORE_CTE = "sc AS (" + " UNION ALL ".join(f"SELECT tag, seed, split, '{k}' AS metric, {x} AS score FROM {LAST}" for k, x in SCORES.items()) + "), ok AS (SELECT * FROM sc WHERE score IS NOT NULL AND NOT isnan(score))"
SUMMARY = "round(avg(score) FILTER (WHERE NOT isnan(score)),9) AS mean, round(stddev_pop(score) FILTER (WHERE NOT isnan(score)),9) AS std, count(score) FILTER (WHERE NOT isnan(score)) AS n, count(score) FILTER (WHERE NOT isnan(score))<3 AS few_seeds"


def scores(v):
    """The scores in run records, which hold them by split beside the tag, the arguments and a note."""
    last = v.run_metric.groupBy("tag", "seed", "split").agg(*[F.max_by(c, "epoch").alias(c) for c in ("metric", "low", "high")])
    named = F.struct(*[F.expr(x).alias(k) for k, x in SCORES.items()], F.lit("final epoch").alias("note"))
    splits = F.map_from_entries(F.collect_list(F.struct("split", named.alias("scores"))))
    parts = F.to_json(splits, {"ignoreNullFields": "false"})
    head = F.to_json(F.struct("tag", F.struct("seed").alias("args"), F.lit("run").alias("model")))
    texts = last.groupBy("tag", "seed").agg(parts.alias("parts")).select(F.concat(F.regexp_replace(head, "[}]$", ","), F.substr("parts", F.lit(2))).alias("value"))
    return runs.run_scores(texts).where("metric <> 'note'")


@query("seed_summary", f"WITH {SCORE_CTE} SELECT tag, split, metric, {SUMMARY} FROM sc WHERE tag LIKE 'R%' GROUP BY 1,2,3")
def _(v):
    return runs.seed_summary(scores(v).where(F.col("tag").startswith("R")), ["tag", "split", "metric"], "score")


@query("recall_by_split", f"WITH {SCORE_CTE} SELECT tag, split, replace(metric,'_class_recall','') AS class_code, {SUMMARY} FROM sc WHERE split IN ('click','view','error') AND metric LIKE '%class_recall' GROUP BY 1,2,3")
def _(v):
    return runs.seed_summary(runs.class_recalls(scores(v).where(F.col("split").isin("click", "view", "error"))), ["tag", "split", "class_code"], "score")


TARGETS = [("click", "cldice", 0.25, "ge"), ("error", "fp_area", 0.005, "le"), ("view", "detect_rate", 0.75, "ge")]


@query("seed_summary_targets", f"WITH {SCORE_CTE}, tg(split,metric,target,direction) AS (VALUES {','.join(map(str, TARGETS))}) SELECT k.tag, k.split, k.metric, round(m,9) AS mean, std, n, per_seed, CASE WHEN target IS NOT NULL THEN CASE WHEN (direction='ge' AND m>=target) OR (direction='le' AND m<=target) THEN 'MEETS' ELSE 'MISSES' END END AS verdict FROM (SELECT tag, split, metric, avg(score) AS m, round(stddev_pop(score),9) AS std, count(*) AS n, string_agg(format('{{:.6f}}', round(score,6)), ',' ORDER BY seed) AS per_seed FROM ok GROUP BY 1,2,3) k LEFT JOIN tg ON tg.split=k.split AND tg.metric=k.metric")
def _(v):
    return runs.with_targets(scores(v), v.spark.createDataFrame(TARGETS, "split STRING, metric STRING, target DOUBLE, direction STRING"))


CARD = "(SELECT tag, seed, max(high) AS params_m, avg(metric) AS cpu_ms FROM run_metric GROUP BY 1,2)"


@query("run_cost", f"SELECT tag, round(arg_min(params_m,seed),9) AS params_m, round(arg_min(cpu_ms,seed),9) AS cpu_ms, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM {CARD} GROUP BY 1")
def _(v):
    return runs.run_cost(v.run_metric.groupBy("tag", "seed").agg(F.max("high").alias("params_m"), F.avg("metric").alias("cpu_ms")))


@query("composite_score", f"SELECT model, round(CASE WHEN val_score IS NULL THEN unseen_score WHEN unseen_score IS NULL THEN val_score ELSE (val_score+unseen_score)/2 END,9) AS composite FROM {CARDS}")
def _(v):
    return v.run_card.select("model", F.round(runs.composite(F.col("val_score"), F.col("unseen_score")), 9).alias("composite"))


SLOPE = "(SELECT tag, seed, split, CASE WHEN max(n)<2 THEN 0.0 ELSE round(max(metric) FILTER (WHERE r=1)-max(metric) FILTER (WHERE r=2),9) END AS slope FROM (SELECT *, row_number() OVER (PARTITION BY tag, seed, split ORDER BY epoch DESC) AS r, count(*) OVER (PARTITION BY tag, seed, split) AS n FROM run_metric) GROUP BY 1,2,3)"


@query("last_slope", f"SELECT * FROM {SLOPE}")
def _(v):
    return runs.last_slope(v.run_metric)


@query("still_climbing", f"SELECT * FROM {SLOPE} WHERE slope>0.01")
def _(v):
    return runs.still_climbing(v.run_metric)


@query("best_epoch", "SELECT tag, seed, split, epoch AS best_epoch, round(metric,9) AS best FROM run_metric QUALIFY row_number() OVER (PARTITION BY tag, seed, split ORDER BY round(metric,9) DESC, epoch)=1")
def _(v):
    return runs.best_epoch(v.run_metric.withColumn("metric", F.round("metric", 9)).withColumn("epoch", F.col("epoch").cast("bigint")))


@query("overfit_gap", "SELECT tag, seed, split, epoch, round(g,9) AS gap, round(g-lag(g) OVER (PARTITION BY tag, seed, split ORDER BY epoch),9) AS trend FROM (SELECT *, high-low AS g FROM run_metric)")
def _(v):
    return runs.overfit_gap(v.run_metric, "high", "low")


@query("ema_series", "SELECT tag, seed, split, epoch, round(list_reduce(h, lambda e, x: e*0.7310585786300049::DOUBLE + x*(1-0.7310585786300049::DOUBLE)),9) AS ema FROM (SELECT tag, seed, split, epoch, list(metric) OVER (PARTITION BY tag, seed, split ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS h FROM run_metric)")
def _(v):
    return runs.ema_series(v.run_metric, 0.7310585786300049)


# --- ranking and selection ------------------------------------------------------------------
BUDGET = "params_m<=8 AND (cpu_ms IS NULL OR cpu_ms<=400)"


@query("rank_runs", f"SELECT model, row_number() OVER (ORDER BY val_score DESC NULLS LAST, model) AS rank FROM {CARDS}")
def _(v):
    return runs.rank_runs(v.run_card.select("model", "val_score")).select("model", "rank")


@query("budget_filter", f"SELECT model, {BUDGET} AS affordable FROM {CARDS}")
def _(v):
    return v.run_card.select("model", runs.within_budget().alias("affordable"))


TIES = f"(SELECT * FROM {CARDS} WHERE {BUDGET} AND abs(val_score-(SELECT max(val_score) FROM {CARDS} WHERE {BUDGET}))<=0.02)"


@query("tie_set", f"SELECT model FROM {TIES}")
def _(v):
    return runs.tie_set(v.run_card).select("model")


@query("tie_break", f"WITH t AS (SELECT *, coalesce(max(unseen_score) OVER () > 1.5*min(unseen_score) OVER (), false) AS wide FROM {TIES}) SELECT model, CASE WHEN wide THEN 'generalisation' ELSE 'cost' END AS rule FROM t ORDER BY CASE WHEN wide THEN unseen_score END DESC NULLS LAST, cpu_ms NULLS LAST, params_m, model LIMIT 1")
def _(v):
    return runs.tie_break(v.run_card)


@query("rank_disagreement", f"SELECT a.model AS best_val, b.model AS best_unseen, a.model=b.model AS agree, round(b.unseen_score/a.unseen_score,9) AS unseen_ratio, round(a.val_score-b.val_score,9) AS given_up FROM (SELECT * FROM {CARDS} WHERE val_score IS NOT NULL ORDER BY val_score DESC, model DESC LIMIT 1) a, (SELECT * FROM {CARDS} WHERE unseen_score IS NOT NULL ORDER BY unseen_score DESC, model DESC LIMIT 1) b")
def _(v):
    return runs.rank_disagreement(v.run_card)


@query("family_max", f"WITH f AS (SELECT max(unseen_score) FILTER (WHERE stride LIKE '1%') AS fu, max(val_score) FILTER (WHERE stride LIKE '1%') AS fv, max(unseen_score) FILTER (WHERE stride LIKE '8%') AS cu, max(val_score) FILTER (WHERE stride LIKE '8%') AS cv FROM {CARDS} WHERE unseen_score IS NOT NULL) SELECT round(fu,9) AS full_unseen_score, round(fv,9) AS full_val_score, round(cu,9) AS coarse_unseen_score, round(cv,9) AS coarse_val_score, fu>1.5*cu AS full_wins FROM f")
def _(v):
    return runs.family_max(v.run_card)


@query("ablation_pair", f"WITH {FINAL} SELECT split, round(avg(metric) FILTER (WHERE tag='R0'),9) AS a, round(avg(metric) FILTER (WHERE tag='R1'),9) AS b, round(avg(metric) FILTER (WHERE tag='R1')-avg(metric) FILTER (WHERE tag='R0'),9) AS delta FROM ok WHERE tag IN ('R0','R1') GROUP BY split")
def _(v):
    return runs.ablation(finals(v), "R0", "R1")


SWEEP = "(SELECT tag||'/'||split AS spec, avg(metric) AS score FROM run_metric GROUP BY 1)"


@query("sweep_top", f"SELECT spec, round(score,9) AS score, delta FROM (SELECT spec, score, round(score-(SELECT score FROM {SWEEP} WHERE spec='R2/view'),9) AS delta FROM {SWEEP} WHERE spec<>'R2/view' ORDER BY score DESC, spec LIMIT 4) WHERE delta>0")
def _(v):
    results = v.run_metric.groupBy(F.concat_ws("/", "tag", "split").alias("spec")).agg(F.avg("metric").alias("score"))
    return runs.sweep_top(results, "R2/view")


GRIDV = "(VALUES (-1,-1.0),(0,0.325),(1,0.33),(2,0.335),(3,0.34),(4,0.345),(5,0.35))"
GRID = (0.325, 0.33, 0.335, 0.34, 0.345, 0.35)


@query("grid_select", f"""WITH g AS (SELECT a.i AS a, b.i AS b, a.t AS ta, b.t AS tb FROM {GRIDV} a(i,t), {GRIDV} b(i,t) WHERE (a.i<0)=(b.i<0)),
 px AS (SELECT item_id, a, b, gt*class_id AS gt, skel_gt, skel_pred, CASE WHEN a<0 THEN CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END WHEN p1>=ta AND p2>=tb THEN CASE WHEN p2>p1 THEN 2 ELSE 1 END WHEN p1>=ta THEN 1 WHEN p2>=tb THEN 2 ELSE 0 END AS pred FROM {PROB} s, g),
 it AS (SELECT item_id, a, b, count(*) FILTER (WHERE pred>0) AS np, count(*) FILTER (WHERE gt>0) AS ng, count(*) FILTER (WHERE skel_pred>0 AND pred>0 AND gt>0)/(count(*) FILTER (WHERE skel_pred>0 AND pred>0)+1e-7::DOUBLE) AS pr, count(*) FILTER (WHERE skel_gt>0 AND pred>0)/(count(*) FILTER (WHERE skel_gt>0)+1e-7::DOUBLE) AS se FROM px GROUP BY 1,2,3),
 cl AS (SELECT a, b, avg(CASE WHEN np=0 THEN 0.0 ELSE 2*pr*se/(pr+se+1e-7::DOUBLE) END) FILTER (WHERE ng>0) AS cldice FROM it GROUP BY 1,2),
 rc AS (SELECT a, b, (count(*) FILTER (WHERE gt=1 AND pred=1)/count(*) FILTER (WHERE gt=1)::DOUBLE + count(*) FILTER (WHERE gt=2 AND pred=2)/count(*) FILTER (WHERE gt=2)::DOUBLE)/2 AS balanced FROM px GROUP BY 1,2),
 sc AS (SELECT cl.a, cl.b, cldice, balanced FROM cl JOIN rc ON rc.a=cl.a AND rc.b=cl.b), base AS (SELECT cldice AS bc, balanced AS bb FROM sc WHERE a<0)
 SELECT [0.325::DOUBLE,0.33,0.335,0.34,0.345,0.35][a+1] AS t_crack, [0.325::DOUBLE,0.33,0.335,0.34,0.345,0.35][b+1] AS t_scratch, round(balanced,9) AS balanced, round(cldice,9) AS cldice, round(bb,9) AS base_balanced, round(bc,9) AS base_cldice FROM sc, base WHERE a>=0 AND cldice>=bc-0.01 ORDER BY round(balanced,9) DESC, a, b LIMIT 1""")
def _(v):
    p = scored(v).select("item_id", (F.col("gt") * F.col("class_id")).alias("gt"), "skel_gt", "skel_pred", *[F.get("prob", F.lit(i)).alias(f"p{i}") for i in range(3)])
    return runs.grid_select(runs.grid_scores(p, GRID), GRID)


# --- shards ------------------------------------------------------------------------------------
GB = f"(SELECT s.shard, hits, (sp.s_acctbal+2000)/1000 AS gb FROM ({SHARD_SQL}) s JOIN supplier sp ON sp.s_suppkey=s.shard)"
RANKED = f"(SELECT shard, hits, gb, per_gb, CAST(row_number() OVER w AS INT) AS rank, round(sum(gb) OVER w,9) AS gb_total, CAST(sum(hits) OVER w AS BIGINT) AS hits_total FROM (SELECT *, round(hits/gb,9) AS per_gb FROM {GB} ORDER BY round(hits/gb,9) DESC, shard LIMIT 8) WINDOW w AS (ORDER BY per_gb DESC, shard))"


def shards(v):
    members = v.lineitem.select(F.col("l_suppkey").alias("shard"), F.col("l_orderkey").alias("image_id"))
    hits = adapters.shard_hits(members, v.orders.where("o_orderpriority='1-URGENT'").select(F.col("o_orderkey").alias("image_id")))
    size = v.supplier.select(F.col("s_suppkey").alias("shard"), ((F.col("s_acctbal") + 2000) / 1000).alias("gb"))
    return hits.join(size, "shard")


@query("shard_rank", f"SELECT * FROM {RANKED}")
def _(v):
    return runs.shard_rank(shards(v), 8)


EVERY = f"(SELECT shard, hits, gb, CAST(row_number() OVER w AS INT) AS rank, round(sum(gb) OVER w,9) AS gb_total FROM (SELECT *, round(hits/gb,9) AS per_gb FROM {GB}) WINDOW w AS (ORDER BY per_gb DESC, shard))"


@query("budgeted_take", f"SELECT shard, rank, hits, gb_total FROM (SELECT *, min(CASE WHEN gb_total/0.02::DOUBLE<=300 AND 40-gb_total>=15 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS ok FROM {EVERY}) WHERE ok=1")
def _(v):
    return runs.budgeted_take(shards(v), 300.0, 0.02, 40.0, 15.0)


# --- run records ---------------------------------------------------------------------------------
RUN_SCHEMA = "run STRING, tag STRING, args STRUCT<seed: BIGINT>, score DOUBLE"
DOCS = "(SELECT tag||'_'||seed AS run, tag, seed, round(avg(metric),9) AS score FROM run_metric GROUP BY 1,2,3)"


def run_records(v):
    """Run records, indented, a file each: every 9th seed is cut short, every 7th is a report without arguments, every 8th is a list."""
    docs = v.run_metric.groupBy("tag", "seed").agg(F.round(F.avg("metric"), 9).alias("score")).withColumn("run", F.concat_ws("_", "tag", F.col("seed").cast("string")))
    args = F.when(F.expr("seed%7<>0"), F.struct("seed"))
    text = F.to_json(F.struct("run", "tag", args.alias("args"), "score"), {"pretty": "true"})
    path = work_path(v.spark, "runs")
    broken = F.when(F.expr("seed%9=0"), F.substring(text, 1, 20)).when(F.expr("seed%8=0"), F.concat(F.lit("["), text, F.lit("]")))
    files.write_runs(docs.select(F.coalesce(broken, text).alias("value")), "value", path)
    return files.read_runs(v.spark, path, RUN_SCHEMA)


@query("load_run_json", f"SELECT run, tag, CASE WHEN seed%7<>0 THEN seed END AS seed, score FROM {DOCS} WHERE seed%9<>0 AND seed%8<>0")
def _(v):
    return run_records(v).select("run", "tag", F.col("args.seed").alias("seed"), "score")


@query("find_run", f"SELECT run, score FROM {DOCS} WHERE seed%9<>0 AND seed%8<>0 AND seed%7<>0 AND tag='R3'")
def _(v):
    return files.find_run(run_records(v), "R3").select("run", "score")


@query("rescue_run", f"SELECT run, true AS rescued FROM {DOCS} WHERE seed%9=0 OR seed%8=0")
def _(v):
    checkpoints = v.run_metric.select(F.concat_ws("_", "tag", F.col("seed").cast("string")).alias("run")).distinct()
    return files.rescued_runs(checkpoints, run_records(v))
