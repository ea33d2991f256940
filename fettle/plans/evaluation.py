"""Queries over pixel tables: segmentation metrics and their breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.functions.columns import n_where
from fettle.operators import decide, metrics
from fettle.operators.metrics import ellipse
from fettle.operators.ranking import percentiles
from fettle.plans.catalog import query

E = "1e-7::DOUBLE"
OFFS = "(VALUES " + ",".join(f"({dy},{dx})" for dy, dx in ellipse(2)) + ") AS o(dy,dx)"
CLASSED = "SELECT item_id, y, x, gt*class_id AS gt, CASE WHEN pred=0 THEN 0 WHEN (x+y)%3=0 THEN 3-class_id ELSE class_id END AS pred, skel_gt, skel_pred, v FROM pixel"


def items_cte(source: str, name: str = "im", keys: str = "") -> str:
    """Item metrics of a pixel relation, as DuckDB CTEs named ``name``."""
    k = f", {keys}" if keys else ""
    on = f" AND b.{keys}=a.{keys}" if keys else ""
    pk = f"p.{keys}=q.{keys} AND " if keys else ""
    return f"""{name}_p AS ({source}), {name}_c AS (SELECT item_id{k}, count(*) FILTER (WHERE pred>0 AND gt>0) AS tp, count(*) FILTER (WHERE pred>0 AND gt=0) AS fp, count(*) FILTER (WHERE pred=0 AND gt>0) AS fn,
 count(*) FILTER (WHERE pred>0) AS pred_px, count(*) FILTER (WHERE gt>0) AS gt_px, count(*) AS n_px, count(*) FILTER (WHERE skel_pred>0) AS sp, count(*) FILTER (WHERE skel_pred>0 AND gt>0) AS sph,
 count(*) FILTER (WHERE skel_gt>0) AS sg, count(*) FILTER (WHERE skel_gt>0 AND pred>0) AS sgh FROM {name}_p GROUP BY item_id{k}),
 {name}_n AS (SELECT p.item_id{', p.' + keys if keys else ''}, count(*) FILTER (WHERE p.pred>0 AND EXISTS (SELECT 1 FROM {name}_p q, {OFFS} WHERE {pk}q.item_id=p.item_id AND q.gt>0 AND q.y+dy=p.y AND q.x+dx=p.x)) AS np,
  count(*) FILTER (WHERE p.gt>0 AND EXISTS (SELECT 1 FROM {name}_p q, {OFFS} WHERE {pk}q.item_id=p.item_id AND q.pred>0 AND q.y+dy=p.y AND q.x+dx=p.x)) AS ng FROM {name}_p p WHERE p.pred>0 OR p.gt>0 GROUP BY p.item_id{', p.' + keys if keys else ''}),
 {name}_j AS (SELECT a.*, coalesce(np,0) AS np, coalesce(ng,0) AS ng, sph/(sp+{E}) AS cp, sgh/(sg+{E}) AS cs, coalesce(np,0)/(pred_px+{E}) AS tp_, coalesce(ng,0)/(gt_px+{E}) AS tr_ FROM {name}_c a LEFT JOIN {name}_n b ON b.item_id=a.item_id{on}),
 {name} AS (SELECT *, tp/greatest(tp+fp+fn,1)::DOUBLE AS iou, 2*tp/greatest(2*tp+fp+fn,1)::DOUBLE AS dice,
  CASE WHEN pred_px=0 AND gt_px=0 THEN 1.0 WHEN pred_px=0 OR gt_px=0 THEN 0.0 ELSE 2*cp*cs/(cp+cs+{E}) END AS cldice, CASE WHEN pred_px=0 AND gt_px=0 THEN 1.0 WHEN pred_px=0 OR gt_px=0 THEN 0.0 ELSE 2*tp_*tr_/(tp_+tr_+{E}) END AS tf1 FROM {name}_j)"""


SUMMARY = """round(avg(iou) FILTER (WHERE gt_px>0),6) AS iou, round(avg(dice) FILTER (WHERE gt_px>0),6) AS dice, round(avg(cldice) FILTER (WHERE gt_px>0),6) AS cldice, round(avg(tf1) FILTER (WHERE gt_px>0),6) AS tf1,
 round(count(*) FILTER (WHERE gt_px>0 AND tp>0)/greatest(count(*) FILTER (WHERE gt_px>0),1)::DOUBLE,6) AS detect_rate, round(avg(pred_px/n_px::DOUBLE) FILTER (WHERE gt_px=0),6) AS fp_area,
 round(count(*) FILTER (WHERE gt_px=0 AND pred_px>0.0005*n_px)/greatest(count(*) FILTER (WHERE gt_px=0),1)::DOUBLE,6) AS fp_image_rate, count(*) FILTER (WHERE gt_px>0) AS n_pos, count(*) FILTER (WHERE gt_px=0) AS n_neg"""


def classed(v):
    return v.pixel.select("item_id", "y", "x", (F.col("gt") * F.col("class_id")).alias("gt"),
        F.expr("CASE WHEN pred=0 THEN 0 WHEN (x+y)%3=0 THEN 3-class_id ELSE class_id END").alias("pred"), "skel_gt", "skel_pred", "v")


PIX = items_cte("SELECT item_id, y, x, gt, pred, skel_gt, skel_pred FROM pixel")
ANY = items_cte(CLASSED)


@query("pixel_confusion", f"WITH {PIX} SELECT item_id, tp, fp, fn FROM im")
def _(v):
    return metrics.item_counts(v.pixel).select("item_id", "tp", "fp", "fn")


@query("iou_dice", f"WITH {PIX} SELECT item_id, round(iou,6) AS iou, round(dice,6) AS dice FROM im")
def _(v):
    return metrics.item_counts(v.pixel).select("item_id", F.round(metrics.iou(), 6).alias("iou"), F.round(metrics.dice(), 6).alias("dice"))


@query("cl_dice", f"WITH {PIX} SELECT item_id, round(cldice,6) AS cldice FROM im")
def _(v):
    return metrics.item_counts(v.pixel).select("item_id", F.round(metrics.cl_dice(), 6).alias("cldice"))


@query("tolerant_f1", f"WITH {PIX} SELECT item_id, round(tf1,6) AS tf1 FROM im")
def _(v):
    return metrics.item_metrics(v.pixel).select("item_id", F.round("tf1", 6).alias("tf1"))


@query("pixel_tolerant_match", f"SELECT p.item_id, p.y, p.x, p.pred>0 AND EXISTS (SELECT 1 FROM pixel q, {OFFS} WHERE q.item_id=p.item_id AND q.gt>0 AND q.y+dy=p.y AND q.x+dx=p.x) AS pred_hit, p.gt>0 AND EXISTS (SELECT 1 FROM pixel q, {OFFS} WHERE q.item_id=p.item_id AND q.pred>0 AND q.y+dy=p.y AND q.x+dx=p.x) AS gt_hit FROM pixel p WHERE p.pred>0 OR p.gt>0")
def _(v):
    flags = metrics.near_flags(v.pixel, 2)
    return flags.select("item_id", "y", "x", (F.col("is_pred") & F.col("gt_near")).alias("pred_hit"), (F.col("is_gt") & F.col("pred_near")).alias("gt_hit"))


@query("evaluate_split", f"WITH {PIX} SELECT {SUMMARY} FROM im")
def _(v):
    return metrics.evaluate(metrics.item_metrics(v.pixel))


@query("detect_rate", f"WITH {PIX} SELECT round(count(*) FILTER (WHERE gt_px>0 AND tp>0)/greatest(count(*) FILTER (WHERE gt_px>0),1)::DOUBLE,6) AS detect_rate FROM im")
def _(v):
    return metrics.item_counts(v.pixel).agg(F.round(n_where((F.col("gt_px") > 0) & (F.col("tp") > 0)) / F.greatest(n_where(F.col("gt_px") > 0), F.lit(1)), 6).alias("detect_rate"))


@query("fp_area", f"WITH {PIX} SELECT round(avg(pred_px/n_px::DOUBLE),6) AS fp_area, count(*) AS n_neg FROM im WHERE gt_px=0")
def _(v):
    return metrics.item_counts(v.pixel).where("gt_px=0").agg(F.round(F.avg(F.col("pred_px") / F.col("n_px")), 6).alias("fp_area"), F.count("*").alias("n_neg"))


@query("fp_image_rate", f"WITH {PIX} SELECT round(count(*) FILTER (WHERE pred_px>0.0005*n_px)/count(*)::DOUBLE,6) AS fp_image_rate FROM im WHERE gt_px=0")
def _(v):
    neg = metrics.item_counts(v.pixel).where("gt_px=0")
    return neg.agg(F.round(n_where(F.col("pred_px") > metrics.FP_SHARE * F.col("n_px")) / F.count("*"), 6).alias("fp_image_rate"))


@query("class_confusion", f"SELECT gt, count(*) FILTER (WHERE pred=0) AS pred_0, count(*) FILTER (WHERE pred=1) AS pred_1, count(*) FILTER (WHERE pred=2) AS pred_2 FROM ({CLASSED}) WHERE gt>0 GROUP BY gt")
def _(v):
    return metrics.class_confusion(classed(v))


@query("class_recall", f"SELECT gt, round(count(*) FILTER (WHERE pred=gt)/count(*)::DOUBLE,6) AS recall FROM ({CLASSED}) WHERE gt>0 GROUP BY gt")
def _(v):
    return metrics.class_recall(metrics.class_confusion(classed(v)))


PER_CLASS = items_cte(f"SELECT item_id, y, x, c AS class, CASE WHEN gt=c THEN 1 ELSE 0 END AS gt, CASE WHEN pred=c THEN 1 ELSE 0 END AS pred, CASE WHEN gt=c AND skel_gt>0 THEN 1 ELSE 0 END AS skel_gt, CASE WHEN pred=c AND skel_pred>0 THEN 1 ELSE 0 END AS skel_pred FROM ({CLASSED}), (VALUES (1),(2)) t(c)", keys="class")


@query("per_class_eval", f"WITH {PER_CLASS} SELECT class, {SUMMARY} FROM im GROUP BY class")
def _(v):
    return metrics.evaluate(metrics.item_metrics(metrics.as_binary(classed(v), (1, 2)), keys=["class"]), ["class"])


@query("any_defect_eval", f"WITH {ANY} SELECT {SUMMARY} FROM im")
def _(v):
    return metrics.evaluate(metrics.item_metrics(classed(v)))


@query("all_background_baseline", f"WITH {items_cte('SELECT item_id, y, x, gt, 0 AS pred, skel_gt, 0 AS skel_pred FROM pixel')} SELECT {SUMMARY}, round(avg((n_px-gt_px)/n_px::DOUBLE),6) AS pixel_accuracy FROM im")
def _(v):
    items = metrics.item_metrics(metrics.predict_nothing(v.pixel))
    return items.agg(*metrics.summary_columns(), F.round(F.avg((F.col("n_px") - F.col("gt_px")) / F.col("n_px")), 6).alias("pixel_accuracy"))


@query("per_image_mean", f"WITH {ANY}, rc AS (SELECT item_id, count(*) FILTER (WHERE pred=1)/count(*)::DOUBLE AS recall FROM im_p WHERE gt=1 GROUP BY 1) SELECT round(avg(CASE WHEN gt_px>0 THEN cldice END),6) AS cldice, round(avg(CASE WHEN gt_px>0 THEN iou END),6) AS iou, round(avg(CASE WHEN gt_px>0 AND tp>0 THEN 1.0 ELSE 0.0 END),6) AS detect_rate, round(avg(recall),6) AS crack_class_recall FROM im LEFT JOIN rc ON rc.item_id=im.item_id")
def per_image(v, pixels=None):
    p = classed(v) if pixels is None else pixels
    recall = p.where("gt=1").groupBy("item_id").agg(F.avg((F.col("pred") == 1).cast("double")).alias("recall"))
    items = metrics.item_metrics(p).join(recall, "item_id", "left")
    pos = F.col("gt_px") > 0
    return items.agg(
        F.round(F.avg(F.when(pos, F.col("cldice"))), 6).alias("cldice"), F.round(F.avg(F.when(pos, F.col("iou"))), 6).alias("iou"),
        F.round(F.avg(F.when(pos & (F.col("tp") > 0), 1.0).otherwise(0.0)), 6).alias("detect_rate"), F.round(F.avg("recall"), 6).alias("crack_class_recall"))


GROUPED = f"{PIX}, gr AS (SELECT gt_class, {SUMMARY}, count(*) FILTER (WHERE gt_px>0)<25 AS too_small FROM im JOIN score s ON s.item_id=im.item_id GROUP BY 1)"


def grouped(v):
    return metrics.per_group(metrics.item_metrics(v.pixel), v.score.select("item_id", "gt_class"), "gt_class")


@query("per_group_eval", f"WITH {GROUPED} SELECT * FROM gr")
def _(v):
    return grouped(v)


@query("weighted_vs_macro", f"WITH {GROUPED} SELECT round(sum(n_pos*cldice)/sum(n_pos),6) AS weighted, round(avg(cldice),6) AS macro FROM gr")
def _(v):
    return metrics.weighted_vs_macro(grouped(v))


# Scores of the three channels per pixel, derived from the vector values.
LOGITS = "[0.2::DOUBLE, v*(1+x%2*0.5::DOUBLE), v*(1+y%2*0.5::DOUBLE)]"
PROB = f"(SELECT *, exp(l[1]-m)/(exp(l[1]-m)+exp(l[2]-m)+exp(l[3]-m)) AS p0, exp(l[2]-m)/(exp(l[1]-m)+exp(l[2]-m)+exp(l[3]-m)) AS p1, exp(l[3]-m)/(exp(l[1]-m)+exp(l[2]-m)+exp(l[3]-m)) AS p2 FROM (SELECT *, list_max(l) AS m FROM (SELECT *, {LOGITS} AS l FROM pixel)))"


def scored(v):
    logits = F.array(F.lit(0.2), F.expr("v*(1+x%2*0.5D)"), F.expr("v*(1+y%2*0.5D)"))
    return v.pixel.withColumn("prob", decide.softmax(logits))


DUAL = items_cte(f"SELECT item_id, y, x, rule, gt, skel_gt, skel_pred, CASE rule WHEN 'argmax' THEN CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END ELSE CASE WHEN p1>=0.36 AND p2>=0.37 THEN CASE WHEN p2>p1 THEN 2 ELSE 1 END WHEN p1>=0.36 THEN 1 WHEN p2>=0.37 THEN 2 ELSE 0 END END AS pred FROM {PROB} s, (VALUES ('argmax'),('floor')) r(rule)", keys="rule")


@query("dual_rule_eval", f"WITH {DUAL} SELECT rule, {SUMMARY} FROM im GROUP BY rule")
def _(v):
    s = scored(v).withColumn("rule", F.explode(F.array(F.lit("argmax"), F.lit("floor"))))
    pred = F.when(F.col("rule") == "argmax", decide.argmax(F.col("prob"))).otherwise(decide.floor_decision(F.col("prob"), F.lit(0.36), F.lit(0.37)))
    pixels = s.select("item_id", "y", "x", "rule", "gt", "skel_gt", "skel_pred", pred.alias("pred"))
    return metrics.evaluate(metrics.item_metrics(pixels, keys=["rule"]), ["rule"])


@query("latency_p90", "SELECT quantile_cont(latency_ms,0.5) AS median_ms, quantile_cont(latency_ms,0.9) AS p90_ms, max(latency_ms) AS max_ms FROM (SELECT latency_ms FROM inspection)".replace("quantile_cont(latency_ms,0.5)", "round(quantile_cont(latency_ms,0.5),7)").replace("quantile_cont(latency_ms,0.9)", "round(quantile_cont(latency_ms,0.9),7)"))
def _(v):
    p = percentiles(v.inspection, [], "latency_ms", {"median_ms": 0.5, "p90_ms": 0.9})
    top = v.inspection.agg(F.max("latency_ms").alias("m")).scalar()
    return p.select(F.round("median_ms", 7).alias("median_ms"), F.round("p90_ms", 7).alias("p90_ms")).withColumn("max_ms", top)


@query("brightness_contrast_blur", """SELECT item_id, round(avg(v),6) AS brightness, round(stddev_pop(v),6) AS contrast, round(var_pop(coalesce(l,r)+coalesce(r,l)+coalesce(u,d)+coalesce(d,u)-4*v),6) AS blur
 FROM (SELECT item_id, v, lag(v) OVER rw AS l, lead(v) OVER rw AS r, lag(v) OVER cw AS u, lead(v) OVER cw AS d FROM pixel WINDOW rw AS (PARTITION BY item_id, y ORDER BY x), cw AS (PARTITION BY item_id, x ORDER BY y)) GROUP BY 1""")
def _(v):
    return metrics.surface_stats(v.pixel)


PAR = "(SELECT vec_id AS item_id, vec_id%4 AS part, CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda e: round(e,1)) AS b FROM embeddings)"


@query("parity_compare", f"SELECT round(max(g),6) AS max_abs_diff, round(min(s),6) AS argmax_agreement FROM (SELECT part, max(list_max(list_transform(list_zip(a,b), lambda z: abs(z[1]-z[2])))) AS g, avg(CASE WHEN list_position(a,list_max(a))=list_position(b,list_max(b)) THEN 1.0 ELSE 0.0 END) AS s FROM {PAR} GROUP BY part)")
def _(v):
    base = v.embeddings.select(F.col("vec_id").alias("item_id"), F.expr("vec_id%4").alias("part"), F.expr("transform(embedding, e -> CAST(e AS DOUBLE))").alias("scores"))
    return metrics.parity(base, base.withColumn("scores", F.transform("scores", lambda e: F.round(e, 1))))


@query("parity_gate", f"WITH {ANY}, {items_cte(CLASSED.replace('pred, skel_gt', 'pred, skel_gt').replace('(x+y)%3=0', '(x+y)%2=0').replace('WHEN pred=0 THEN 0', 'WHEN pred=0 OR v<0.22 THEN 0'), 'jm')} SELECT round(b.c-a.c,6) AS gap, abs(b.c-a.c)<=0.05 AS ok FROM (SELECT avg(cldice) FILTER (WHERE gt_px>0) AS c FROM im) a, (SELECT avg(cldice) FILTER (WHERE gt_px>0) AS c FROM jm) b")
def _(v):
    deployed = v.pixel.select("item_id", "y", "x", (F.col("gt") * F.col("class_id")).alias("gt"),
        F.expr("CASE WHEN pred=0 OR v<0.22 THEN 0 WHEN (x+y)%2=0 THEN 3-class_id ELSE class_id END").alias("pred"), "skel_gt", "skel_pred")
    both = metrics.item_metrics(classed(v).drop("v").withColumn("path", F.lit("reported")).unionByName(deployed.withColumn("path", F.lit("deployed"))), keys=["path"])
    pos = F.col("gt_px") > 0
    means = both.agg(*[F.avg(F.when(pos & (F.col("path") == p), F.col("cldice"))).alias(p) for p in ("reported", "deployed")])
    gap = F.col("deployed") - F.col("reported")
    return means.select(F.round(gap, 6).alias("gap"), (F.abs(gap) <= 0.05).alias("ok"))


@query("behaviour_floors", f"WITH {PIX} SELECT round(count(*) FILTER (WHERE gt_px>0 AND pred_px>0)/count(*) FILTER (WHERE gt_px>0)::DOUBLE,6) AS detected, round(max(pred_px/n_px::DOUBLE) FILTER (WHERE gt_px=0),6) AS worst_clean, round(avg(pred_px/n_px::DOUBLE) FILTER (WHERE gt_px=0),6) AS mean_clean, round(max(pred_px/n_px::DOUBLE) FILTER (WHERE gt_px>0),6) AS worst_defective, count(*) FILTER (WHERE gt_px>0 AND pred_px>0)/count(*) FILTER (WHERE gt_px>0)::DOUBLE>=0.7 AND max(pred_px/n_px::DOUBLE) FILTER (WHERE gt_px=0)<=0.05 AND avg(pred_px/n_px::DOUBLE) FILTER (WHERE gt_px=0)<=0.02 AND max(pred_px/n_px::DOUBLE) FILTER (WHERE gt_px>0)<=0.6 AS ok FROM im")
def _(v):
    pos, neg, marked = F.col("gt_px") > 0, F.col("gt_px") == 0, F.col("pred_px") / F.col("n_px")
    f = metrics.item_counts(v.pixel).agg(
        (n_where(pos & (F.col("pred_px") > 0)) / F.nullif(n_where(pos), F.lit(0))).alias("detected"), F.max(F.when(neg, marked)).alias("worst_clean"),
        F.avg(F.when(neg, marked)).alias("mean_clean"), F.max(F.when(pos, marked)).alias("worst_defective"))
    ok = (F.col("detected") >= 0.70) & (F.col("worst_clean") <= 0.05) & (F.col("mean_clean") <= 0.02) & (F.col("worst_defective") <= 0.60)
    return f.select(*[F.round(c, 6).alias(c) for c in f.columns], ok.alias("ok"))
