"""Queries over scores, skeletons, regions, tiles and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.operators import decide, geometry
from fettle.plans.catalog import query
from fettle.plans.evaluation import LOGITS, PROB, scored

SM = "(SELECT *, list_transform(list_transform(scores, lambda s: exp(s-list_max(scores))), lambda e: e/list_sum(list_transform(scores, lambda s: exp(s-list_max(scores))))) AS prob FROM score)"


@query("softmax_argmax", f"SELECT item_id, CAST(list_position(prob, list_max(prob))-1 AS INT) AS decision, round(list_max(prob),6) AS top, gt_class FROM {SM}")
def _(v):
    s = v.score.withColumn("prob", decide.softmax(F.col("scores")))
    return s.select("item_id", decide.argmax(F.col("prob")).alias("decision"), F.round(F.array_max("prob"), 6).alias("top"), "gt_class")


@query("floor_decision", f"SELECT item_id, y, x, CASE WHEN p1>=ct AND p2>=st THEN CASE WHEN p2>p1 THEN 2 ELSE 1 END WHEN p1>=ct THEN 1 WHEN p2>=st THEN 2 ELSE 0 END AS decision FROM {PROB} s, (SELECT crack_threshold AS ct, scratch_threshold AS st FROM profile WHERE is_active AND material_code='1-URGENT') p")
def _(v):
    return decide.decide_with_profile(scored(v), v.profile.where("is_active AND material_code='1-URGENT'")).select("item_id", "y", "x", "decision")


@query("array_signature64", "SELECT vec_id AS item_id, array_to_string(list_transform(e, lambda x: CASE WHEN x>(s[32]+s[33])/2 THEN '1' ELSE '0' END),'') AS bits FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_sort(CAST(embedding AS DOUBLE[])) AS s FROM embeddings)")
def _(v):
    return v.embeddings.select(F.col("vec_id").alias("item_id"), decide.signature(F.expr("transform(embedding, e -> CAST(e AS DOUBLE))")).alias("bits"))


@query("view_average", f"WITH l AS (SELECT item_id, y, x, {LOGITS} AS l, v FROM pixel), a AS (SELECT item_id, y, x, c AS class, l[c+1] AS score FROM l, (VALUES (0),(1),(2)) t(c) UNION ALL SELECT item_id, y, x, c, l[c+1]*(1+c*0.1::DOUBLE) FROM l, (VALUES (0),(1),(2)) t(c)), m AS (SELECT item_id, y, x, class, round(avg(score),9) AS score FROM a GROUP BY 1,2,3,4) SELECT item_id, y, x, class, score FROM m QUALIFY row_number() OVER (PARTITION BY item_id, y, x ORDER BY score DESC, class)=1")
def _(v):
    logits = F.array(F.lit(0.2), F.expr("v*(1+x%2*0.5D)"), F.expr("v*(1+y%2*0.5D)"))
    long = v.pixel.select("item_id", "y", "x", F.posexplode(logits).alias("class", "score"))
    plain = long.withColumn("view", F.lit("plain"))
    flip = long.withColumn("x", 7 - F.col("x")).withColumn("score", F.col("score") * (1 + F.col("class") * 0.1)).withColumn("view", F.lit("flip"))
    return decide.view_average(plain.unionByName(flip), 8)


# --- neighbours, lengths, widths -------------------------------------------------------------
NB = "JOIN (VALUES (0,1,false),(1,0,false),(1,1,true),(1,-1,true)) o(dy,dx,diagonal) ON true JOIN {0} b ON b.item_id=a.item_id AND b.y=a.y+dy AND b.x=a.x+dx"


@query("pixel_neighbours", f"SELECT a.item_id, a.y, a.x, b.y AS y2, b.x AS x2, diagonal FROM pixel a {NB.format('pixel')} WHERE a.pred=1 AND b.pred=1")
def _(v):
    return geometry.neighbour_pairs(v.pixel.where("pred=1").select("item_id", "y", "x"), ["item_id"])


@query("arc_length", f"WITH s AS (SELECT item_id, y, x FROM pixel WHERE skel_pred=1), n AS (SELECT a.item_id, count(*) FILTER (WHERE NOT diagonal) AS o, count(*) FILTER (WHERE diagonal) AS d FROM s a {NB.format('s')} GROUP BY 1) SELECT t.item_id, skeleton_px, round(CASE WHEN coalesce(o,0)+coalesce(d,0)=0 THEN 1.0 ELSE o+d*sqrt(2.0::DOUBLE) END,2) AS length_px FROM (SELECT item_id, count(*) AS skeleton_px FROM s GROUP BY 1) t LEFT JOIN n ON n.item_id=t.item_id")
def _(v):
    return geometry.arc_length(v.pixel.where("skel_pred=1").select("item_id", "y", "x"), ["item_id"])


@query("max_width", "SELECT item_id, round(2*max(half_width),6) AS max_width_px, round(2*avg(half_width),6) AS mean_width_px FROM pixel WHERE skel_pred=1 GROUP BY 1")
def _(v):
    return geometry.widths(v.pixel.where("skel_pred=1"), ["item_id"])


# --- regions -----------------------------------------------------------------------------------
CC = """WITH RECURSIVE m AS (SELECT item_id, CASE WHEN (y//3)%2=0 THEN 1 ELSE 2 END AS class, y, x, y*100+x AS id FROM pixel WHERE pred=1 OR v>0.1),
 e AS (SELECT a.item_id, a.class, a.id AS i, b.id AS j FROM m a JOIN m b ON a.item_id=b.item_id AND a.class=b.class AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1),
 reach AS (SELECT item_id, class, id AS root, id FROM m UNION SELECT r.item_id, r.class, r.root, e.j FROM reach r JOIN e ON e.item_id=r.item_id AND e.class=r.class AND e.i=r.id),
 lab AS (SELECT m.item_id, m.class, m.y, m.x, r.root FROM m JOIN (SELECT item_id, class, id, min(root) AS root FROM reach GROUP BY 1,2,3) r ON r.item_id=m.item_id AND r.class=m.class AND r.id=m.id)"""


def mask(v):
    return v.pixel.where("pred=1 OR v>0.1").select("item_id", F.expr("CASE WHEN (y div 3)%2=0 THEN 1 ELSE 2 END").alias("class"), "y", "x")


def first_pixel(labelled):
    """The label as its first pixel, y * 100 + x."""
    return labelled.withColumn("region", F.expr("(region div 4294967296)*100 + region%4294967296"))


@query("region_label", f"{CC} SELECT item_id, class, y, x, CAST(root AS BIGINT) AS region FROM lab")
def _(v):
    return first_pixel(geometry.label_regions(mask(v), ["item_id", "class"]))


MEAS = "SELECT item_id, class, CAST(root AS BIGINT) AS region, count(*) AS area_px, min(x) AS bbox_x, min(y) AS bbox_y, max(x)-min(x)+1 AS bbox_width, max(y)-min(y)+1 AS bbox_height, round(avg(x),6) AS centroid_x, round(avg(y),6) AS centroid_y FROM lab GROUP BY 1,2,3"


def measured(v):
    return geometry.measure_regions(first_pixel(geometry.label_regions(mask(v), ["item_id", "class"])), ["item_id", "class"])


@query("region_measure", f"{CC} {MEAS}")
def _(v):
    return measured(v)


@query("region_floor", f"{CC}, ms AS ({MEAS}) SELECT item_id, class, region, area_px, CAST(row_number() OVER (PARTITION BY item_id ORDER BY class, region) AS INT) AS region_index FROM ms WHERE area_px>=4 AND bbox_width>=3")
def _(v):
    regions = measured(v).withColumn("skeleton_px", F.col("bbox_width"))
    return geometry.floor_regions(regions, "item_id", ["class", "region"], 4, 3).select("item_id", "class", "region", "area_px", "region_index")


# --- tiles and polygons ----------------------------------------------------------------------------
def axis(n: str, size: int, stride: int) -> str:
    return f"CASE WHEN {n}<={size} THEN [0::BIGINT] ELSE list_distinct(list_concat(range(0,{n}-{size}+1,{stride}),[({n}-{size})::BIGINT])) END"


@query("tile_origins", f"SELECT name, y, unnest({axis('w', 96, 64)}) AS x FROM (SELECT name, w, unnest({axis('h', 96, 64)}) AS y FROM manifest)")
def _(v):
    return geometry.tile_origins(v.manifest, "name", 96, 64)


TILES = "(VALUES (0),(3),(4)) ty(tile_y), (VALUES (0),(3),(4)) tx(tile_x) WHERE y>=tile_y AND y<tile_y+4 AND x>=tile_x AND x<tile_x+4"


def covered(v):
    return geometry.covering_tiles(v.pixel.select("item_id", "y", "x", "v"), F.lit(8), F.lit(8), 4, 3)


@query("tile_pixel_expand", f"SELECT item_id, CAST(tile_y AS BIGINT) AS tile_y, CAST(tile_x AS BIGINT) AS tile_x, count(*) AS pixels FROM pixel, {TILES} GROUP BY 1,2,3")
def _(v):
    return covered(v).groupBy("item_id", "tile_y", "tile_x").agg(F.count("*").alias("pixels"))


@query("tile_overlap_mean", f"WITH c AS (SELECT item_id, y, x, v, tile_y, tile_x FROM pixel, {TILES}), t AS (SELECT item_id, tile_y, tile_x, max(v) AS s FROM c GROUP BY 1,2,3) SELECT c.item_id, y, x, round(avg(s),6) AS score, count(*) AS hits FROM c JOIN t ON t.item_id=c.item_id AND t.tile_y=c.tile_y AND t.tile_x=c.tile_x GROUP BY 1,2,3")
def _(v):
    c = covered(v)
    scores = c.groupBy("item_id", "tile_y", "tile_x").agg(F.max("v").alias("tile_score"))
    return geometry.tile_overlap_mean(c.drop("v"), scores)


@query("polygon_area", "SELECT item_id, CASE WHEN count(*)>=3 THEN round(abs(sum(px*ny-nx*py))/2,6) END AS area FROM (SELECT item_id, px, py, coalesce(lead(px) OVER w, first_value(px) OVER w) AS nx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS ny FROM (SELECT item_id, y*8+x AS k, x*10.0::DOUBLE AS px, y+half_width AS py FROM pixel WHERE gt=1) WINDOW w AS (PARTITION BY item_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1")
def _(v):
    point = F.struct(F.expr("y*8+x").alias("k"), F.expr("x*10.0D").alias("x"), F.expr("y+half_width").alias("y"))
    rings = v.pixel.where("gt=1").groupBy("item_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return rings.select("item_id", F.round(geometry.polygon_area(F.col("p")), 6).alias("area"))
