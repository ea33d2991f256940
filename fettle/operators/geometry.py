"""Regions on sparse pixel tables: neighbours, components, measures, tiles, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fettle.functions.columns import n_where
from fettle.session import Rounds, settle

# Forward half of the 8-neighbourhood; the last two are diagonal.
FORWARD = ((0, 1), (1, 0), (1, 1), (1, -1))


def neighbour_pairs(mask: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Adjacent pixel pairs of one mask, each once: an equi-join on the shifted cell.

    A pixel has at most four forward partners, so the output is linear in the mask.
    """
    carry = carry or []
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(bool(dy and dx)).alias("diagonal")) for dy, dx in FORWARD])
    left = mask.select(*keys, "y", "x", *carry, F.explode(shifts).alias("s")).select(
        *keys, "y", "x", *carry, (F.col("y") + F.col("s.dy")).alias("y2"), (F.col("x") + F.col("s.dx")).alias("x2"), F.col("s.diagonal").alias("diagonal"))
    right = mask.select(*keys, F.col("y").alias("y2"), F.col("x").alias("x2"), *[F.col(c).alias(f"{c}2") for c in carry])
    return left.join(right, [*keys, "y2", "x2"])


def arc_length(skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """Orthogonal links plus sqrt(2) per diagonal link; an isolated pixel counts 1."""
    links = neighbour_pairs(skeleton, keys).groupBy(*keys).agg(n_where(~F.col("diagonal")).alias("o"), n_where(F.col("diagonal")).alias("d"))
    every = skeleton.groupBy(*keys).agg(F.count("*").alias("skeleton_px")).join(links, keys, "left")
    length = F.coalesce("o", F.lit(0)) + F.coalesce("d", F.lit(0)) * F.sqrt(F.lit(2.0))
    return every.select(*keys, "skeleton_px", F.round(F.when(length == 0, 1.0).otherwise(length), 2).alias("length_px"))


def widths(skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """Twice the largest and twice the mean half-width along the skeleton."""
    return skeleton.groupBy(*keys).agg(
        F.round(2 * F.max("half_width"), 6).alias("max_width_px"), F.round(2 * F.avg("half_width"), 6).alias("mean_width_px"))


def with_runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Name each pixel by the horizontal run it lies in; a window spans one image row only."""
    row = W.partitionBy(*keys, "y").orderBy("x")
    starts = mask.withColumn("__new", (F.col("x") - F.lag("x").over(row) == 1))
    first = F.when(F.coalesce("__new", F.lit(False)), None).otherwise(F.col("x"))
    run_x = F.last(first, ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, 0))
    node = F.col("y").cast("bigint") * F.lit(1 << 32) + run_x
    return starts.withColumn("node", node).drop("__new")


def label_regions(mask: DataFrame, keys: list[str]) -> DataFrame:
    """8-connected components: each pixel gets the smallest node of its component.

    Pixels shrink to horizontal runs first, then run pairs are contracted: in every round a
    node links to the smallest node of its neighbourhood and follows links two steps, so long
    shapes take a logarithmic number of rounds. Each round is written to the shared folder.

    Runs and roots shrink to a hundredth in a file, so the size of a file says nothing about that of its rows: the
    joins are merges by hint, or whole tables of runs would go through the driver as broadcasts.
    """
    spark_keys = list(keys)
    runs = settle(with_runs(mask.select(*spark_keys, "y", "x"), spark_keys), "runs").hint("merge")
    pairs = neighbour_pairs(runs, spark_keys, ["node"]).where(F.col("node") != F.col("node2"))
    lo, hi = F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")
    edges = settle(pairs.select(*spark_keys, lo, hi).distinct(), "links").hint("merge")
    roots, rounds = Rounds(mask.sparkSession, "roots"), Rounds(mask.sparkSession, "hooks")
    parent = roots.settle(runs.select(*spark_keys, "node").distinct().withColumn("root", F.col("node"))).hint("merge")
    while True:  # roots only ever fall, so this ends
        ends = (
            edges.join(parent.select(*spark_keys, F.col("node").alias("a"), F.col("root").alias("ra")), [*spark_keys, "a"])
            .join(parent.select(*spark_keys, F.col("node").alias("b"), F.col("root").alias("rb")), [*spark_keys, "b"])
            .where(F.col("ra") != F.col("rb"))
        )
        hooks = ends.groupBy(*spark_keys, F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to"))
        hooks = rounds.settle(hooks).hint("merge")
        if hooks.isEmpty():
            break
        once = hooks.join(hooks.select(*spark_keys, F.col("root").alias("to"), F.col("to").alias("to2")), [*spark_keys, "to"], "left")
        jumps = once.select(*spark_keys, "root", F.coalesce("to2", "to").alias("to"))
        moved = parent.join(jumps, [*spark_keys, "root"], "left")
        parent = roots.settle(moved.select(*spark_keys, "node", F.coalesce("to", "root").alias("root"))).hint("merge")
    return runs.join(parent, [*spark_keys, "node"]).select(*spark_keys, "y", "x", F.col("root").alias("region"))


def measure_regions(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Area, bounding box and centroid of every region."""
    return labelled.groupBy(*keys, "region").agg(
        F.count("*").alias("area_px"), F.min("x").alias("bbox_x"), F.min("y").alias("bbox_y"),
        (F.max("x") - F.min("x") + 1).alias("bbox_width"), (F.max("y") - F.min("y") + 1).alias("bbox_height"),
        F.round(F.avg("x"), 6).alias("centroid_x"), F.round(F.avg("y"), 6).alias("centroid_y"))


def floor_regions(regions: DataFrame, item: str, order: list[str], min_area: int, min_skeleton: int) -> DataFrame:
    """Drop regions below the area or skeleton floor and number the rest per item."""
    kept = regions.where((F.col("area_px") >= min_area) & (F.col("skeleton_px") >= min_skeleton))
    return kept.withColumn("region_index", F.row_number().over(W.partitionBy(item).orderBy(*order)))


def axis_origins(n: Column, size: int, stride: int) -> Column:
    """Tile origins along one axis; the last one is flush with the edge."""
    last = n - size
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"), F.lit(stride).cast("bigint"))
    return F.when(n <= size, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_union(steps, F.array(last.cast("bigint"))))


def tile_origins(items: DataFrame, key: str, size: int, stride: int) -> DataFrame:
    rows = items.select(key, F.explode(axis_origins(F.col("h"), size, stride)).alias("y"), "w")
    return rows.select(key, "y", F.explode(axis_origins(F.col("w"), size, stride)).alias("x"))


def covering_tiles(pixels: DataFrame, h: Column, w: Column, size: int, stride: int) -> DataFrame:
    """Each pixel with the origins of the tiles that cover it; no join needed."""
    def cover(n: Column, at: str) -> Column:
        return F.explode(F.filter(axis_origins(n, size, stride), lambda o: (o <= F.col(at)) & (F.col(at) < o + size)))
    return pixels.withColumn("tile_y", cover(h, "y")).withColumn("tile_x", cover(w, "x"))


def tile_overlap_mean(covered: DataFrame, tile_scores: DataFrame) -> DataFrame:
    """Mean of the scores of all tiles over a pixel."""
    joined = covered.join(tile_scores, ["item_id", "tile_y", "tile_x"])
    return joined.groupBy("item_id", "y", "x").agg(F.round(F.avg("tile_score"), 6).alias("score"), F.count("*").alias("hits"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs; null below three points."""
    n = F.size(points)
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2)
