"""Segmentation metrics from a sparse pixel table (item_id, y, x, gt, pred, skel_gt, skel_pred).

Every metric is a sum over pixels per item, then a mean over items; nothing but one row per
item ever meets in a task. Positives and negatives are two populations: overlap metrics are
averaged over items with ground truth, false-positive numbers over items without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fettle.functions.columns import n_where, ratio

EPS = 1e-7
FP_SHARE = 0.0005
MIN_TRUSTWORTHY = 25


def ellipse(tol: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element of radius ``tol``."""
    out = []
    for dy in range(-tol, tol + 1):
        half = round(tol * max(0.0, 1 - (dy / tol) ** 2) ** 0.5) if tol else 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def _on(c: str) -> Column:
    return F.col(c) > 0


def item_counts(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per item: hits, misses, sizes and skeleton overlaps, in one aggregation."""
    p, g = _on("pred"), _on("gt")
    return pixels.groupBy("item_id", *(keys or [])).agg(
        n_where(p & g).alias("tp"), n_where(p & ~g).alias("fp"), n_where(~p & g).alias("fn"),
        n_where(p).alias("pred_px"), n_where(g).alias("gt_px"), F.count("*").alias("n_px"),
        n_where(_on("skel_pred")).alias("skel_pred"), n_where(_on("skel_pred") & g).alias("skel_pred_hit"),
        n_where(_on("skel_gt")).alias("skel_gt"), n_where(_on("skel_gt") & p).alias("skel_gt_hit"),
    )


def iou() -> Column:
    return F.col("tp") / F.greatest(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)).cast("double")


def dice() -> Column:
    return 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)).cast("double")


def _agreement(precision: Column, recall: Column) -> Column:
    """Harmonic mean with the rule for empty masks: both empty 1, one empty 0."""
    no_p, no_g = F.col("pred_px") == 0, F.col("gt_px") == 0
    return F.when(no_p & no_g, 1.0).when(no_p | no_g, 0.0).otherwise(2 * precision * recall / (precision + recall + EPS))


def cl_dice() -> Column:
    return _agreement(F.col("skel_pred_hit") / (F.col("skel_pred") + EPS), F.col("skel_gt_hit") / (F.col("skel_gt") + EPS))


def tolerant_f1() -> Column:
    return _agreement(F.col("near_pred") / (F.col("pred_px") + EPS), F.col("near_gt") / (F.col("gt_px") + EPS))


WORD = 64


def half_widths(tol: int) -> dict[int, int]:
    """Of each row distance in the element, how far it reaches along the row."""
    return {dy: max(dx for y, dx in ellipse(tol) if y == dy) for dy in range(-tol, tol + 1)}


def packed_near(pixels: DataFrame, tol: int, keys: list[str] | None = None) -> DataFrame:
    """Foreground by image row and word of 64 pixels: ``p`` and ``g`` as bits, and ``near_p``, ``near_g``, those dilated by ``tol``.

    Dilation is a matter of shifts along a row (bits that leave a word make a row for the neighbour) and of the rows above and
    below, taken by a window. A word moves once, whatever the tolerance.
    """
    if not 0 <= tol < WORD:
        raise ValueError(f"the tolerance must be under {WORD} pixels")
    on, reach = ["item_id", *(keys or [])], half_widths(tol)
    widths = sorted(set(reach.values()))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(x, {WORD}) AS INT))")
    words = pixels.where(_on("pred") | _on("gt")).groupBy(*on, "y", F.floor(F.col("x") / WORD).cast("int").alias("w")).agg(
        *[F.coalesce(F.bit_or(F.when(_on(c), bit)), F.lit(0).cast("bigint")).alias(n) for c, n in (("pred", "p"), ("gt", "g"))])

    def spread(c: str, h: int, step: int) -> Column:
        """What the word's bits set in the word itself (step 0) or in the one before (-1) or after (1) when dilated by ``h``."""
        if step:
            far = range(WORD - h, WORD)
            moves = [F.shiftrightunsigned(c, k) if step > 0 else F.shiftleft(c, k) for k in far]
        else:
            moves = [F.col(c), *[m for k in range(1, h + 1) for m in (F.shiftleft(c, k), F.shiftrightunsigned(c, k))]]
        out = F.lit(0).cast("bigint")
        for m in moves:
            out = out.bitwiseOR(m)
        return out

    def part(step: int) -> Column:
        own = [F.col(c) if step == 0 else F.lit(0).cast("bigint") for c in "pg"]
        return F.struct((F.col("w") + step).alias("w"), own[0].alias("p"), own[1].alias("g"), *[spread(c, h, step).alias(f"{c}{h}") for h in widths for c in "pg"])

    names = ["p", "g", *[f"{c}{h}" for h in widths for c in "pg"]]
    parts = words.select(*on, "y", F.explode(F.array(part(0), part(-1), part(1))).alias("s")).select(*on, "y", "s.*")
    some = parts.where(" OR ".join(f"{n} <> 0" for n in names))
    rows = some.groupBy(*on, "y", "w").agg(*[F.bit_or(n).alias(n) for n in names])
    column = W.partitionBy(*on, "w").orderBy("y")

    def near(c: str) -> Column:
        out = F.lit(0).cast("bigint")
        for dy, h in reach.items():
            out = out.bitwiseOR(F.coalesce(F.max(f"{c}{h}").over(column.rangeBetween(dy, dy)), F.lit(0)))
        return out

    return rows.select(*on, "y", "w", "p", "g", near("p").alias("near_p"), near("g").alias("near_g")).where("p <> 0 OR g <> 0")


def near_flags(pixels: DataFrame, tol: int, keys: list[str] | None = None) -> DataFrame:
    """Foreground pixels with flags: is the other mask within ``tol``?"""
    packed = packed_near(pixels, tol, keys).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))))
    bits = {"is_pred": "p", "is_gt": "g", "pred_near": "near_p", "gt_near": "near_g"}
    flags = [F.expr(f"getbit({c}, b) = 1").alias(n) for n, c in bits.items()]
    return packed.select("item_id", *(keys or []), "y", (F.col("w") * WORD + F.col("b")).alias("x"), *flags).where("is_pred OR is_gt")


def near_counts(pixels: DataFrame, tol: int, keys: list[str] | None = None) -> DataFrame:
    both = lambda a, b: F.sum(F.bit_count(F.col(a).bitwiseAND(F.col(b)))).cast("bigint")
    return packed_near(pixels, tol, keys).groupBy("item_id", *(keys or [])).agg(both("p", "near_g").alias("near_pred"), both("g", "near_p").alias("near_gt"))


def item_metrics(pixels: DataFrame, tol: int = 2, keys: list[str] | None = None) -> DataFrame:
    """One row per item with all its metrics."""
    on = ["item_id", *(keys or [])]
    joined = item_counts(pixels, keys).join(near_counts(pixels, tol, keys), on, "left").fillna(0, ["near_pred", "near_gt"])
    return joined.select(*on, "tp", "fp", "fn", "pred_px", "gt_px", "n_px", iou().alias("iou"), dice().alias("dice"),
                         cl_dice().alias("cldice"), tolerant_f1().alias("tf1"))


def summary_columns() -> list[Column]:
    pos, neg = F.col("gt_px") > 0, F.col("gt_px") == 0
    flagged = neg & (F.col("pred_px") > FP_SHARE * F.col("n_px"))

    def mean(c: str) -> Column:
        return F.round(F.avg(F.when(pos, F.col(c))), 6).alias(c)

    return [
        mean("iou"), mean("dice"), mean("cldice"), mean("tf1"),
        F.round(n_where(pos & (F.col("tp") > 0)) / F.greatest(n_where(pos), F.lit(1)), 6).alias("detect_rate"),
        F.round(F.avg(F.when(neg, F.col("pred_px") / F.col("n_px"))), 6).alias("fp_area"),
        F.round(n_where(flagged) / F.greatest(n_where(neg), F.lit(1)), 6).alias("fp_image_rate"),
        n_where(pos).alias("n_pos"), n_where(neg).alias("n_neg"),
    ]


def evaluate(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    return items.groupBy(*(by or [])).agg(*summary_columns())


def as_binary(pixels: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """Each class as a binary problem of its own, marked by ``class``."""
    cls = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    wide = pixels.select("item_id", "y", "x", "gt", "pred", "skel_gt", "skel_pred", cls)
    is_gt, is_pred = F.col("gt") == F.col("class"), F.col("pred") == F.col("class")
    return wide.select(
        "item_id", "y", "x", "class", is_gt.cast("int").alias("gt"), is_pred.cast("int").alias("pred"),
        (is_gt & _on("skel_gt")).cast("int").alias("skel_gt"), (is_pred & _on("skel_pred")).cast("int").alias("skel_pred"))


def predict_nothing(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("pred", F.lit(0)).withColumn("skel_pred", F.lit(0))


def class_confusion(pixels: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Counts over true defect pixels only: row = true class, one column per predicted class."""
    defect = pixels.where(_on("gt"))
    return defect.groupBy("gt").agg(*[n_where(F.col("pred") == c).alias(f"pred_{c}") for c in classes])


def class_recall(confusion: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    hit = F.coalesce(*[F.when(F.col("gt") == c, F.col(f"pred_{c}")) for c in classes])
    total = sum((F.col(f"pred_{c}") for c in classes), F.lit(0))
    return confusion.select("gt", F.round(ratio(hit, total), 6).alias("recall"))


def per_group(items: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Metrics per material or source, with a flag where too few items back them."""
    joined = items.join(groups, "item_id")
    return evaluate(joined, [by]).withColumn("too_small", F.col("n_pos") < MIN_TRUSTWORTHY)


def weighted_vs_macro(grouped: DataFrame, metric: str = "cldice", weight: str = "n_pos") -> DataFrame:
    """The item-weighted mean against the mean with every group equal."""
    kept = grouped.where(F.col(metric).isNotNull())
    return kept.agg(
        F.round(F.sum(F.col(weight) * F.col(metric)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0)), 6).alias("weighted"),
        F.round(F.avg(metric), 6).alias("macro"))


def surface_stats(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Mean, population deviation and variance of the Laplacian per item (edges mirrored)."""
    row, column = W.partitionBy("item_id", "y").orderBy("x"), W.partitionBy("item_id", "x").orderBy("y")
    left, right = F.lag(value).over(row), F.lead(value).over(row)
    up, down = F.lag(value).over(column), F.lead(value).over(column)
    sides = pixels.select("item_id", value, left.alias("l"), right.alias("r"), up.alias("u"), down.alias("d"))
    total = F.coalesce("l", "r") + F.coalesce("r", "l") + F.coalesce("u", "d") + F.coalesce("d", "u")
    lap = sides.withColumn("lap", total - 4 * F.col(value))
    return lap.groupBy("item_id").agg(
        F.round(F.avg(value), 6).alias("brightness"), F.round(F.stddev_pop(value), 6).alias("contrast"), F.round(F.var_pop("lap"), 6).alias("blur"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two score tables (item_id, part, scores): largest difference, worst share of equal decisions."""
    both = left.select("item_id", "part", F.col("scores").alias("a")).join(right.select("item_id", "part", F.col("scores").alias("b")), ["item_id", "part"])
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    same = F.array_position("a", F.array_max("a")) == F.array_position("b", F.array_max("b"))
    per = both.groupBy("part").agg(F.max(gap).alias("gap"), F.avg(same.cast("double")).alias("agree"))
    return per.agg(F.round(F.max("gap"), 6).alias("max_abs_diff"), F.round(F.min("agree"), 6).alias("argmax_agreement"))
