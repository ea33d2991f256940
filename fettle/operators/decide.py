"""From class scores to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Softmax of a score array, shifted by its maximum."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, e: a + e)
    return F.transform(raised, lambda e: e / total)


def argmax(scores: Column) -> Column:
    """Index of the first maximum, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def floor_decision(prob: Column, crack: Column, scratch: Column) -> Column:
    """Class under per-class floors: below both is background, above both the higher wins."""
    p1, p2 = F.element_at(prob, 2), F.element_at(prob, 3)
    crack_ok, scratch_ok = p1 >= crack, p2 >= scratch
    return (
        F.when(crack_ok & scratch_ok, F.when(p2 > p1, 2).otherwise(1)).when(crack_ok, 1).when(scratch_ok, 2).otherwise(0)
    )


def decide_with_profile(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """Apply the one profile in force to every row."""
    floors = profile.select(F.struct("crack_threshold", "scratch_threshold").alias("p")).scalar()
    return scores.withColumn("decision", floor_decision(F.col("prob"), floors["crack_threshold"], floors["scratch_threshold"]))


def signature(values: Column) -> Column:
    """Bits of an even-length vector against its median, as a 0/1 string."""
    ordered = F.array_sort(values)
    n = F.size(values)
    median = (F.element_at(ordered, (n / 2).cast("int")) + F.element_at(ordered, (n / 2).cast("int") + 1)) / 2
    return F.array_join(F.transform(values, lambda v: F.when(v > median, "1").otherwise("0")), "")


def view_average(views: DataFrame, width: int) -> DataFrame:
    """Mean class score over views, mirrored views turned back, then the best class per pixel.

    ``views`` is long: item_id, view, y, x, class, score; view ``flip`` is mirrored in x.
    """
    x = F.when(F.col("view") == "flip", width - 1 - F.col("x")).otherwise(F.col("x"))
    mean = views.groupBy("item_id", "y", x.alias("x"), "class").agg(F.round(F.avg("score"), 9).alias("score"))
    best = F.struct("score", (-F.col("class")).alias("c"))
    return mean.groupBy("item_id", "y", "x").agg(F.max_by("class", best).alias("class"), F.max("score").alias("score"))
