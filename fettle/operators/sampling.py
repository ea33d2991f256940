"""Draw plans: which row each sample slot takes, fixed by digests instead of a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.functions.columns import draw_hash, n_where, unit_draw
from fettle.operators.ranking import row_number_by_hash, running
from fettle.session import settle


def _draw(seed: int, part: str, slot: str) -> Column:
    return unit_draw(draw_hash(F.lit(f"{seed}{part}"), slot))


def indexed(rows: DataFrame, pool: str, key: str, seed: int) -> DataFrame:
    """Rows with a 0-based index within their pool, in draw order."""
    drawn = rows.withColumn("__d", draw_hash(seed, key))
    ranked = row_number_by_hash(drawn, [pool], "__d", key, "__rn")
    return ranked.withColumn("idx", F.col("__rn") - 1).drop("__d", "__rn")


def _fill(slots: DataFrame, rows: DataFrame, pool: str, key: str, seed: int) -> DataFrame:
    """Give each slot (slot, pool) the row at a drawn index of its pool.

    Pool and index together name one row, so no pool, however large, meets in one task.
    """
    sizes = rows.groupBy(pool).agg(F.count("*").alias("__n"))
    placed = slots.join(sizes, pool).withColumn("idx", F.floor(_draw(seed, "row", "slot") * F.col("__n")))
    return placed.join(indexed(rows.select(pool, key), pool, key, seed), [pool, "idx"]).drop("__n", "idx")


def quota_sampler(slots: DataFrame, rows: DataFrame, key: str, pos_frac: float, scratch_frac: float, seed: int) -> DataFrame:
    """Slots filled by pool quota: positives at ``pos_frac``, scratches at ``scratch_frac`` of those.

    ``rows`` carries pool crack, scratch or negative.
    """
    positive = _draw(seed, "pos", "slot") < pos_frac
    pool = F.when(positive, F.when(_draw(seed, "cls", "slot") < scratch_frac, "scratch").otherwise("crack")).otherwise("negative")
    return _fill(slots.withColumn("pool", pool), rows, "pool", key, seed)


def mix_synth(slots: DataFrame, synth_frac: float, seed: int, split: str = "train") -> DataFrame:
    """Mark the slots a synthetic sample fills; synthetic data never enters evaluation."""
    if split != "train":
        raise ValueError("synthetic data must never enter val/test")
    return slots.withColumn("synthetic", _draw(seed, "syn", "slot") < synth_frac)


def group_balanced(slots: DataFrame, rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Every group gets the same weight, whatever its size. Rows without a group are not drawn.

    Groups are numbered in a table, and a slot meets its group on the number it draws.
    """
    groups = rows.where(F.col(group).isNotNull()).select(group).distinct()
    numbered = settle(running(groups, [], [F.col(group).asc()], {}, "__no"), "numbered-groups")
    drawn = slots.withColumn("__no", F.floor(_draw(seed, "grp", "slot") * numbered.agg(F.count("*")).scalar()) + 1)
    return _fill(drawn.join(numbered, "__no").drop("__no"), rows, group, key, seed)


def sample_plan(slots: DataFrame, rows: DataFrame, group: str, key: str, n_crack: int, seed: int) -> DataFrame:
    """Provenance of each planned sample: kind by position, background by balanced draw."""
    kind = F.when(F.col("slot") < n_crack, "crack").otherwise("negative")
    plan = group_balanced(slots, rows, group, key, seed).withColumn("kind", kind)
    return plan.select(
        F.format_string("%s_%07d", "kind", "slot").alias("patch_id"), "kind", group, F.col(key).alias("bg_id"),
        F.lit(seed).alias("rng_seed"), F.col("slot").alias("sample_index"))


def eval_interleave(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Fixed evaluation order: positives at even places, negatives at odd ones.

    The order has n_pos + min(n_neg, n_pos) places; a short negative pool repeats. With one
    pool empty the other is walked in order.
    """
    spark = rows.sparkSession
    p, n = rows.agg(n_where(F.col("pool") == "positive"), n_where(F.col("pool") == "negative")).first()
    place = F.col("place")
    if p and n:
        places = spark.range(p + min(p, n)).withColumnRenamed("id", "place")
        even = place % 2 == 0
        turn = F.floor(place / 2)
        wanted = places.select("place", F.when(even, "positive").otherwise("negative").alias("pool"), F.when(even, turn % p).otherwise(turn % n).cast("bigint").alias("idx"))
    else:
        wanted = spark.range(p + n).select(F.col("id").alias("place"), F.lit("positive" if p else "negative").alias("pool"), F.col("id").alias("idx"))
    ranked = indexed(rows, "pool", key, seed).select("pool", F.col("idx").cast("bigint").alias("idx"), key)
    return wanted.join(ranked, ["pool", "idx"]).select(key, "pool", "place")
