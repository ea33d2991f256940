"""Grouped, stratified, leak-free split assignment.

Every rule yields a nullable split; the first that applies wins. Draws are ordered by the
digest of seed and key, so an assignment depends on neither partitioning nor file order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.functions.columns import draw_hash, hex32, unit_draw
from fettle.operators.ranking import row_number_by_hash, row_number_by_value
from fettle.session import settle


@dataclass(frozen=True)
class SplitRules:
    unseen_material: str = "wood"
    unseen_val_material: str = "masonry"
    factory_materials: tuple[str, ...] = ("steel", "metal", "plastic", "ceramic", "epoxy", "glass")
    eval_only_sources: tuple[str, ...] = ("kolektor1", "mvtec")
    split_source: str = "sdx"
    quarantined: str = "mvtec_scratch"
    train: float = 0.80
    val: float = 0.15
    test: float = 0.05
    substrate: float = 0.70
    seed: int = 20260804
    role_tests: dict[str, str] = field(default_factory=lambda: {"positive": "test_factory", "scratch": "test_factory_scratch"})


def route_holdouts(rules: SplitRules) -> Column:
    """Unseen-material positives and the quarantined sub-source; null elsewhere."""
    cracked = F.col("role") == "positive"
    return (
        F.when(F.col("subsource") == rules.quarantined, "test_scratch_blob")
        .when(cracked & (F.col("material") == rules.unseen_val_material), "val_unseen_material")
        .when(cracked & (F.col("material") == rules.unseen_material), "test_unseen_material")
    )


def clean_groups(manifest: DataFrame, rules: SplitRules) -> DataFrame:
    """Groups of the unseen material without a single positive: a set difference by counting."""
    per = manifest.where(F.col("material") == rules.unseen_material).groupBy("grp").agg(
        F.max((F.col("role") == "positive").cast("int")).alias("cracked"))
    return per.where(F.col("cracked") == 0).select("grp")


def substrate_groups(manifest: DataFrame, rules: SplitRules) -> DataFrame:
    """Clean groups with their side: the first 70 % in draw order are substrate."""
    drawn = clean_groups(manifest, rules).withColumn("__d", draw_hash(rules.seed, "grp"))
    ranked = row_number_by_hash(drawn, [], "__d", "grp", "__rn", total="__n")
    side = F.when(F.col("__rn") <= F.floor(F.col("__n") * rules.substrate), "wood_bg").otherwise("test_negatives")
    return ranked.select("grp", side.alias("substrate_split"))


def source_split_groups(manifest: DataFrame, rules: SplitRules) -> DataFrame:
    """The one source that every side needs, split by group within each defect role."""
    rows = manifest.where((F.col("source") == rules.split_source) & F.col("role").isin(*rules.role_tests))
    drawn = rows.select("role", "grp").distinct().withColumn("__d", draw_hash(rules.seed, "grp"))
    ranked = row_number_by_hash(drawn, ["role"], "__d", "grp", "__rn", total="__n")
    n_train, n_val = F.bround(F.col("__n") * rules.train), F.bround(F.col("__n") * rules.val)
    test = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, name in rules.role_tests.items():
        test = test.when(F.col("role") == role, name)
    side = F.when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_train + n_val, "val").otherwise(test)
    return ranked.select("role", "grp", side.alias("source_split"))


def route_eval_only(rules: SplitRules) -> Column:
    home = F.when(F.col("material").isin(*rules.factory_materials), "test_factory").otherwise("test_seen")
    return F.when(F.col("source").isin(*rules.eval_only_sources), F.when(F.col("role") != "positive", "test_negatives").otherwise(home))


def group_stats(rows: DataFrame) -> DataFrame:
    """Group -> first material by name, mean foreground, size."""
    return rows.groupBy("grp").agg(
        F.min_by("material", "name").alias("material"), F.round(F.avg("crack_px_frac"), 9).alias("fg"), F.count("*").alias("n"))


def with_fg_quartile(stats: DataFrame) -> DataFrame:
    """Quartile of the foreground rank, cut the way a quantile cut of ranks falls; equal means rank by name."""
    ranked = row_number_by_value(stats, [], [F.col("fg"), F.col("grp")], "fg", "__rn", total="__n", tie_text="grp")
    cut = F.ceil((F.col("__rn") - 1) * 4 / F.nullif((F.col("__n") - 1).cast("double"), F.lit(0.0))) - 1
    bucket = F.coalesce(F.least(F.greatest(cut, F.lit(0)), F.lit(3)), F.lit(0)).cast("int")
    return ranked.withColumn("fgb", bucket).drop("__rn", "__n")


def stratified_assign(stats: DataFrame, rules: SplitRules) -> DataFrame:
    """Whole groups to train, val or test within each material and quartile."""
    drawn = stats.withColumn("__d", draw_hash(rules.seed, "grp"))
    ranked = row_number_by_hash(drawn, ["material", "fgb"], "__d", "grp", "__rn", total="__n")
    n = F.col("__n")
    n_train = F.least(F.greatest(F.lit(1.0), F.bround(n * rules.train)), n - 2)
    n_val = F.greatest(F.lit(1.0), F.bround(n * rules.val))
    side = (
        F.when(n < 3, "train").when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_train + n_val, "val").otherwise("test")
    )
    return ranked.select("grp", "material", "fgb", side.alias("group_split"))


def negative_draw(rules: SplitRules) -> Column:
    u = unit_draw(draw_hash(rules.seed, "name"))
    return F.when(u < rules.test, "test_negatives").when(u < rules.test + rules.val, "val").otherwise("train")


def assign(manifest: DataFrame, rules: SplitRules) -> DataFrame:
    """The full first-match routing; adds ``split``.

    Joins bring one row per group to the manifest, so a hot group is only ever on the big
    side, where adaptive execution splits it. The routed rows and the group table are written
    to the shared folder between stages, so later passes never return to the raw corpus; pass
    only the columns you need.
    """
    board = substrate_groups(manifest, rules)
    own = source_split_groups(manifest, rules)
    on_unseen = F.col("material") == rules.unseen_material
    routed = manifest.join(own, ["role", "grp"], "left").join(board, "grp", "left")
    early = F.coalesce(
        F.when(F.col("source") == rules.split_source, F.col("source_split")),
        route_holdouts(rules),
        F.when(on_unseen, F.coalesce("substrate_split", F.lit("test_negatives"))),
        route_eval_only(rules),
    )
    staged = settle(routed.withColumn("__early", early).drop("source_split", "substrate_split"), "routed")
    rest_pos = staged.where(F.col("__early").isNull() & (F.col("role") == "positive"))
    stats = settle(with_fg_quartile(settle(group_stats(rest_pos), "groups")), "quartiles")
    groups = stratified_assign(stats, rules).select("grp", "group_split")
    held = (
        F.when(F.col("group_split") == "val", "val")
        .when(F.col("group_split") == "test",
              F.when(F.col("material").isin(*rules.factory_materials), "test_factory").otherwise("test_seen"))
        .otherwise("train")
    )
    negative = F.when(F.col("group_split") == "test", "test_negatives").otherwise(negative_draw(rules))
    late = F.when(F.col("role") == "positive", held).otherwise(negative)
    out = staged.join(groups, "grp", "left").withColumn("split", F.coalesce("__early", late))
    return out.drop("__early", "group_split")


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    return df.where(hex32(draw_hash(seed, key)) < int(share * 4294967296))
