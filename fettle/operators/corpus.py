"""Corpus manifest: names, audits, near-duplicates, relabelling, release and fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.functions.columns import draw_hash, n_where, percent
from fettle.operators.ranking import first_n, percentiles, row_number_by_value
from fettle.schemas import TRAIN_SIDE
from fettle.session import settle

# Name prefixes that form a sub-source of their own.
SUB_PREFIXES = ("noncrack", "CRACK500", "GAPS", "cracktree", "CFD", "DeepCrack", "Rissbilder", "Volker", "Ceramic")
MASONRY_PREFIXES = ("a_", "b_", "c_", "d_")
# Limits of a usable synthesis background.
BACKGROUND_SOURCES = ("crackseg9k", "sdnet", "ozgenel", "dtd", "kolektor", "magnetic_tile", "severstal", "gc10", "wood")
MIN_SIDE, BRIGHTNESS, MIN_CONTRAST, MAX_CRUSHED = 96, (28.0, 228.0), 9.0, 0.35
FAINT_LABEL = 0.0006


def source_part(name: Column) -> Column:
    return F.substring_index(name, "__", 1)


def stem_part(name: Column) -> Column:
    cut = F.locate("__", name)
    return F.when(cut > 0, F.substr(name, cut + 2)).otherwise(name)


def subsource(name: Column) -> Column:
    """Sub-source by prefix; scratches get a sub-source of their own."""
    src, stem = source_part(name), stem_part(name)
    rule = F.when(stem.startswith("scratch_"), F.concat(src, F.lit("_scratch")))
    for prefix in SUB_PREFIXES:
        rule = rule.when(stem.startswith(prefix), prefix)
    return rule.when(F.substring(stem, 1, 2).isin(*MASONRY_PREFIXES), "masonry_abcd").otherwise(src)


def parent_id(name: Column) -> Column:
    """Group key shared by every crop of one photograph."""
    src = source_part(name)
    stem = F.coalesce(F.nullif(stem_part(name), F.lit("")), name)

    def part(pattern: str) -> Column:
        return F.regexp_extract(stem, pattern, 1)

    def keyed(*pieces: Column) -> Column:
        return F.concat(src, F.lit(":"), *pieces)

    dated, wall, board = r"^CRACK500_(\d+_\d+)", r"^(Rissbilder_for_Florian_\w+?)_\d+$", r"^([a-d]_\d+)_"
    return (
        F.when(stem.startswith("CRACK500") & stem.rlike(dated), keyed(F.lit("CRACK500:"), part(dated)))
        .when(stem.startswith("Rissbilder") & stem.rlike(wall), keyed(part(wall)))
        .when(src == "sdx", keyed(stem))
        .when(stem.rlike(board), keyed(part(board)))
        .when(src == "wood", keyed(F.substring(stem, 1, 4)))
        .when(src == "kolektor1", keyed(F.substring_index(stem, "_", 1)))
        .otherwise(keyed(F.regexp_replace(stem, r"_crop\d+$", "")))
    )


def photo_key(file_name: Column) -> Column:
    """Augmented copies share the stem before ``.rf.``."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    return F.substring_index(stem, ".rf.", 1)


def refine_material(manifest: DataFrame) -> DataFrame:
    """Relabel coarse materials; ``relabelled`` marks the rows that changed."""
    refined = (
        F.when(F.col("name").startswith("mvtec__capsule"), "pharma_capsule")
        .when(F.col("source") == "kolektor1", "epoxy")
        .when(F.col("subsource").isin("Rissbilder", "Volker"), "plaster")
        .otherwise(F.col("material"))
    )
    changed = ~refined.eqNullSafe(F.col("material"))
    return manifest.withColumn("relabelled", changed).withColumn("material", refined)


def _cracked(manifest: DataFrame) -> DataFrame:
    return manifest.where((F.col("role") == "positive") & (F.col("crack_px") > 0))


def width_audit_by_source(manifest: DataFrame) -> DataFrame:
    """Mask widths per source and the verdict that decides whether it stays."""
    pos = _cracked(manifest)
    basic = pos.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("mean_crack_width"), 6).alias("mean_w"),
        F.round(F.avg("crack_px_frac") * 100, 6).alias("fg_pct"))
    tails = percentiles(pos, ["source"], "mean_crack_width", {"median_w": 0.5, "p10": 0.1, "p90": 0.9})
    verdict = F.when(F.col("median_w") < 3.0, "skeleton").when(F.col("median_w") < 5.0, "thin").otherwise("full")
    return basic.join(tails, "source").select(
        "source", "n", "mean_w", *[F.round(c, 6).alias(c) for c in ("median_w", "p10", "p90")], "fg_pct", verdict.alias("verdict"))


def width_audit_by_subsource(manifest: DataFrame, min_cv: float = 0.05, min_median: float = 3.0) -> DataFrame:
    """Median width and its relative spread; constant or thin masks are skeletons."""
    pos = _cracked(manifest)
    w = "mean_crack_width"
    basic = pos.groupBy("subsource").agg(
        F.count("*").alias("n"), (F.stddev_samp(w) / F.greatest(F.avg(w), F.lit(1e-6))).alias("cv"))
    out = basic.join(percentiles(pos, ["subsource"], w, {"median_w": 0.5}), "subsource")
    reject = (F.col("cv") < min_cv) | ((F.col("median_w") < min_median) & (F.col("cv") < 0.25))
    return out.select("subsource", "n", F.round("median_w", 6).alias("median_w"), F.round("cv", 6).alias("cv"),
                      F.coalesce(reject, F.lit(False)).alias("reject"))


def without_skeletons(manifest: DataFrame, audit: DataFrame) -> DataFrame:
    return manifest.join(audit.where("reject").select("subsource"), "subsource", "left_anti")


def role_by_material(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("material").agg(
        F.count("*").alias("n"), *[n_where(F.col("role") == r).alias(r) for r in ("positive", "hard_negative", "negative")])


def _hashed(manifest: DataFrame) -> Column:
    return F.col("phash").isNotNull() & (F.col("phash") != "")


def duplicate_count(manifest: DataFrame) -> DataFrame:
    """Rows that share a hash with another row, summed over hash counts."""
    sizes = manifest.where(_hashed(manifest)).groupBy("phash").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n"))


def _firsts(manifest: DataFrame, order: str) -> DataFrame:
    """(r, n): the first row of each hash as a struct, and how many rows had it; a row without a hash is its own key.

    One aggregate over one scan, not a window: copies are dropped on the map side, so a group of copies of
    any size reaches a task as one row per partition.
    """
    key = F.when(_hashed(manifest), F.col("phash")).otherwise(F.concat(F.lit("row "), F.monotonically_increasing_id()))
    row = F.struct(*[F.col(c) for c in manifest.columns]).alias("r")
    return manifest.select(key.alias("k"), row).groupBy("k").agg(F.min_by("r", f"r.{order}").alias("r"), F.count("*").alias("n"))


def keep_first(manifest: DataFrame, order: str) -> DataFrame:
    """First row per hash by ``order``; rows without a hash all stay."""
    return _firsts(manifest, order).select("r.*")


def kept_report(manifest: DataFrame, order: str) -> DataFrame:
    """Row counts before and after ``keep_first``, positives by material and roles, as (section, key, n), from one pass over the manifest."""
    kept = _firsts(manifest, order).select("r.*", "n")
    cracked = F.coalesce((F.col("role") == "positive") & (F.col("crack_px") > 0), F.lit(False))
    cells = settle(kept.groupBy("material", "role", cracked.alias("cracked")).agg(F.count("*").alias("kept"), F.sum("n").alias("input")), "kept")

    def count(df: DataFrame, section: str, key: Column, n: str = "kept") -> DataFrame:
        return df.groupBy(key.alias("key")).agg(F.sum(n).alias("n")).select(F.lit(section).alias("section"), "key", "n")
    parts = [
        count(cells, "rows", F.lit("input"), "input"), count(cells, "rows", F.lit("kept")),
        count(cells.where("cracked"), "positives", F.col("material")), count(cells, "roles", F.col("role")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- split reports -----------------------------------------------------------------------
def split_report(manifest: DataFrame) -> DataFrame:
    """Per split: rows, cracks, scratches and the list of materials (a small dimension)."""
    per = manifest.groupBy("split", "material").agg(
        F.count("*").alias("n"), n_where(F.col("role") == "positive").alias("crack"), n_where(F.col("role") == "scratch").alias("scratch"))
    return per.groupBy("split").agg(
        F.sum("n").alias("n"), F.sum("crack").alias("crack"), F.sum("scratch").alias("scratch"),
        F.array_join(F.sort_array(F.collect_list("material")), ",").alias("materials"))


def material_split_crosstab(manifest: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    defects = manifest.where(F.col("role").isin("positive", "scratch"))
    return defects.groupBy("material").agg(*[n_where(F.col("split") == s).alias(s) for s in splits])


def rows_per_split(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "split")


def fingerprint(manifest: DataFrame) -> DataFrame:
    """Order-free fingerprint of the name -> split map: summed digest lanes, no sorted list."""
    digest = F.md5(F.concat_ws("=", "name", "split"))
    def lane(i: int) -> Column:
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
        return (F.sum(part) % F.lit(2147483647)).cast("bigint").alias(f"lane{i}")
    return manifest.agg(F.count("*").alias("n"), *[lane(i) for i in range(4)])


def class_weights(manifest: DataFrame, cap: float = 6.0) -> DataFrame:
    """Inverse class frequencies relative to background, clipped to 1..cap."""
    roles = manifest.agg(
        F.greatest(n_where(~F.col("role").isin("positive", "scratch")), F.lit(1)).alias("background"),
        F.greatest(n_where((F.col("role") == "positive") & (F.col("crack_px") > 0)), F.lit(1)).alias("crack"),
        F.greatest(n_where((F.col("role") == "scratch") & (F.col("crack_px") > 0)), F.lit(1)).alias("scratch"))
    def weight(c: str) -> Column:
        return F.round(F.least(F.greatest(F.col("background") / F.col(c), F.lit(1.0)), F.lit(cap)), 6).alias(f"w_{c}")
    return roles.select("background", "crack", "scratch", weight("background"), weight("crack"), weight("scratch"))


def merge_stats(stats: DataFrame, index: DataFrame, key: str = "name") -> DataFrame:
    """Left merge; columns both sides have keep the measured value, the index's get ``_raw``."""
    clash = [c for c in index.columns if c != key and c in stats.columns]
    renamed = index.select(*[F.col(c).alias(f"{c}_raw") if c in clash else F.col(c) for c in index.columns])
    return stats.join(renamed, key, "left")


# --- licences and release --------------------------------------------------------------------
def with_licence(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """Licence and image flag per row; an unregistered source is restricted."""
    reg = registry.select("source", F.col("licence").alias("__l"), F.col("redistribute").alias("__r"))
    return manifest.join(reg, "source", "left").withColumn("licence", F.coalesce("__l", F.lit("unregistered"))).withColumn(
        "images_included", F.coalesce("__r", F.lit(False))).drop("__l", "__r")


def licence_table(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per source: counted first, so the registry meets a few rows only."""
    return with_licence(manifest.groupBy("source").agg(F.count("*").alias("rows")), registry)


def open_share(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    t = licence_table(manifest, registry)
    sums = t.agg(F.coalesce(F.sum(F.when(F.col("images_included"), F.col("rows"))), F.lit(0)).alias("n_open"), F.sum("rows").alias("n"))
    return sums.withColumn("open_pct", percent("n_open", "n"))


def licence_json(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    t = licence_table(manifest, registry)
    body = F.to_json(F.struct("licence", F.col("images_included").alias("images_redistributed"), "rows"))
    return t.select("source", body.alias("json"))


def sample_per_source(manifest: DataFrame, n: int, seed: int = 0) -> DataFrame:
    drawn = manifest.withColumn("__d", draw_hash(seed, "name"))
    return first_n(drawn, ["source"], [F.col("__d"), F.col("name")], n, "name").drop("__d", "rn")


def cap_per_group(df: DataFrame, groups: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    drawn = df.withColumn("__d", draw_hash(seed, key))
    return first_n(drawn, groups, [F.col("__d"), F.col(key)], n, key).drop("__d", "rn")


def quota_spread(manifest: DataFrame, quotas: DataFrame, cell: list[str]) -> DataFrame:
    """k rows per quota cell, evenly spaced over the rows sorted by their longer side."""
    sized = manifest.join(quotas, cell).withColumn("long_side", F.greatest("h", "w")).withColumn("__d", draw_hash(0, "name"))
    ranked = row_number_by_value(sized, cell, [F.col("long_side"), F.col("__d"), F.col("name")], "long_side", "__rn",
                                 total="__n", tie_digest="__d")
    position = F.col("__rn") - 1
    gaps = F.greatest(F.col("k") - 1, F.lit(1))
    least = F.greatest(F.lit(0), F.ceil((position - 0.5) * gaps / F.greatest(F.col("__n") - 1, F.lit(1))))

    def spot(i: Column) -> Column:
        """Whether the i-th of the k places is this row."""
        inside = (i >= 0) & (i < F.least(F.col("k"), F.col("__n")))
        return inside & (F.bround(i * (F.col("__n") - 1) / gaps).cast("bigint") == position)

    return ranked.where((F.col("k") > 0) & (spot(least) | spot(least + 1))).drop("__rn", "__n", "__d")


def fixture_leaks(picked: DataFrame, manifest: DataFrame) -> DataFrame:
    """Picked rows that share a group with training or validation rows; must be empty.

    The corpus is cut to the few picked groups first, so a hot group never has to be matched whole.
    """
    seen = manifest.where(F.col("split").isin("val", *TRAIN_SIDE)).select("grp")
    hit = seen.join(picked.select("grp").distinct(), "grp", "left_semi").distinct()
    return picked.join(hit, "grp", "left_semi")


def fixture_summary(picked: DataFrame) -> DataFrame:
    base = picked.agg(
        F.count("*").alias("n"), n_where(F.col("crack_px") > 0).alias("n_with_defect"), n_where(F.col("crack_px") == 0).alias("n_clean"),
        F.array_join(F.sort_array(F.collect_set("material")), ",").alias("materials"),
        F.min(F.greatest("h", "w")).alias("min_side"), F.max(F.greatest("h", "w")).alias("max_side"))
    middle = percentiles(picked, [], F.greatest("h", "w"), {"median_side": 0.5}).scalar()
    return base.withColumn("median_side", middle)


# --- synthesis backgrounds ----------------------------------------------------------------------
def usable_surface() -> Column:
    return (
        (F.least("h", "w") >= MIN_SIDE)
        & F.col("brightness").between(*BRIGHTNESS)
        & (F.col("contrast") >= MIN_CONTRAST)
        & (F.col("dark_frac") <= MAX_CRUSHED)
        & (F.col("blown_frac") <= MAX_CRUSHED)
    )


def train_side_only(manifest: DataFrame, splits: DataFrame) -> DataFrame:
    allowed = splits.where(F.col("split").isin(*TRAIN_SIDE)).select("name")
    return manifest.join(allowed, "name", "left_semi")


def background_candidates(manifest: DataFrame, splits: DataFrame, sources: tuple[str, ...] = BACKGROUND_SOURCES) -> DataFrame:
    clean = manifest.where((F.col("role") == "negative") & F.col("source").isin(*sources) & (F.col("crack_px") == 0))
    return train_side_only(clean, splits)


def background_counts(candidates: DataFrame) -> DataFrame:
    sized = candidates.where(F.least("h", "w") >= MIN_SIDE)
    return sized.groupBy("material").agg(n_where(usable_surface()).alias("kept"), n_where(~usable_surface()).alias("rejected"))


def drop_synthetic_leaks(provenance: DataFrame, manifest: DataFrame) -> DataFrame:
    """Synthetic rows whose background, crop suffix stripped, sits in a held-out split are dropped."""
    held = manifest.where(~F.col("split").isin(*TRAIN_SIDE)).select(F.col("name").alias("__base"))
    based = provenance.withColumn("__base", F.regexp_replace("bg_id", r"_(crop|c)\d+$", ""))
    return based.join(held, "__base", "left_anti").drop("__base")


def synth_summary(provenance: DataFrame) -> DataFrame:
    return provenance.groupBy("material", "kind").agg(
        F.count("*").alias("n"), n_where(F.col("crack_px_frac") >= FAINT_LABEL).alias("kept"),
        percent(n_where(F.col("crack_px_frac") >= FAINT_LABEL), F.count("*"), 2).alias("kept_pct"),
        F.round(F.avg("crack_px_frac"), 9).alias("mean_fg"))


def load_pools(parts: list[tuple[str, DataFrame | None, tuple[str, ...] | None]]) -> DataFrame:
    """Synthetic sources with their own kind filter each, tagged by folder; missing ones are skipped."""
    kept = []
    for folder, df, kinds in parts:
        if df is None:
            continue
        rows = df.where(F.col("kind").isin(*kinds)) if kinds else df
        kept.append(rows.withColumn("src_dir", F.lit(folder)))
    if not kept:
        raise FileNotFoundError("no usable synthetic source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def role_pools(manifest: DataFrame, classes: int) -> DataFrame:
    """Positive and negative pools; with one class a scratch is not a crack and is negative."""
    defects = ("positive", "scratch") if classes > 1 else ("positive",)
    is_defect = F.col("role").isin(*defects)
    pool = F.when(is_defect & (F.col("crack_px") > 0), "positive").when(~is_defect, "negative")
    return manifest.withColumn("pool", pool).where(F.col("pool").isNotNull())
