"""Source adapters: one rule per source turns raw listings into manifest rows.

A rule is a set of column expressions, so all sources are read in one pass. The caps some
sources carry are separate operators (:func:`cap_per_group`, :func:`systematic_sample`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.functions.columns import draw_hash
from fettle.operators.ranking import row_number_by_hash

# Material by name prefix of the mixed crack source.
PREFIX_MATERIAL = {
    "noncrack": "concrete", "CRACK500": "asphalt", "GAPS": "asphalt", "cracktree": "asphalt", "CFD": "asphalt",
    "DeepCrack": "concrete", "Rissbilder": "concrete", "Volker": "concrete", "Ceramic": "ceramic", "Masonry": "masonry",
}
MASONRY_PREFIXES = ("a_", "b_", "c_", "d_")
# Classes that count as a crack or as a scratch in synthetic samples.
CRACK_CLASSES = (
    "crack", "hairline_crack", "fatigue_crack", "branch_crack", "spider_crack", "micro_crack", "long_crack", "fracture",
)
SCRATCH_CLASSES = ("scratch", "deep_scratch")
# Annotation categories by meaning, lower case.
CRACK_WORDS = ("crack", "cracks", "lcd_crack", "pvc pipe crack", "fracture")
SCRATCH_WORDS = ("scratch", "scratches")
IGNORED_CATEGORIES = ("objects", "object", "phone", "glass", "glass-detection", "molding", "null", "background")
OUT_OF_DOMAIN = ("paper crack", "dummy crack", "dirt", "porosity")
MAX_FG_FRACTION = 0.15
MAX_BLOB_WIDTH = 20.0


def first_prefix(text: Column, table: dict[str, str], otherwise: Column) -> Column:
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, value in table.items():
        choice = choice.when(text.startswith(prefix), value)
    return choice.otherwise(otherwise)


def material_of_prefix(stem: Column) -> Column:
    masonry = F.substring(stem, 1, 2).isin(*MASONRY_PREFIXES)
    return first_prefix(stem, PREFIX_MATERIAL, F.when(masonry, "masonry").otherwise("unknown"))


@dataclass(frozen=True)
class Rule:
    """How one source becomes manifest rows. ``role`` decides the tier unless ``tier`` is given."""

    role: Callable[[], Column]
    material: Callable[[], Column]
    keep: Callable[[], Column] = lambda: F.lit(True)
    source: str | None = None
    tier: Callable[[Column], Column] = lambda role: F.when(role == "positive", "A").when(role == "negative", "C").otherwise("B")


def _fixed(value: str) -> Callable[[], Column]:
    return lambda: F.lit(value)


def _label() -> Column:
    return F.col("label")


def _painted(column: str = "crack_px") -> Column:
    return F.col(column) > 0


def _defect_role() -> Column:
    return F.when(_label() == "crack", "positive").when(_label() == "scratch", "scratch").otherwise("hard_negative")


RULES: dict[str, Rule] = {
    "crackseg9k": Rule(
        role=lambda: F.when(_label().startswith("noncrack"), "negative").otherwise("positive"),
        material=lambda: material_of_prefix(_label()),
        keep=lambda: F.col("has_mask"),
    ),
    "magnetic_tile": Rule(
        role=lambda: F.when(_label().contains("Crack"), "positive").when(_label().contains("Free"), "negative").otherwise("hard_negative"),
        material=_fixed("ceramic"),
    ),
    "neu_det": Rule(role=_fixed("hard_negative"), material=_fixed("steel"), keep=lambda: _label() != "crazing"),
    "dtd": Rule(role=_fixed("negative"), material=_fixed("mixed"), keep=lambda: ~_label().contains("cracked")),
    "ozgenel": Rule(role=_fixed("negative"), material=_fixed("concrete"), keep=lambda: ~_label().contains("positive")),
    "kolektor": Rule(role=_fixed("negative"), material=_fixed("plastic"), keep=lambda: F.col("has_mask") & ~_painted()),
    "gc10": Rule(role=_fixed("hard_negative"), material=_fixed("metal")),
    "sdnet": Rule(role=_fixed("negative"), material=_fixed("concrete"), keep=lambda: _label().contains("non-cracked")),
    "severstal": Rule(
        role=lambda: F.when(F.coalesce("listed_defect", F.lit(False)), "hard_negative").otherwise("negative"),
        material=_fixed("steel"),
    ),
    "wood": Rule(
        role=lambda: F.when(_painted() | _painted("knot_px"), "positive").when(_painted("other_px"), "hard_negative").otherwise("negative"),
        material=_fixed("wood"),
    ),
    "wood_shards": Rule(
        source="wood",
        role=lambda: F.when(_painted(), "positive").when(_painted("other_px"), "hard_negative").otherwise("negative"),
        material=_fixed("wood"),
        keep=lambda: ~(_painted("knot_px") & ~_painted()),
    ),
    "kolektor1": Rule(role=lambda: F.when(_painted(), "positive").otherwise("negative"), material=_fixed("plastic")),
    "mvtec": Rule(role=lambda: F.when(_label() == "scratch", "scratch").otherwise("positive"), material=lambda: F.col("record_material"), keep=_painted),
    "sdx": Rule(role=_defect_role, material=_fixed("steel"), keep=_painted),
    "casting": Rule(role=_fixed("negative"), material=_fixed("steel"), keep=lambda: _label() == "ok_front", tier=lambda role: F.lit("A")),
}


#: Adapters whose mask unites cracks and knots.
BOTH_COLOURS = ("wood",)


def adapt(raw: DataFrame, listed_defects: DataFrame | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Raw items of every known source as manifest rows.

    ``raw`` has adapter, sid, label, record_material, has_mask, crack_px, knot_px, other_px; ``listed_defects``
    holds the sids that a source's own defect list names.
    """
    rules = rules or RULES
    if listed_defects is None:
        items = raw.withColumn("listed_defect", F.lit(False))
    else:
        items = raw.join(listed_defects.select("sid").distinct().withColumn("listed_defect", F.lit(True)), "sid", "left")
    keep = source = role = material = tier = None
    for name, rule in rules.items():
        hit = F.col("adapter") == name
        r = rule.role()
        pairs = (rule.keep(), F.lit(rule.source or name), r, rule.material(), rule.tier(r))
        done = (keep, source, role, material, tier)
        keep, source, role, material, tier = (
            F.when(hit, new) if old is None else old.when(hit, new) for old, new in zip(done, pairs)
        )
    foreground = F.col("role").isin("positive", "scratch")
    shaped = items.where(F.coalesce(keep, F.lit(False))).withColumns(
        {"source": source, "role": role, "material": material, "tier": tier}
    )
    return shaped.select(
        F.concat_ws("__", "source", "sid").alias("name"), "source", "sid", "material", "tier", "role",
        F.when(foreground, F.col("crack_px") + F.when(F.col("adapter").isin(*BOTH_COLOURS), F.col("knot_px")).otherwise(0)).otherwise(0).alias("crack_px"),
    )


def label_queue(raw: DataFrame) -> DataFrame:
    """Defective castings without masks wait for labels instead of entering the corpus."""
    return raw.where((F.col("adapter") == "casting") & (F.col("label") != "ok_front"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def upsert(existing: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """New rows replace the existing ones of the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def systematic_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every k-th row, k = max(1, total // n), at most n, in draw order of ``order``."""
    digest = df.withColumn("__d", draw_hash(0, order))
    ranked = row_number_by_hash(digest, [], "__d", order, "__rn", total="__n")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("__n") / n))
    position = F.col("__rn") - 1
    kept = ranked.where((position % step == 0) & (F.floor(position / step) < n))
    return kept.drop("__d", "__rn", "__n")


def pair_counts(images: DataFrame, masks: DataFrame, key: str = "stem") -> DataFrame:
    """How many stems have both files, and how many miss one."""
    marks = images.select(key, F.lit(1).alias("i"), F.lit(0).alias("m")).unionByName(
        masks.select(key, F.lit(0).alias("i"), F.lit(1).alias("m")))
    both = marks.groupBy(key).agg(F.max("i").alias("i"), F.max("m").alias("m"))
    return both.agg(
        F.sum(F.col("i") * F.col("m")).alias("paired"), F.sum(F.col("i") * (1 - F.col("m"))).alias("image_only"),
        F.sum((1 - F.col("i")) * F.col("m")).alias("mask_only"),
    )


def shard_hits(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per shard: its images and how many of them are wanted."""
    w = wanted.select("image_id").distinct().withColumn("hit", F.lit(1))
    return members.join(w, "image_id", "left").groupBy("shard").agg(
        F.count("*").alias("images"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))


# --- annotation documents ------------------------------------------------------------
COCO = (
    "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, height: INT, width: INT>>,"
    " categories ARRAY<STRUCT<id: BIGINT, name: STRING>>,"
    " annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: BIGINT, segmentation: ARRAY<ARRAY<DOUBLE>>>>"
)


def flatten_annotations(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """One row per annotation with its category name and image file."""
    doc = documents.select(key, F.from_json(payload, COCO).alias("d"))
    notes = doc.select(key, F.explode("d.annotations").alias("a"))
    images = doc.select(key, F.explode("d.images").alias("i")).select(key, F.col("i.id").alias("image_id"), "i.file_name")
    names = doc.select(key, F.explode("d.categories").alias("c")).select(key, F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    flat = notes.select(key, F.col("a.id").alias("annotation_id"), F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("category_id"), F.col("a.segmentation").alias("segmentation"))
    return flat.join(images, [key, "image_id"]).join(names, [key, "category_id"], "left")


def class_of_category(category: Column) -> Column:
    """crack, scratch, or null for ignored, foreign and unmapped categories."""
    c = F.lower(F.trim(category))

    def has_word(words: tuple[str, ...]) -> Column:
        return c.rlike("|".join(words))

    barred = c.isin(*IGNORED_CATEGORIES, *OUT_OF_DOMAIN)
    return F.when(barred, None).when(has_word(SCRATCH_WORDS), "scratch").when(has_word(CRACK_WORDS), "crack")


def allow_deny(annotations: DataFrame, lists: DataFrame) -> DataFrame:
    """Reason per annotation from the use and reject lists of its dataset (dataset, category, verdict)."""
    deny = lists.where(F.col("verdict") == "reject").select("dataset", F.col("category").alias("__c"), F.lit(True).alias("denied")).distinct()
    allow = lists.where(F.col("verdict") == "use").select("dataset", F.col("category").alias("__c"), F.lit(True).alias("allowed")).distinct()
    listed = lists.where(F.col("verdict") == "use").select("dataset").distinct().withColumn("has_allow", F.lit(True))
    c, cls = F.lower(F.trim("category")), class_of_category(F.col("category"))
    out = annotations.withColumn("__c", c).join(deny, ["dataset", "__c"], "left").join(allow, ["dataset", "__c"], "left")
    by_class = allow.withColumnRenamed("__c", "__k").withColumnRenamed("allowed", "class_allowed")
    out = out.withColumn("__k", cls).join(by_class, ["dataset", "__k"], "left").join(listed, "dataset", "left")
    reason = (
        F.when(cls.isNull(), F.col("category"))
        .when(F.col("denied"), F.concat(F.col("category"), F.lit("(rejected)")))
        .when(F.col("has_allow") & F.col("allowed").isNull() & F.col("class_allowed").isNull(), F.concat(F.col("category"), F.lit("(not in use)")))
    )
    return out.withColumn("reason", reason).withColumn("class_code", cls).drop("__c", "__k", "denied", "allowed", "class_allowed", "has_allow")


def owner_class(annotations: DataFrame) -> DataFrame:
    """The class with the most annotated pixels owns the image; crack wins a tie."""
    areas = annotations.where(F.col("class_code").isNotNull()).groupBy("image_id", "class_code").agg(F.sum("area").alias("px"))
    rank = F.struct("px", (F.col("class_code") == "crack").cast("int").alias("t"))
    return areas.groupBy("image_id").agg(F.max_by("class_code", rank).alias("owner"), F.max("px").alias("px")).where(F.col("px") > 0)


def shape_reason(fg_frac: Column, width: Column) -> Column:
    """Why an annotation is refused by shape: too much of the image, or a compact blob."""
    return F.when(fg_frac > MAX_FG_FRACTION, "whole-object").when(width > MAX_BLOB_WIDTH, "blob-shaped")


def class_precedence(classes: Column) -> Column:
    """Kind of a sample from its class names: crack before scratch before negative."""
    def any_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(classes, F.array(*[F.lit(n) for n in names]))
    return F.when(any_of(CRACK_CLASSES), "crack").when(any_of(SCRATCH_CLASSES), "scratch").otherwise("negative")
