"""Leakage and integrity gates over a split manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fettle.functions.columns import n_where
from fettle.operators.split import SplitRules
from fettle.schemas import EVAL_SPLITS, TRAIN_SIDE
from fettle.session import settle


def _on_train() -> Column:
    return F.col("split").isin(*TRAIN_SIDE)


def _on_eval() -> Column:
    return F.col("split").isin(*EVAL_SPLITS)


def key_sides(manifest: DataFrame, key: str) -> DataFrame:
    """Per key: whether it has rows on the training and on the evaluation side.

    Two flags per key combine on the map side, whatever the size of a group.
    """
    return manifest.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.max(_on_train()).alias("on_train"), F.max(_on_eval()).alias("on_eval"),
        F.min("split").alias("first_split"), F.max("split").alias("last_split"))


def leaking_keys(manifest: DataFrame, key: str) -> DataFrame:
    return key_sides(manifest, key).where("on_train AND on_eval").select(key)


def multi_eval_keys(manifest: DataFrame, key: str = "grp") -> DataFrame:
    """Groups in several splits, none on the training side: harmless, worth a note."""
    return key_sides(manifest, key).where(~F.col("on_train") & (F.col("first_split") != F.col("last_split"))).select(key)


def row_gates(rules: SplitRules) -> dict[str, Column]:
    """Gates that look at one row: each names the rows that break it. A missing value is a foreign one."""
    split, material = F.col("split"), F.col("material")
    return {
        "unseen_foreign": (split == "test_unseen_material") & ~material.eqNullSafe(rules.unseen_material),
        "unseen_in_train": (split == "train") & (material == rules.unseen_material),
        "unseen_val_elsewhere": split.isin("train", "val", "test_seen") & (material == rules.unseen_val_material),
        "headline_foreign": (split == "test_factory") & ~F.coalesce(material.isin(*rules.factory_materials), F.lit(False)),
        "quarantine_foreign": (split == "test_scratch_blob") & ~F.col("subsource").eqNullSafe(rules.quarantined),
        "negatives_with_crack": (split == "test_negatives") & (F.col("crack_px") > 0),
        "unknown_split": ~F.coalesce(split.isin(*EVAL_SPLITS, *TRAIN_SIDE), F.lit(False)),
    }


def required_rows(rules: SplitRules) -> dict[str, Column]:
    """Row sets that must not be empty."""
    role, split = F.col("role"), F.col("split")
    wanted = {"scratch_in_train": (role == "scratch") & (split == "train"), "scratch_in_val": (role == "scratch") & (split == "val"),
              "positive_in_train": (role == "positive") & (split == "train")}
    wanted.update({f"has_{s}": split == s for s in EVAL_SPLITS})
    return wanted


def gate(name: str, severity: str, n: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), F.lit(severity).alias("severity"), n.cast("bigint").alias("n"), (n == 0).alias("ok"))


def _long(counts: DataFrame, gates: list[Column]) -> DataFrame:
    return counts.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def gate_report(manifest: DataFrame, rules: SplitRules) -> DataFrame:
    """All gates as (gate, severity, n, ok).

    The few columns that gates look at are written once, and the row gates are counted while they are written; groups,
    hashes and names are then counted from that table, so what makes the manifest runs once.
    """
    breaks, wanted = row_gates(rules), required_rows(rules)
    seen = Observation("row gates")
    narrow = manifest.select("name", "grp", "phash", "split", "role", "material", "subsource", "crack_px").observe(
        seen, *[n_where(c).alias(k) for k, c in breaks.items()], *[F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(k) for k, c in wanted.items()])
    rows = settle(narrow, "gates")
    told = seen.get
    counted = [(k, "error", int(told[k])) for k in breaks] + [(k, "error", 1 - int(told[k])) for k in wanted]
    by_row = manifest.sparkSession.createDataFrame([(k, s, n, n == 0) for k, s, n in counted], "gate STRING, severity STRING, n BIGINT, ok BOOLEAN")
    groups = key_sides(rows, "grp").agg(
        n_where(F.col("on_train") & F.col("on_eval")).alias("leak"),
        n_where(~F.col("on_train") & (F.col("first_split") != F.col("last_split"))).alias("multi"))
    by_group = _long(groups, [gate("leak_group", "error", F.col("leak")), gate("multi_eval_group", "warning", F.col("multi"))])
    hashes = key_sides(rows, "phash").agg(n_where(F.col("on_train") & F.col("on_eval")).alias("leak"))
    by_hash = _long(hashes, [gate("leak_hash", "error", F.col("leak"))])
    names = rows.groupBy("name").agg(
        F.count("*").alias("c"), F.max((F.col("split") == "wood_bg").cast("int")).alias("bg"),
        F.max((F.col("split") == "test_negatives").cast("int")).alias("neg"))
    named = names.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("dups"), n_where((F.col("bg") == 1) & (F.col("neg") == 1)).alias("both"))
    by_name = _long(named, [gate("dup_names", "error", F.col("dups")), gate("bg_in_negatives", "error", F.col("both"))])
    return reduce(DataFrame.unionByName, [by_row, by_group, by_hash, by_name])


class GateError(RuntimeError):
    """A strict run found a broken gate."""


def enforce(report: DataFrame) -> None:
    """Fail the job on any error gate. The report has a fixed, small number of rows."""
    broken = report.where((F.col("severity") == "error") & ~F.col("ok")).collect()
    if broken:
        raise GateError("; ".join(f"{r['gate']}: {r['n']}" for r in broken))


def class_presence(manifest: DataFrame, roles: tuple[str, ...], splits: tuple[str, ...]) -> DataFrame:
    """Zero-filled counts per role and split, from one aggregate."""
    cells = [(r, s) for r in roles for s in splits]
    counts = manifest.agg(*[n_where((F.col("role") == r) & (F.col("split") == s)).alias(f"c{i}") for i, (r, s) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s).alias("split"), F.col(f"c{i}").alias("n")) for i, (r, s) in enumerate(cells)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def empty_splits(manifest: DataFrame, declared: tuple[str, ...] = EVAL_SPLITS) -> DataFrame:
    known = manifest.sparkSession.createDataFrame([(s,) for s in declared], "split STRING")
    return known.join(manifest.select("split").distinct(), "split", "left_anti")


def unknown_splits(manifest: DataFrame, declared: tuple[str, ...] = EVAL_SPLITS + TRAIN_SIDE) -> DataFrame:
    return manifest.select("split").distinct().where(~F.col("split").isin(*declared))


def missing_values(manifest: DataFrame, column: str, wanted: tuple[str, ...]) -> DataFrame:
    want = manifest.sparkSession.createDataFrame([(w,) for w in wanted], f"{column} STRING")
    return want.exceptAll(manifest.select(column).distinct())


def missing_tables(spark, present: list[str], expected: list[str]) -> DataFrame:
    """Expected tables whose names are not there; an empty table is present, and no table is read."""
    return spark.createDataFrame([(t,) for t in sorted(set(expected) - set(present))], "table_name STRING")


def missing_columns(tables: dict[str, DataFrame], expected: dict[str, str]) -> DataFrame:
    """Row count of each table with the declared columns it lacks."""
    parts = []
    for name, df in tables.items():
        declared = [c.strip().split(" ")[0] for c in expected[name].split(",")]
        lacking = ",".join(sorted(set(declared) - set(df.columns)))
        parts.append(df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(lacking).alias("missing")))
    return reduce(DataFrame.unionByName, parts)


def binary_mask_check(sample: DataFrame, pixels: DataFrame, allowed: tuple[int, ...] = (0, 255)) -> DataFrame:
    """Sampled items without a mask, and sampled masks with a value outside ``allowed``."""
    per = pixels.groupBy("item_id").agg(F.max((~F.col("value").isin(*allowed)).cast("int")).alias("odd"))
    joined = sample.select("item_id").join(per, "item_id", "left")
    return joined.agg(F.count("*").alias("sampled"), n_where(F.col("odd").isNull()).alias("missing"), n_where(F.col("odd") == 1).alias("not_binary"))
