"""Queries over splits: routing, stratification, leakage and integrity gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.functions.columns import n_where
from fettle.operators import gates, split, store
from fettle.operators.split import SplitRules
from fettle.plans.catalog import query
from fettle.schemas import EVAL_SPLITS, STORE

RULES = SplitRules(unseen_material="es", unseen_val_material="fr", factory_materials=("en",), eval_only_sources=("src1", "src2"),
                   split_source="src0", quarantined="src4")
SEED = "20260804"
D = f"md5('{SEED}:'||{{0}})"
EV = "('" + "','".join(EVAL_SPLITS) + "')"
TR = "('train','wood_bg')"


ROUTED = ("name", "grp", "phash", "source", "material", "role", "crack_px", "crack_px_frac")


def manifest(v):
    return v.manifest.select(*ROUTED, F.col("source").alias("subsource"))


HOLD_SQL = "CASE WHEN source='src4' THEN 'test_scratch_blob' WHEN role='positive' AND material='fr' THEN 'val_unseen_material' WHEN role='positive' AND material='es' THEN 'test_unseen_material' END"
EVAL_SQL = "CASE WHEN source IN ('src1','src2') THEN CASE WHEN role<>'positive' THEN 'test_negatives' WHEN material='en' THEN 'test_factory' ELSE 'test_seen' END END"
ROUTE_CTE = f"""board AS (SELECT grp, CASE WHEN row_number() OVER (ORDER BY {D.format('grp')}, grp) <= floor(count(*) OVER () * 0.70::DOUBLE) THEN 'wood_bg' ELSE 'test_negatives' END AS bsplit
  FROM (SELECT grp FROM manifest WHERE material='es' GROUP BY grp HAVING count(*) FILTER (WHERE role='positive')=0)),
 own0 AS (SELECT role, grp, row_number() OVER (PARTITION BY role ORDER BY {D.format('grp')}, grp) AS rn, count(*) OVER (PARTITION BY role) AS n FROM (SELECT DISTINCT role, grp FROM manifest WHERE source='src0' AND role IN ('positive','scratch'))),
 own AS (SELECT role, grp, CASE WHEN rn <= round_even(n*0.80::DOUBLE,0) THEN 'train' WHEN rn <= round_even(n*0.80::DOUBLE,0)+round_even(n*0.15::DOUBLE,0) THEN 'val' WHEN role='positive' THEN 'test_factory' ELSE 'test_factory_scratch' END AS osplit FROM own0),
 staged AS (SELECT m.*, coalesce(CASE WHEN source='src0' THEN osplit END, {HOLD_SQL}, CASE WHEN material='es' THEN coalesce(bsplit,'test_negatives') END, {EVAL_SQL}) AS early
  FROM manifest m LEFT JOIN (SELECT role AS orole, grp AS ogrp, osplit FROM own) o ON orole=m.role AND ogrp=m.grp LEFT JOIN board ON board.grp=m.grp),
 gstat AS (SELECT grp, arg_min_null(material, name) AS material, round(avg(crack_px_frac),9) AS fg, count(*) AS n FROM staged WHERE early IS NULL AND role='positive' GROUP BY grp),
 gq AS (SELECT grp, material, fg, n, CAST(coalesce(least(greatest(ceil((rn-1)*4/nullif((tot-1)::DOUBLE,0))-1,0),3),0) AS INT) AS fgb FROM (SELECT *, row_number() OVER (ORDER BY fg, grp) AS rn, count(*) OVER () AS tot FROM gstat)),
 gs0 AS (SELECT grp, material, fgb, row_number() OVER (PARTITION BY material, fgb ORDER BY {D.format('grp')}, grp) AS rn, count(*) OVER (PARTITION BY material, fgb) AS n FROM gq),
 gs AS (SELECT grp, material, fgb, CASE WHEN n<3 THEN 'train' WHEN rn <= least(greatest(1,round_even(n*0.80::DOUBLE,0)),n-2) THEN 'train' WHEN rn <= least(greatest(1,round_even(n*0.80::DOUBLE,0)),n-2)+greatest(1,round_even(n*0.15::DOUBLE,0)) THEN 'val' ELSE 'test' END AS gsplit FROM gs0),
 drawn AS (SELECT s.*, gsplit, ('0x'||substr({D.format('name')},1,8))::BIGINT/4294967296.0::DOUBLE AS u FROM staged s LEFT JOIN gs ON gs.grp=s.grp),
 routed AS (SELECT *, coalesce(early, CASE WHEN role='positive' THEN CASE gsplit WHEN 'val' THEN 'val' WHEN 'test' THEN CASE WHEN material='en' THEN 'test_factory' ELSE 'test_seen' END ELSE 'train' END
  ELSE CASE WHEN gsplit='test' THEN 'test_negatives' WHEN u<0.05::DOUBLE THEN 'test_negatives' WHEN u<0.05::DOUBLE+0.15::DOUBLE THEN 'val' ELSE 'train' END END) AS split FROM drawn)"""


@query("route_holdouts", f"SELECT name, {HOLD_SQL} AS split FROM manifest")
def _(v):
    return manifest(v).select("name", split.route_holdouts(RULES).alias("split"))


@query("clean_boards", "SELECT grp FROM manifest WHERE material='es' GROUP BY grp HAVING count(*) FILTER (WHERE role='positive')=0")
def _(v):
    return split.clean_groups(v.manifest, RULES)


@query("route_substrate", f"WITH {ROUTE_CTE} SELECT grp, bsplit AS substrate_split FROM board")
def _(v):
    return split.substrate_groups(v.manifest, RULES)


@query("route_source_split", f"WITH {ROUTE_CTE} SELECT role, grp, osplit AS source_split FROM own")
def _(v):
    return split.source_split_groups(v.manifest, RULES)


@query("route_eval_only", f"SELECT name, {EVAL_SQL} AS split FROM manifest")
def _(v):
    return v.manifest.select("name", split.route_eval_only(RULES).alias("split"))


@query("group_stats", "SELECT grp, arg_min_null(material, name) AS material, round(avg(crack_px_frac),9) AS fg, count(*) AS n FROM manifest WHERE role='positive' GROUP BY grp")
def _(v):
    return split.group_stats(v.manifest.where("role='positive'"))


GS = "(SELECT grp, arg_min_null(material, name) AS material, round(avg(crack_px_frac),9) AS fg FROM manifest GROUP BY grp)"
FGB = f"(SELECT grp, material, CAST(coalesce(least(greatest(ceil((rn-1)*4/nullif((tot-1)::DOUBLE,0))-1,0),3),0) AS INT) AS fgb FROM (SELECT *, row_number() OVER (ORDER BY fg, grp) AS rn, count(*) OVER () AS tot FROM {GS}))"


@query("fg_quartile", f"SELECT grp, material, fgb FROM {FGB}")
def _(v):
    return split.with_fg_quartile(split.group_stats(v.manifest)).select("grp", "material", "fgb")


@query("stratified_assign", f"SELECT grp, material, fgb, CASE WHEN n<3 THEN 'train' WHEN rn <= least(greatest(1,round_even(n*0.80::DOUBLE,0)),n-2) THEN 'train' WHEN rn <= least(greatest(1,round_even(n*0.80::DOUBLE,0)),n-2)+greatest(1,round_even(n*0.15::DOUBLE,0)) THEN 'val' ELSE 'test' END AS group_split FROM (SELECT *, row_number() OVER (PARTITION BY material, fgb ORDER BY {D.format('grp')}, grp) AS rn, count(*) OVER (PARTITION BY material, fgb) AS n FROM {FGB})")
def _(v):
    return split.stratified_assign(split.with_fg_quartile(split.group_stats(v.manifest)), RULES)


@query("route_rest", f"WITH {ROUTE_CTE} SELECT name, source, material, role, split FROM routed")
def _(v):
    return split.assign(manifest(v), RULES).select("name", "source", "material", "role", "split")


# --- gates on a planted split -----------------------------------------------------------
def planted(v):
    return v.manifest_split.withColumn("subsource", F.col("source"))


def one(gate_name, sql, condition):
    @query(gate_name, f"SELECT count(*) AS n FROM manifest_split WHERE {sql}")
    def _(v):
        return planted(v).agg(n_where(condition()).alias("n"))


LEAK = f"SELECT {{0}} FROM manifest_split WHERE {{0}}<>'' GROUP BY 1 HAVING bool_or(split IN {TR}) AND bool_or(split IN {EV})"


@query("leak_group", LEAK.format("grp"))
def _(v):
    return gates.leaking_keys(v.manifest_split, "grp")


@query("leak_hash", LEAK.format("phash"))
def _(v):
    return gates.leaking_keys(v.manifest_split, "phash")


@query("warn_multi_eval", f"SELECT grp FROM manifest_split GROUP BY 1 HAVING count(DISTINCT split)>1 AND NOT bool_or(split IN {TR})")
def _(v):
    return gates.multi_eval_keys(v.manifest_split)


@query("unseen_isolated", "SELECT count(*) FILTER (WHERE split='test_unseen_material' AND material IS DISTINCT FROM 'es') AS foreign_rows, count(*) FILTER (WHERE split='train' AND material='es') AS in_train FROM manifest_split")
def _(v):
    g = gates.row_gates(RULES)
    return planted(v).agg(n_where(g["unseen_foreign"]).alias("foreign_rows"), n_where(g["unseen_in_train"]).alias("in_train"))


@query("unseen_val_isolated", "SELECT count(*) FILTER (WHERE material='fr' AND split IN ('train','val','test_seen')) AS leaked, count(*) FILTER (WHERE split='val_unseen_material') AS held FROM manifest_split")
def _(v):
    return planted(v).agg(n_where(gates.row_gates(RULES)["unseen_val_elsewhere"]).alias("leaked"), n_where(F.col("split") == "val_unseen_material").alias("held"))


@query("class_present", " UNION ALL ".join(f"SELECT '{r}' AS role, '{s}' AS split, (SELECT count(*) FROM manifest_split WHERE role='{r}' AND split='{s}') AS n" for r in ("positive", "scratch") for s in ("train", "val", "nowhere")))
def _(v):
    return gates.class_presence(v.manifest_split, ("positive", "scratch"), ("train", "val", "nowhere"))


@query("headline_pure", "SELECT count(*) FILTER (WHERE split='test_factory' AND (material IN ('en')) IS NOT TRUE) AS headline_foreign, count(*) FILTER (WHERE split='test_scratch_blob' AND source IS DISTINCT FROM 'src4') AS quarantine_foreign FROM manifest_split")
def _(v):
    g = gates.row_gates(RULES)
    return planted(v).agg(*[n_where(g[k]).alias(k) for k in ("headline_foreign", "quarantine_foreign")])


TWICE = "(SELECT name FROM manifest_split UNION ALL SELECT name FROM manifest_split WHERE split='val')"


@query("dup_names", f"SELECT name, count(*) AS n FROM {TWICE} GROUP BY 1 HAVING count(*)>1")
def _(v):
    m = v.manifest_split.select("name", "split")
    return store.duplicates(m.unionByName(m.where("split='val'")), ["name"])


one("negatives_clean", "split='test_negatives' AND crack_px>0", lambda: gates.row_gates(RULES)["negatives_with_crack"])


@query("empty_splits", "SELECT s AS split FROM (VALUES ('" + "'),('".join(EVAL_SPLITS) + "')) t(s) WHERE s NOT IN (SELECT split FROM manifest_split)")
def _(v):
    return gates.empty_splits(v.manifest_split)


@query("unknown_splits", f"SELECT DISTINCT split FROM manifest_split WHERE split NOT IN {EV} AND split NOT IN {TR}")
def _(v):
    return gates.unknown_splits(v.manifest_split)


@query("missing_materials", "SELECT * FROM (VALUES ('en'),('pt'),('es'),('it')) t(material) EXCEPT SELECT material FROM manifest_split WHERE split='test_negatives'")
def _(v):
    return gates.missing_values(v.manifest_split.where("split='test_negatives'"), "material", ("en", "pt", "es", "it"))


@query("bg_test_overlap", "SELECT name FROM manifest_split WHERE split='wood_bg' INTERSECT SELECT m.name FROM manifest_split m WHERE split='test_negatives' OR (split='wood_bg' AND role='positive')")
def _(v):
    m = v.manifest_split
    bg = m.where("split='wood_bg'").select("name")
    return bg.intersect(m.where("split='test_negatives' OR (split='wood_bg' AND role='positive')").select("name"))


@query("mask_binary_sample", """WITH s AS (SELECT vec_id AS item_id FROM embeddings WHERE ('0x'||substr(md5('1:'||vec_id),1,8))::BIGINT < 3435973836 AND vec_id IS NOT NULL), p AS (SELECT item_id, max(CASE WHEN v>0.42 THEN 1 ELSE 0 END) AS odd FROM pixel WHERE gt=1 GROUP BY 1)
 SELECT count(*) AS sampled, count(*) FILTER (WHERE odd IS NULL) AS missing, count(*) FILTER (WHERE odd=1) AS not_binary FROM s LEFT JOIN p ON p.item_id=s.item_id""")
def _(v):
    sample = split.hash_sample(v.embeddings.select(F.col("vec_id").alias("item_id")), "item_id", 0.8)
    masks = v.pixel.where("gt=1").select("item_id", F.when(F.col("v") > 0.42, 7).otherwise(255).alias("value"))
    return gates.binary_mask_check(sample, masks)


def report_sql(table: str) -> str:
    row = {"unseen_foreign": "split='test_unseen_material' AND material IS DISTINCT FROM 'es'", "unseen_in_train": "split='train' AND material='es'",
           "unseen_val_elsewhere": "material='fr' AND split IN ('train','val','test_seen')", "headline_foreign": "split='test_factory' AND material IS DISTINCT FROM 'en'",
           "quarantine_foreign": "split='test_scratch_blob' AND source IS DISTINCT FROM 'src4'", "negatives_with_crack": "split='test_negatives' AND crack_px>0",
           "unknown_split": f"split NOT IN {EV} AND split NOT IN {TR}"}
    parts = [(k, "error", f"(SELECT count(*) FROM {table} WHERE {c})") for k, c in row.items()]
    need = {"scratch_in_train": "role='scratch' AND split='train'", "scratch_in_val": "role='scratch' AND split='val'", "positive_in_train": "role='positive' AND split='train'"}
    need.update({f"has_{s}": f"split='{s}'" for s in EVAL_SPLITS})
    parts += [(k, "error", f"(SELECT CASE WHEN count(*)=0 THEN 1 ELSE 0 END FROM {table} WHERE {c})") for k, c in need.items()]
    leak = LEAK.replace("manifest_split", table)
    parts += [("leak_group", "error", f"(SELECT count(*) FROM ({leak.format('grp')}))"), ("leak_hash", "error", f"(SELECT count(*) FROM ({leak.format('phash')}))"),
              ("multi_eval_group", "warning", f"(SELECT count(*) FROM (SELECT grp FROM {table} GROUP BY 1 HAVING count(DISTINCT split)>1 AND NOT bool_or(split IN {TR})))"),
              ("dup_names", "error", f"(SELECT count(*)-count(DISTINCT name) FROM {table})"),
              ("bg_in_negatives", "error", f"(SELECT count(*) FROM (SELECT name FROM {table} GROUP BY 1 HAVING bool_or(split='wood_bg') AND bool_or(split='test_negatives')))")]
    body = " UNION ALL ".join(f"SELECT '{k}' AS gate, '{s}' AS severity, CAST({n} AS BIGINT) AS n" for k, s, n in parts)
    return f"SELECT gate, severity, n, n=0 AS ok FROM ({body})"


@query("gate_report", report_sql("manifest_split"))
def _(v):
    return gates.gate_report(planted(v), RULES)


@query("gate_report_routed", f"WITH {ROUTE_CTE} {report_sql('routed')}")
def _(v):
    return gates.gate_report(split.assign(manifest(v), RULES), RULES)


ABSENT = {"inspection": "material_id,station_id", "defect_region": "class_id,region_id", "station": "camera_status,created_at"}


@query("missing_columns", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, '{c}' AS missing FROM {t}" for t, c in ABSENT.items()))
def _(v):
    return gates.missing_columns({t: v[t] for t in ABSENT}, STORE)


PRESENT = ("inspection", "defect_region", "batch_run", "profile", "station", "model_version", "material")


@query("missing_tables", "SELECT t AS table_name FROM (VALUES " + ",".join(f"('{t}')" for t in sorted(STORE)) + ") x(t) WHERE t NOT IN (" + " UNION ALL ".join(f"SELECT '{t}' FROM (SELECT count(*) FROM {t})" for t in PRESENT) + ")")
def _(v):
    return gates.missing_tables(v.spark, v.found(sorted(STORE)), sorted(STORE))
