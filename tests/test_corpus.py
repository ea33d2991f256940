"""Names, dedup, audits, adapters, splits and gates."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fettle.operators import adapters, corpus, gates, split
from fettle.operators.split import SplitRules


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x STRING")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_parent_id(spark):
    names = {
        "crackseg9k__CRACK500_20160222_081011_1_721": "crackseg9k:CRACK500:20160222_081011",
        "crackseg9k__Rissbilder_for_Florian_9S6A2815_12": "crackseg9k:Rissbilder_for_Florian_9S6A2815",
        "sdx__train_cracking_12": "sdx:train_cracking_12",
        "crackseg9k__a_0_10": "crackseg9k:a_0",
        "wood__123456789": "wood:1234",
        "kolektor1__kos01_Part3": "kolektor1:kos01",
        "dtd__bumpy_0001_crop12": "dtd:bumpy_0001",
        "plain": "plain:plain",
    }
    assert one(spark, corpus.parent_id, *names) == list(names.values())


def test_subsource(spark):
    names = {"mvtec__scratch_01": "mvtec_scratch", "crackseg9k__Volker_1": "Volker", "crackseg9k__b_3_1": "masonry_abcd", "gc10__c1_2": "gc10", "CFD_001": "CFD"}
    assert one(spark, corpus.subsource, *names) == list(names.values())


def test_category_classes(spark):
    got = one(spark, adapters.class_of_category, "PVC pipe crack", " Scratches ", "Paper crack", "objects", "hole", "Fracture line")
    assert got == ["crack", "scratch", None, None, None, "crack"]


def test_keep_first_survives_a_hot_group_of_copies(spark):
    rows = [(f"n{i:04d}", i, "same" if i % 3 else ("" if i % 2 else f"h{i}")) for i in range(900)]
    m = spark.createDataFrame(rows, "name STRING, doc_id INT, phash STRING").repartition(7)
    kept = corpus.keep_first(m, "doc_id").collect()
    assert sum(r["phash"] == "same" for r in kept) == 1
    assert next(r["name"] for r in kept if r["phash"] == "same") == "n0001"
    assert sum(r["phash"] == "" for r in kept) == 150
    assert corpus.duplicate_count(m).first()["n"] == 600


def test_width_audit_rejects_constant_masks(spark):
    rows = [("thin", 2.0), ("thin", 2.0), ("thin", 2.01), ("wide", 5.0), ("wide", 9.0), ("single", 1.0)]
    m = spark.createDataFrame(rows, "subsource STRING, mean_crack_width DOUBLE").withColumns({"role": F.lit("positive"), "crack_px": F.lit(5)})
    audit = corpus.width_audit_by_subsource(m)
    assert {r["subsource"]: r["reject"] for r in audit.collect()} == {"thin": True, "wide": False, "single": False}
    assert {r["subsource"] for r in corpus.without_skeletons(m, audit).collect()} == {"wide", "single"}


def test_refine_counts_null_safely(spark):
    m = spark.createDataFrame([("mvtec__capsule_1", "mvtec", "x", "plastic"), ("kolektor1__a", "kolektor1", "kolektor1", None), ("a__b", "a", "a", None)],
                              "name STRING, source STRING, subsource STRING, material STRING")
    out = {r["name"]: (r["material"], r["relabelled"]) for r in corpus.refine_material(m).collect()}
    assert out == {"mvtec__capsule_1": ("pharma_capsule", True), "kolektor1__a": ("epoxy", True), "a__b": (None, False)}


def test_adapter_rules(spark):
    rows = [("1", "neu_det", "crazing", True, 5, 0, 0), ("2", "neu_det", "inclusion", True, 5, 0, 0), ("3", "wood_shards", "", True, 0, 4, 0),
            ("4", "wood_shards", "", True, 0, 0, 3), ("5", "crackseg9k", "a_", True, 9, 0, 0), ("6", "crackseg9k", "CFD", False, 9, 0, 0),
            ("7", "severstal", "", True, 0, 0, 0), ("8", "severstal", "", True, 0, 0, 0), ("9", "casting", "def_front", True, 1, 0, 0), ("10", "nobody", "", True, 1, 0, 0),
            ("11", "wood", "", True, 2, 5, 0), ("12", "wood", "", True, 0, 5, 0), ("13", "mvtec", "crack", True, 3, 9, 0)]
    raw = spark.createDataFrame(rows, "sid STRING, adapter STRING, label STRING, has_mask BOOLEAN, crack_px INT, knot_px INT, other_px INT")
    raw = raw.withColumn("record_material", F.when(F.col("adapter") == "mvtec", "plastic"))
    assert {r["sid"]: r["crack_px"] for r in adapters.adapt(raw).where("sid IN ('11','12','13')").collect()} == {"11": 7, "12": 5, "13": 3}
    out = {r["sid"]: (r["source"], r["role"], r["material"], r["tier"]) for r in adapters.adapt(raw, raw.where("sid='7'")).collect()}
    assert out == {"2": ("neu_det", "hard_negative", "steel", "B"), "4": ("wood", "hard_negative", "wood", "B"), "5": ("crackseg9k", "positive", "masonry", "A"),
                   "7": ("severstal", "hard_negative", "steel", "B"), "8": ("severstal", "negative", "steel", "C"),
                   "11": ("wood", "positive", "wood", "A"), "12": ("wood", "positive", "wood", "A"), "13": ("mvtec", "positive", "plastic", "A")}


def test_upsert_new_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "name STRING, v INT")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "name STRING, v INT")
    assert sorted(tuple(r) for r in adapters.upsert(old, new).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_systematic_sample(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("name"))
    assert adapters.systematic_sample(df, "name", 30).count() == 30
    assert adapters.systematic_sample(df, "name", 200).count() == 100


# --- splits ----------------------------------------------------------------------------------
RULES = SplitRules()


def make_manifest(spark, n=1500):
    materials = ["steel", "glass", "asphalt", "wood", "masonry", "plaster"]
    sources = ["crackseg9k", "sdx", "mvtec", "kolektor1", "wood", "gc10"]
    rows = []
    for i in range(n):
        h = int(hashlib.md5(str(i).encode()).hexdigest(), 16)
        source = sources[h % 6]
        material = materials[(h >> 8) % 6]
        role = ["positive", "positive", "scratch", "negative", "hard_negative"][(h >> 16) % 5]
        grp = "hot" if i % 3 == 0 and material == "asphalt" else f"g{(h >> 24) % 400}-{material}"
        sub = "mvtec_scratch" if source == "mvtec" and role == "scratch" else source
        px = (h >> 40) % 500 + 1 if role in ("positive", "scratch") else 0
        rows.append((f"n{i}", grp, f"p{i}", source, sub, material, role, px, px / 1000))
    return spark.createDataFrame(rows, "name STRING, grp STRING, phash STRING, source STRING, subsource STRING, material STRING, role STRING, crack_px INT, crack_px_frac DOUBLE")


@pytest.fixture(scope="module")
def routed(spark):
    return split.assign(make_manifest(spark), RULES).toPandas()


def test_every_row_gets_one_split(routed):
    assert len(routed) == 1500 and routed.name.is_unique and routed.split.notna().all()


def test_routing_rules(routed):
    pos = routed[routed.role == "positive"]
    own = (pos.source == "sdx")
    assert set(pos[(pos.material == "wood") & ~own].split) == {"test_unseen_material"}
    assert set(pos[(pos.material == "masonry") & ~own].split) == {"val_unseen_material"}
    assert set(routed[routed.subsource == "mvtec_scratch"].split) == {"test_scratch_blob"}
    assert set(routed[(routed.source == "sdx") & (routed.role == "scratch")].split) <= {"train", "val", "test_factory_scratch"}
    held = pos[(pos.source == "mvtec") & ~pos.material.isin(["wood", "masonry"])]
    assert set(held[held.material.isin(RULES.factory_materials)].split) == {"test_factory"}


def test_groups_of_positives_are_never_cut(routed):
    rest = routed[(routed.role == "positive") & routed.source.isin(["crackseg9k", "gc10", "wood"]) & ~routed.material.isin(["wood", "masonry"])]
    assert (rest.groupby("grp").split.nunique() == 1).all()


def test_assignment_ignores_partitioning(spark, routed):
    again = split.assign(make_manifest(spark).repartition(11, "phash"), RULES).toPandas()
    assert dict(zip(again.name, again.split)) == dict(zip(routed.name, routed.split))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 97, 100])
def test_quartile_equals_a_quantile_cut_of_ranks(spark, n):
    fg = [((i * 37) % 11) / 11 for i in range(n)]
    stats = spark.createDataFrame([(f"g{i:03d}", "m", v, 1) for i, v in enumerate(fg)], "grp STRING, material STRING, fg DOUBLE, n INT")
    got = [r["fgb"] for r in split.with_fg_quartile(stats).orderBy("grp").collect()]
    want = [0] if n == 1 else list(pd.qcut(pd.Series(fg).rank(method="first"), 4, labels=False))
    assert got == want


def test_strata_keep_their_fractions(spark):
    stats = spark.createDataFrame([(f"g{i}", "a" if i < 40 else "b", 0) for i in range(42)], "grp STRING, material STRING, fgb INT")
    out = split.stratified_assign(stats, RULES).toPandas()
    big = out[out.material == "a"].group_split.value_counts().to_dict()
    assert big == {"train": 32, "val": 6, "test": 2}
    assert set(out[out.material == "b"].group_split) == {"train"}


def test_gates_catch_planted_faults_and_stay_quiet_otherwise(spark):
    base = [("a", "g1", "h1", "steel", "positive", "train", 5), ("b", "g2", "h2", "steel", "scratch", "train", 5), ("c", "g3", "h3", "steel", "scratch", "val", 5)]
    base += [(f"e{i}", f"x{i}", f"y{i}", m, "positive", s, 5) for i, (s, m) in enumerate([
        ("val_unseen_material", "masonry"), ("test_seen", "asphalt"), ("test_factory", "steel"), ("test_factory_scratch", "steel"), ("test_unseen_material", "wood")])]
    base += [("q", "xq", "yq", "steel", "scratch", "test_scratch_blob", 5), ("n", "xn", "yn", "wood", "negative", "test_negatives", 0)]
    cols = "name STRING, grp STRING, phash STRING, material STRING, role STRING, split STRING, crack_px INT"
    def report(rows):
        m = spark.createDataFrame(rows, cols).withColumn("subsource", F.when(F.col("split") == "test_scratch_blob", "mvtec_scratch").otherwise("s"))
        return gates.gate_report(m, RULES)
    clean = report(base)
    assert all(r["ok"] for r in clean.collect())
    gates.enforce(clean)
    bad = report(base + [("z", "g1", "h9", "steel", "negative", "test_negatives", 3), ("a", "g9", "h3", "wood", "positive", "train", 1), ("k", "k", "k", "steel", "positive", "extra", 1)])
    broken = {r["gate"] for r in bad.collect() if not r["ok"]}
    assert broken == {"leak_group", "leak_hash", "negatives_with_crack", "unseen_in_train", "dup_names", "unknown_split"}
    with pytest.raises(gates.GateError):
        gates.enforce(bad)


def test_fingerprint_depends_on_content_only(spark):
    m = spark.createDataFrame([(f"n{i}", "train" if i % 3 else "val") for i in range(50)], "name STRING, split STRING")
    a, b = corpus.fingerprint(m).first(), corpus.fingerprint(m.repartition(5).orderBy(F.desc("name"))).first()
    assert a == b and corpus.fingerprint(m.withColumn("split", F.lit("train"))).first() != a


def test_quota_spread_picks_even_positions(spark):
    rows = [(f"n{i:02d}", "s", "r", "m", 10 + i, 5) for i in range(10)]
    m = spark.createDataFrame(rows, "name STRING, split STRING, role STRING, material STRING, h INT, w INT")
    for k in (1, 2, 4, 20):
        q = spark.createDataFrame([("s", "r", "m", k)], "split STRING, role STRING, material STRING, k INT")
        got = sorted(r["name"] for r in corpus.quota_spread(m, q, ["split", "role", "material"]).collect())
        idx = sorted({int(round(i * 9 / max(k - 1, 1))) for i in range(min(k, 10))})
        assert got == [f"n{i:02d}" for i in idx]


def test_class_weights_are_clipped(spark):
    roles = ["negative"] * 100 + ["positive"] * 50 + ["scratch"] * 2
    m = spark.createDataFrame([(r, 1) for r in roles], "role STRING, crack_px INT")
    w = corpus.class_weights(m).first()
    assert (w["w_background"], w["w_crack"], w["w_scratch"]) == (1.0, 2.0, 6.0)
    assert math.isclose(w["w_crack"], 2.0)


def test_missing_material_breaks_the_headline_gate(spark):
    rules = SplitRules()
    rows = spark.createDataFrame([("test_factory", None, "s", 0), ("test_unseen_material", None, "s", 0), (None, "x", "s", 0)], "split STRING, material STRING, subsource STRING, crack_px LONG")
    found = gates.row_gates(rules)
    assert [rows.where(found[k]).count() for k in ("headline_foreign", "unseen_foreign", "unknown_split")] == [1, 1, 1]


def test_quota_of_zero_and_repeated_list_rows(spark):
    manifest = spark.createDataFrame([(f"n{k}", "m", 10 + k, 5) for k in range(9)], "name STRING, material STRING, h INT, w INT")
    for k, want in ((0, []), (1, ["n0"]), (3, ["n0", "n4", "n8"]), (99, ["n0", "n1"]), (9, [f"n{i}" for i in range(9)])):
        quotas = spark.createDataFrame([("m", k)], "material STRING, k LONG")
        assert sorted(r["name"] for r in corpus.quota_spread(manifest, quotas, ["material"]).collect()) == want
    notes = spark.createDataFrame([(1, "crack", "d", 1.0)], "image_id LONG, category STRING, dataset STRING, area DOUBLE")
    lists = spark.createDataFrame([("d", "crack", "use")] * 3 + [("d", "dirt", "reject")] * 2, "dataset STRING, category STRING, verdict STRING")
    assert adapters.allow_deny(notes, lists).count() == 1
