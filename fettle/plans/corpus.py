"""Queries over the corpus: adapters, audits, near-duplicates, licences, fixtures, backgrounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.functions import text
from fettle.operators import adapters, corpus
from fettle.plans.catalog import query
from fettle.session import work_path
from fettle.sources import files

SUB_SQL = """CASE WHEN starts_with(stem,'scratch_') THEN src||'_scratch' WHEN starts_with(stem,'noncrack') THEN 'noncrack' WHEN starts_with(stem,'CRACK500') THEN 'CRACK500'
 WHEN starts_with(stem,'GAPS') THEN 'GAPS' WHEN starts_with(stem,'cracktree') THEN 'cracktree' WHEN starts_with(stem,'CFD') THEN 'CFD' WHEN starts_with(stem,'DeepCrack') THEN 'DeepCrack'
 WHEN starts_with(stem,'Rissbilder') THEN 'Rissbilder' WHEN starts_with(stem,'Volker') THEN 'Volker' WHEN starts_with(stem,'Ceramic') THEN 'Ceramic'
 WHEN substr(stem,1,2) IN ('a_','b_','c_','d_') THEN 'masonry_abcd' ELSE src END"""
SUB_CTE = f"sub AS (SELECT *, {SUB_SQL} AS subsource FROM (SELECT *, split_part(name,'__',1) AS src, split_part(name,'__',2) AS stem FROM named))"


# --- loading ---------------------------------------------------------------------------
@query("load_manifest", "SELECT name, source, material, role, crack_px, crack_px_frac FROM manifest_split WHERE split='val' AND material NOT IN ('fr')")
def _(v):
    path = work_path(v.spark, "manifest")
    cols = ["name", "source", "material", "role", "crack_px", "crack_px_frac", "split"]
    files.write_manifest_csv(v.manifest_split.select(*cols), path)
    schema = "name STRING, source STRING, material STRING, role STRING, crack_px BIGINT, crack_px_frac DOUBLE, split STRING"
    return files.read_manifest(v.spark, path, schema, split="val", exclude_materials=("fr",)).drop("split")


ADAPT_SQL = """WITH listed AS (SELECT DISTINCT doc_id FROM raw_item WHERE adapter='severstal' AND other_px>0), r AS (SELECT i.*, l.doc_id IS NOT NULL AS listed FROM raw_item i LEFT JOIN listed l ON l.doc_id=i.doc_id),
 k AS (SELECT *, CASE adapter WHEN 'crackseg9k' THEN has_mask WHEN 'neu_det' THEN label<>'crazing' WHEN 'dtd' THEN label NOT LIKE '%cracked%' WHEN 'ozgenel' THEN label NOT LIKE '%positive%' WHEN 'kolektor' THEN has_mask AND crack_px=0
 WHEN 'sdnet' THEN label LIKE '%non-cracked%' WHEN 'wood_shards' THEN NOT (knot_px>0 AND crack_px=0) WHEN 'mvtec' THEN crack_px>0 WHEN 'sdx' THEN crack_px>0 WHEN 'casting' THEN label='ok_front' ELSE true END AS keep,
 CASE adapter WHEN 'crackseg9k' THEN CASE WHEN label LIKE 'noncrack%' THEN 'negative' ELSE 'positive' END WHEN 'magnetic_tile' THEN CASE WHEN label LIKE '%Crack%' THEN 'positive' WHEN label LIKE '%Free%' THEN 'negative' ELSE 'hard_negative' END
 WHEN 'neu_det' THEN 'hard_negative' WHEN 'gc10' THEN 'hard_negative' WHEN 'severstal' THEN CASE WHEN listed THEN 'hard_negative' ELSE 'negative' END
 WHEN 'wood' THEN CASE WHEN crack_px>0 OR knot_px>0 THEN 'positive' WHEN other_px>0 THEN 'hard_negative' ELSE 'negative' END WHEN 'wood_shards' THEN CASE WHEN crack_px>0 THEN 'positive' WHEN other_px>0 THEN 'hard_negative' ELSE 'negative' END
 WHEN 'kolektor1' THEN CASE WHEN crack_px>0 THEN 'positive' ELSE 'negative' END WHEN 'mvtec' THEN CASE WHEN label='scratch' THEN 'scratch' ELSE 'positive' END
 WHEN 'sdx' THEN CASE label WHEN 'crack' THEN 'positive' WHEN 'scratch' THEN 'scratch' ELSE 'hard_negative' END ELSE 'negative' END AS role,
 CASE adapter WHEN 'crackseg9k' THEN CASE label WHEN 'noncrack' THEN 'concrete' WHEN 'CRACK500' THEN 'asphalt' WHEN 'Volker' THEN 'concrete' WHEN 'Ceramic' THEN 'ceramic' ELSE 'masonry' END WHEN 'magnetic_tile' THEN 'ceramic' WHEN 'dtd' THEN 'mixed'
 WHEN 'ozgenel' THEN 'concrete' WHEN 'sdnet' THEN 'concrete' WHEN 'kolektor' THEN 'plastic' WHEN 'kolektor1' THEN 'plastic' WHEN 'gc10' THEN 'metal' WHEN 'mvtec' THEN record_material WHEN 'wood' THEN 'wood' WHEN 'wood_shards' THEN 'wood' ELSE 'steel' END AS material,
 CASE adapter WHEN 'wood_shards' THEN 'wood' ELSE adapter END AS source FROM r)"""
ADAPTED = "source||'__'||doc_id AS name, source, CAST(doc_id AS VARCHAR) AS sid, material, CASE WHEN adapter='casting' OR role='positive' THEN 'A' WHEN role='negative' THEN 'C' ELSE 'B' END AS tier, role, CASE WHEN role IN ('positive','scratch') THEN crack_px+CASE WHEN adapter='wood' THEN knot_px ELSE 0 END ELSE 0 END AS crack_px"


def adapted(v):
    raw = v.raw_item.withColumn("sid", F.col("doc_id").cast("string"))
    return adapters.adapt(raw, raw.where("adapter='severstal' AND other_px>0"))


@query("adapter_union", f"{ADAPT_SQL} SELECT {ADAPTED} FROM k WHERE keep")
def _(v):
    return adapted(v)


@query("union_adapters", f"{ADAPT_SQL} SELECT source, role, count(*) AS n FROM k WHERE keep GROUP BY 1,2")
def _(v):
    raw = v.raw_item.withColumn("sid", F.col("doc_id").cast("string"))
    listed = raw.where("adapter='severstal' AND other_px>0")
    parts = [adapters.adapt(raw.where(F.col("adapter") == name), listed, {name: rule}) for name, rule in adapters.RULES.items()]
    return adapters.union_sources(parts).groupBy("source", "role").agg(F.count("*").alias("n"))


@query("label_queue", "SELECT doc_id, label FROM raw_item WHERE adapter='casting' AND label<>'ok_front'")
def _(v):
    return adapters.label_queue(v.raw_item).select("doc_id", "label")


@query("index_upsert", "SELECT name, CASE WHEN doc_id%3=0 THEN 'relabelled' ELSE role END AS role FROM manifest")
def _(v):
    new = v.manifest.where("doc_id%3=0").select("name", F.lit("relabelled").alias("role"))
    return adapters.upsert(v.manifest.select("name", "role"), new)


@query("load_provenance", "SELECT patch_id, kind, material, 'ours' AS src_dir FROM provenance WHERE kind='crack' UNION ALL SELECT patch_id, kind, material, 'engine' FROM provenance")
def _(v):
    p = v.provenance.select("patch_id", "kind", "material")
    return corpus.load_pools([("ours", p, ("crack",)), ("engine", p, None), ("absent", None, ("crack",))])


@query("union_synth", "SELECT patch_id, kind, CASE WHEN kind='crack' THEN crack_px_frac END AS crack_px_frac FROM provenance")
def _(v):
    p = v.provenance
    return adapters.union_sources([p.where("kind='crack'").select("patch_id", "kind", "crack_px_frac"), p.where("kind<>'crack'").select("patch_id", "kind")])


@query("annotations_flatten", "SELECT image_id//100 AS doc, annotation_id, image_id, 'img-'||image_id||'.png' AS file_name, category FROM annotation")
def _(v):
    a = v.annotation.withColumn("doc", F.expr("image_id div 100")).withColumn(
        "category_id", F.expr("CASE category WHEN 'Scratches' THEN 1L WHEN 'PVC pipe crack' THEN 2L WHEN 'objects' THEN 3L ELSE 4L END"))
    per_doc = a.groupBy("doc").agg(
        F.collect_set(F.struct(F.col("image_id").alias("id"), F.format_string("img-%d.png", "image_id").alias("file_name"))).alias("images"),
        F.collect_set(F.struct(F.col("category_id").alias("id"), F.col("category").alias("name"))).alias("categories"),
        F.collect_list(F.struct(F.col("annotation_id").cast("bigint").alias("id"), "image_id", "category_id")).alias("annotations"))
    docs = per_doc.select("doc", F.to_json(F.struct("images", "categories", "annotations")).alias("payload"))
    flat = adapters.flatten_annotations(docs, "doc", "payload")
    return flat.select("doc", F.col("annotation_id").cast("int").alias("annotation_id"), "image_id", "file_name", "category")


# --- names ---------------------------------------------------------------------------------
@query("subsource", f"WITH {SUB_CTE} SELECT name, subsource FROM sub")
def _(v):
    return v.named.select("name", corpus.subsource(F.col("name")).alias("subsource"))


@query("parent_id", r"""SELECT name, CASE WHEN regexp_matches(stem,'^CRACK500_\d+_\d+') THEN src||':CRACK500:'||regexp_extract(stem,'^CRACK500_(\d+_\d+)',1)
 WHEN regexp_matches(stem,'^Rissbilder_for_Florian_\w+?_\d+$') THEN src||':'||regexp_extract(stem,'^(Rissbilder_for_Florian_\w+?)_\d+$',1) WHEN src='sdx' THEN src||':'||stem
 WHEN regexp_matches(stem,'^[a-d]_\d+_') THEN src||':'||regexp_extract(stem,'^([a-d]_\d+)_',1) WHEN src='wood' THEN src||':'||substr(stem,1,4) WHEN src='kolektor1' THEN src||':'||split_part(stem,'_',1)
 ELSE src||':'||regexp_replace(stem,'_crop\d+$','') END AS grp FROM (SELECT name, split_part(name,'__',1) AS src, split_part(name,'__',2) AS stem FROM named)""")
def _(v):
    return v.named.select("name", corpus.parent_id(F.col("name")).alias("grp"))


@query("photo_key", "SELECT doc_id, 'p'||(doc_id%40) AS photo FROM documents")
def _(v):
    name = F.format_string("train/p%d.rf.%s.jpg", F.expr("doc_id%40"), F.md5("text"))
    return v.documents.select("doc_id", corpus.photo_key(name).alias("photo"))


@query("material_refine", f"WITH {SUB_CTE} SELECT name, CASE WHEN name LIKE 'mvtec\\_\\_capsule%' ESCAPE '\\' THEN 'pharma_capsule' WHEN source='kolektor1' THEN 'epoxy' WHEN subsource IN ('Rissbilder','Volker') THEN 'plaster' ELSE material END AS material, (SELECT count(*) FROM sub WHERE name LIKE 'mvtec\\_\\_capsule%' ESCAPE '\\' OR source='kolektor1' OR subsource IN ('Rissbilder','Volker')) AS n_relabelled FROM sub")
def _(v):
    refined = corpus.refine_material(v.named.withColumn("subsource", corpus.subsource(F.col("name"))))
    changed = refined.agg(F.sum(F.col("relabelled").cast("bigint")).alias("n")).scalar()
    return refined.select("name", "material").withColumn("n_relabelled", changed)


# --- audits ----------------------------------------------------------------------------------
W = "mean_crack_width"


@query("width_audit_source", f"""SELECT source, count(*) AS n, round(avg({W}),6) AS mean_w, round(quantile_cont({W},0.5),6) AS median_w, round(quantile_cont({W},0.1),6) AS p10, round(quantile_cont({W},0.9),6) AS p90, round(avg(crack_px_frac)*100,6) AS fg_pct,
 CASE WHEN quantile_cont({W},0.5)<3 THEN 'skeleton' WHEN quantile_cont({W},0.5)<5 THEN 'thin' ELSE 'full' END AS verdict FROM manifest WHERE role='positive' AND crack_px>0 GROUP BY source""")
def _(v):
    return corpus.width_audit_by_source(v.manifest)


AUDIT_SQL = f"SELECT source AS subsource, count(*) AS n, round(quantile_cont({W},0.5),6) AS median_w, round(stddev_samp({W})/greatest(avg({W}),1e-6),6) AS cv, coalesce(stddev_samp({W})/greatest(avg({W}),1e-6)<0.05 OR (quantile_cont({W},0.5)<5.6 AND stddev_samp({W})/greatest(avg({W}),1e-6)<0.25),false) AS reject FROM manifest WHERE role='positive' AND crack_px>0 GROUP BY source"


def audit(v):
    return corpus.width_audit_by_subsource(v.manifest.withColumn("subsource", F.col("source")), min_median=5.6)


@query("width_audit_subsource", AUDIT_SQL)
def _(v):
    return audit(v)


@query("skeleton_drop", f"SELECT name, source AS subsource FROM manifest WHERE source NOT IN (SELECT subsource FROM ({AUDIT_SQL}) WHERE reject)")
def _(v):
    return corpus.without_skeletons(v.manifest.withColumn("subsource", F.col("source")), audit(v)).select("name", "subsource")


@query("role_by_material", "SELECT material, count(*) AS n, count(*) FILTER (WHERE role='positive') AS positive, count(*) FILTER (WHERE role='hard_negative') AS hard_negative, count(*) FILTER (WHERE role='negative') AS negative FROM manifest GROUP BY 1")
def _(v):
    return corpus.role_by_material(v.manifest)


@query("dup_count", "SELECT count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY phash) AS c FROM manifest WHERE phash<>'') WHERE c>1")
def _(v):
    return corpus.duplicate_count(v.manifest)


DEDUP_SQL = "SELECT * FROM manifest WHERE phash='' UNION ALL SELECT * FROM (SELECT * FROM manifest WHERE phash<>'' QUALIFY row_number() OVER (PARTITION BY phash ORDER BY doc_id)=1)"


@query("dedup_keep_first", f"SELECT name, phash FROM ({DEDUP_SQL})")
def _(v):
    return corpus.keep_first(v.manifest.select("name", "phash", "doc_id"), "doc_id").select("name", "phash")


@query("kept_report", f"""WITH d AS ({DEDUP_SQL}) SELECT 'rows' AS section, 'input' AS key, count(*) AS n FROM manifest UNION ALL SELECT 'rows','kept',count(*) FROM d
 UNION ALL SELECT 'positives', material, count(*) FROM d WHERE role='positive' AND crack_px>0 GROUP BY material UNION ALL SELECT 'roles', role, count(*) FROM d GROUP BY role""")
def _(v):
    m = v.manifest.select("name", "phash", "doc_id", "material", "role", "crack_px")
    return corpus.kept_report(m, "doc_id")


@query("drop_duplicate_names", "SELECT DISTINCT name FROM (SELECT name FROM manifest UNION ALL SELECT name FROM manifest WHERE doc_id%2=0)")
def _(v):
    m = v.manifest.select("name", "doc_id")
    return m.unionByName(m.where("doc_id%2=0")).dropDuplicates(["name"]).select("name")


@query("manifest_stats_merge", "SELECT name, material, crack_px AS crack_px_raw, crack_px+1 AS crack_px FROM manifest")
def _(v):
    stats = v.manifest.select("name", (F.col("crack_px") + 1).alias("crack_px"))
    return corpus.merge_stats(stats, v.manifest.select("name", "material", "crack_px"))


# --- licences and release ---------------------------------------------------------------------
LIC = "coalesce(l.licence,'unregistered')"


@query("licence_resolve", f"SELECT s.source, {LIC} AS licence, coalesce(redistribute,false) AS images_included, s.n AS rows FROM (SELECT source, count(*) AS n FROM manifest GROUP BY 1) s LEFT JOIN licence l ON l.source=s.source")
def _(v):
    return corpus.licence_table(v.manifest, v.licence)


@query("release_manifest", f"SELECT name, m.source, split, {LIC} AS licence, coalesce(redistribute,false) AS images_included FROM manifest_split m LEFT JOIN licence l ON l.source=m.source")
def _(v):
    return corpus.with_licence(v.manifest_split.select("name", "source", "split"), v.licence)


@query("open_licence_share", "SELECT count(*) FILTER (WHERE redistribute) AS n_open, count(*) AS n, round(100.0::DOUBLE*count(*) FILTER (WHERE redistribute)/count(*),1) AS open_pct FROM manifest m LEFT JOIN licence l ON l.source=m.source")
def _(v):
    return corpus.open_share(v.manifest, v.licence)


@query("licence_json", f"SELECT s.source, CAST(to_json({{'licence': {LIC}, 'images_redistributed': coalesce(redistribute,false), 'rows': s.n}}) AS VARCHAR) AS json FROM (SELECT source, count(*) AS n FROM manifest GROUP BY 1) s LEFT JOIN licence l ON l.source=s.source")
def _(v):
    return corpus.licence_json(v.manifest, v.licence)


@query("sample_per_source", "SELECT source, name FROM manifest QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0:'||name), name)<=5")
def _(v):
    return corpus.sample_per_source(v.manifest.select("source", "name"), 5)


@query("cap_per_group", "SELECT material, role, name FROM manifest QUALIFY row_number() OVER (PARTITION BY material, role ORDER BY md5('0:'||name), name)<=20")
def _(v):
    return corpus.cap_per_group(v.manifest.select("material", "role", "name"), ["material", "role"], 20, "name")


@query("systematic_sample", "SELECT name FROM (SELECT name, row_number() OVER (ORDER BY md5('0:'||name), name)-1 AS i, count(*) OVER () AS n FROM manifest WHERE role='negative') WHERE i % greatest(1, n//60)=0 AND i // greatest(1, n//60) < 60")
def _(v):
    return adapters.systematic_sample(v.manifest.where("role='negative'").select("name"), "name", 60)


QUOTAS = [("train", "negative", "en", 6), ("val", "negative", "en", 4), ("test_seen", "negative", "fr", 3), ("train", "positive", "en", 5), ("test_negatives", "negative", "de", 2),
          ("val", "positive", "en", 1), ("train", "scratch", "en", 40)]
QUOTA_SQL = "(VALUES " + ",".join(f"('{s}','{r}','{m}',{k})" for s, r, m, k in QUOTAS) + ") AS q(split,role,material,k)"
PICK_CTE = f"""picked AS (SELECT * FROM (SELECT m.*, k, row_number() OVER w AS rn, count(*) OVER (PARTITION BY m.split,m.role,m.material) AS n FROM manifest_split m JOIN {QUOTA_SQL} ON q.split=m.split AND q.role=m.role AND q.material=m.material
 JOIN licence l ON l.source=m.source AND l.redistribute WINDOW w AS (PARTITION BY m.split,m.role,m.material ORDER BY greatest(h,w), md5('0:'||name), name))
 WHERE list_contains(list_transform(range(least(k,n)), lambda i: CAST(round_even(i*(n-1)/greatest(k-1,1)::DOUBLE,0) AS BIGINT)), rn-1))"""


def picked(v):
    quotas = v.spark.createDataFrame(QUOTAS, "split STRING, role STRING, material STRING, k INT")
    opened = v.manifest_split.join(v.licence.where("redistribute").select("source"), "source", "left_semi")
    return corpus.quota_spread(opened, quotas, ["split", "role", "material"])


@query("quota_spread", f"WITH {PICK_CTE} SELECT name, split, role, material FROM picked")
def _(v):
    return picked(v).select("name", "split", "role", "material")


@query("fixture_leak", f"WITH {PICK_CTE} SELECT name, split, grp FROM picked WHERE grp IN (SELECT grp FROM manifest_split WHERE split IN ('train','val','wood_bg'))")
def _(v):
    return corpus.fixture_leaks(picked(v), v.manifest_split).select("name", "split", "grp")


@query("fixture_summary", f"WITH {PICK_CTE} SELECT count(*) AS n, count(*) FILTER (WHERE crack_px>0) AS n_with_defect, count(*) FILTER (WHERE crack_px=0) AS n_clean, string_agg(DISTINCT material, ',' ORDER BY material) AS materials, min(greatest(h,w)) AS min_side, max(greatest(h,w)) AS max_side, quantile_cont(greatest(h,w)::DOUBLE,0.5) AS median_side FROM picked")
def _(v):
    return corpus.fixture_summary(picked(v))


# --- reports ------------------------------------------------------------------------------------
@query("split_report", "SELECT split, count(*) AS n, count(*) FILTER (WHERE role='positive') AS crack, count(*) FILTER (WHERE role='scratch') AS scratch, string_agg(DISTINCT material, ',' ORDER BY material) AS materials FROM manifest_split GROUP BY 1")
def _(v):
    return corpus.split_report(v.manifest_split)


@query("material_split_crosstab", "SELECT material, count(*) FILTER (WHERE split='train') AS train, count(*) FILTER (WHERE split='val') AS val, count(*) FILTER (WHERE split='test_seen') AS test_seen FROM manifest_split WHERE role IN ('positive','scratch') GROUP BY 1")
def _(v):
    return corpus.material_split_crosstab(v.manifest_split, ("train", "val", "test_seen"))


@query("rows_per_split", "SELECT split, count(*) AS n FROM manifest_split GROUP BY 1 ORDER BY 2 DESC, 1")
def _(v):
    return corpus.rows_per_split(v.manifest_split)


@query("class_weights", "WITH c AS (SELECT greatest(count(*) FILTER (WHERE role NOT IN ('positive','scratch')),1) AS background, greatest(count(*) FILTER (WHERE role='positive' AND crack_px>0),1) AS crack, greatest(count(*) FILTER (WHERE role='scratch' AND crack_px>0),1) AS scratch FROM manifest) SELECT *, 1.0::DOUBLE AS w_background, round(least(greatest(background/crack::DOUBLE,1.0),6.0),6) AS w_crack, round(least(greatest(background/scratch::DOUBLE,1.0),6.0),6) AS w_scratch FROM c")
def _(v):
    return corpus.class_weights(v.manifest)


LANE = "CAST(sum(('0x'||substr(md5(name||'='||split),{0},8))::BIGINT) % 2147483647 AS BIGINT)"


@query("split_fingerprint", "SELECT count(*) AS n, " + ", ".join(f"{LANE.format(8 * i + 1)} AS lane{i}" for i in range(4)) + " FROM manifest_split")
def _(v):
    return corpus.fingerprint(v.manifest_split)


@query("plan_size", "SELECT count(*) AS sources, CAST(sum(b) AS BIGINT) AS bytes, format('{:.1f}KB', sum(b)::DOUBLE/1024) AS size FROM (SELECT folder, sum(bytes)::BIGINT AS b FROM file_list WHERE length(folder)=5 GROUP BY 1) HAVING sum(b) BETWEEN 1024 AND 1048575 UNION ALL SELECT count(*), CAST(sum(b) AS BIGINT), format('{:.1f}MB', sum(b)::DOUBLE/1048576) FROM (SELECT folder, sum(bytes)::BIGINT AS b FROM file_list WHERE length(folder)=5 GROUP BY 1) HAVING sum(b) >= 1048576")
def _(v):
    per = v.file_list.where("length(folder)=5").groupBy("folder").agg(F.sum("bytes").alias("b"))
    return per.agg(F.count("*").alias("sources"), F.sum("b").alias("bytes")).withColumn("size", text.human_size(F.col("bytes")))


@query("host_groups", r"SELECT regexp_extract(url,'^[a-z]+://([^/:?#]+)',1) AS host, count(*) AS n FROM pages GROUP BY 1")
def _(v):
    return v.pages.groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


@query("image_mask_pairs", "SELECT count(*) FILTER (WHERE i AND m) AS paired, count(*) FILTER (WHERE i AND NOT m) AS image_only, count(*) FILTER (WHERE m AND NOT i) AS mask_only FROM (SELECT doc_id%3<>0 AS i, doc_id%5<>0 AS m FROM documents) WHERE i OR m")
def _(v):
    stems = v.documents.select("doc_id", F.col("doc_id").cast("string").alias("stem"))
    return adapters.pair_counts(stems.where("doc_id%3<>0"), stems.where("doc_id%5<>0"))


SHARD_SQL = "SELECT l_suppkey AS shard, count(*) AS images, count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS hits FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT') o ON o_orderkey=l_orderkey GROUP BY 1"


@query("shard_hits", SHARD_SQL)
def _(v):
    members = v.lineitem.select(F.col("l_suppkey").alias("shard"), F.col("l_orderkey").alias("image_id"))
    return adapters.shard_hits(members, v.orders.where("o_orderpriority='1-URGENT'").select(F.col("o_orderkey").alias("image_id")))


# --- backgrounds and synthetic rows -------------------------------------------------------------
BG = "role='negative' AND crack_px=0 AND source IN ('src0','src1','src2','src5','src8') AND name IN (SELECT name FROM manifest_split WHERE split IN ('train','wood_bg'))"
OK = "least(h,w)>=96 AND brightness BETWEEN 28 AND 228 AND contrast>=9 AND dark_frac<=0.35 AND blown_frac<=0.35"
BG_SOURCES = ("src0", "src1", "src2", "src5", "src8")


@query("train_side_only", "SELECT name FROM manifest_split WHERE split IN ('train','wood_bg')")
def _(v):
    return corpus.train_side_only(v.manifest.select("name"), v.manifest_split.select("name", "split"))


@query("substrate_eligible", f"SELECT name, material FROM manifest WHERE {BG} AND {OK}")
def _(v):
    return corpus.background_candidates(v.manifest, v.manifest_split, BG_SOURCES).where(corpus.usable_surface()).select("name", "material")


@query("substrate_counts", f"SELECT material, count(*) FILTER (WHERE {OK}) AS kept, count(*) FILTER (WHERE NOT ({OK})) AS rejected FROM manifest WHERE {BG} AND least(h,w)>=96 GROUP BY 1")
def _(v):
    return corpus.background_counts(corpus.background_candidates(v.manifest, v.manifest_split, BG_SOURCES))


@query("exclude_materials", "SELECT name, material FROM manifest WHERE material NOT IN ('fr','de')")
def _(v):
    return files.without_materials(v.manifest, ("fr", "de")).select("name", "material")


@query("role_pools", "SELECT 1 AS classes, name, CASE WHEN role='positive' THEN 'positive' ELSE 'negative' END AS pool FROM manifest WHERE (role='positive' AND crack_px>0) OR role<>'positive' UNION ALL SELECT 3, name, CASE WHEN role IN ('positive','scratch') THEN 'positive' ELSE 'negative' END FROM manifest WHERE (role IN ('positive','scratch') AND crack_px>0) OR role NOT IN ('positive','scratch')")
def _(v):
    m = v.manifest.select("name", "role", "crack_px")
    one, three = (corpus.role_pools(m, k).select(F.lit(k).alias("classes"), "name", "pool") for k in (1, 3))
    return one.unionByName(three)


@query("synth_leak_drop", "SELECT patch_id, bg_id FROM provenance WHERE regexp_replace(bg_id,'_(crop|c)\\d+$','') NOT IN (SELECT name FROM manifest_split WHERE split NOT IN ('train','wood_bg'))")
def _(v):
    return corpus.drop_synthetic_leaks(v.provenance, v.manifest_split).select("patch_id", "bg_id")


@query("synth_summary", "SELECT material, kind, count(*) AS n, count(*) FILTER (WHERE crack_px_frac>=0.0006) AS kept, round(100.0::DOUBLE*count(*) FILTER (WHERE crack_px_frac>=0.0006)/count(*),2) AS kept_pct, round(avg(crack_px_frac),9) AS mean_fg FROM provenance GROUP BY 1,2")
def _(v):
    return corpus.synth_summary(v.provenance)


@query("faint_label_drop", "SELECT patch_id FROM provenance WHERE crack_px_frac>=0.0006")
def _(v):
    return v.provenance.where(F.col("crack_px_frac") >= corpus.FAINT_LABEL).select("patch_id")


# --- annotations ---------------------------------------------------------------------------------
CLASS_SQL = "CASE WHEN lower(trim(category)) IN ('objects','object','phone','glass','glass-detection','molding','null','background','paper crack','dummy crack','dirt','porosity') THEN NULL WHEN lower(category) LIKE '%scratch%' THEN 'scratch' WHEN regexp_matches(lower(category),'crack|fracture') THEN 'crack' END"


@query("class_name_map", f"SELECT category, {CLASS_SQL} AS class_code, count(*) AS n FROM annotation GROUP BY 1")
def _(v):
    return v.annotation.groupBy("category").agg(F.count("*").alias("n")).withColumn("class_code", adapters.class_of_category(F.col("category")))


@query("gate_fg_fraction", "SELECT count(*) AS n, count(*) FILTER (WHERE fg_frac>0.15) AS rejected FROM annotation")
def _(v):
    return v.annotation.agg(F.count("*").alias("n"), F.sum((adapters.shape_reason(F.col("fg_frac"), F.lit(0.0)) == "whole-object").cast("bigint")).alias("rejected"))


@query("gate_blob_width", "SELECT image_id, annotation_id, mean_width FROM annotation WHERE fg_frac<=0.15 AND mean_width>20")
def _(v):
    return v.annotation.where(adapters.shape_reason(F.col("fg_frac"), F.col("mean_width")) == "blob-shaped").select("image_id", "annotation_id", "mean_width")


LISTS = [("rf0", "crack", "use"), ("rf1", "scratches", "reject"), ("rf2", "scratches", "use")]
REASON_SQL = f"""SELECT *, {CLASS_SQL} AS class_code, CASE WHEN {CLASS_SQL} IS NULL THEN category WHEN dataset='rf1' AND category='Scratches' THEN category||'(rejected)'
 WHEN dataset='rf0' AND {CLASS_SQL}<>'crack' THEN category||'(not in use)' WHEN dataset='rf2' AND category<>'Scratches' THEN category||'(not in use)' END AS reason FROM annotation"""


def judged(v):
    return adapters.allow_deny(v.annotation, v.spark.createDataFrame(LISTS, "dataset STRING, category STRING, verdict STRING"))


@query("gate_allow_deny", f"SELECT image_id, annotation_id, dataset, class_code FROM ({REASON_SQL}) WHERE reason IS NULL")
def _(v):
    return judged(v).where("reason IS NULL").select("image_id", "annotation_id", "dataset", "class_code")


@query("skip_reasons", f"SELECT coalesce(reason, CASE WHEN fg_frac>0.15 THEN 'whole-object' WHEN mean_width>20 THEN 'blob-shaped' ELSE 'kept' END) AS reason, count(*) AS n FROM ({REASON_SQL}) GROUP BY 1")
def _(v):
    why = F.coalesce("reason", adapters.shape_reason(F.col("fg_frac"), F.col("mean_width")), F.lit("kept"))
    return judged(v).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("owner_class", f"SELECT image_id, arg_max(class_code, (px, CASE WHEN class_code='crack' THEN 1 ELSE 0 END)) AS owner, max(px) AS px FROM (SELECT image_id, class_code, sum(area) AS px FROM (SELECT *, {CLASS_SQL} AS class_code FROM annotation) WHERE class_code IS NOT NULL GROUP BY 1,2) GROUP BY 1")
def _(v):
    return adapters.owner_class(v.annotation.withColumn("class_code", adapters.class_of_category(F.col("category"))))


@query("class_precedence", """SELECT p_brand AS brand, CASE WHEN bool_or(p_size%10=1) THEN 'crack' WHEN bool_or(p_size%7=2) THEN 'scratch' ELSE 'negative' END AS kind FROM (SELECT *, p_partkey//4 AS g FROM part) GROUP BY p_brand, g, p_type""")
def _(v):
    both = F.expr("filter(array(CASE WHEN p_size%10=1 THEN 'micro_crack' END, CASE WHEN p_size%7=2 THEN 'deep_scratch' END, 'rust'), x -> x IS NOT NULL)")
    sample = v.part.withColumn("g", F.expr("p_partkey div 4")).withColumn("c", both).groupBy("p_brand", "g", "p_type").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("classes"))
    return sample.select(F.col("p_brand").alias("brand"), adapters.class_precedence(F.col("classes")).alias("kind"))


