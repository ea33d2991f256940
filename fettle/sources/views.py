"""Store, corpus and evaluation tables laid over the given parquet tables.

Each view is stated once, as SQL in a form that Spark and DuckDB share; the few places where
the dialects differ go through :class:`Dialect`. Spark resolves a view lazily from DataFrames,
the oracle statements inline it as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Declared schemas: no job is spent on inference.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE,"
                " l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def pick(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def h32(self, x: str) -> str:
        return self.pick(
            f"CAST(conv(substr(md5({x}),1,8),16,10) AS BIGINT)", f"CAST(('0x'||substr(md5({x}),1,8)) AS BIGINT)"
        )

    def sha256(self, x: str) -> str:
        return self.pick(f"sha2({x},256)", f"sha256({x})")

    def strip(self, x: str, rx: str) -> str:
        return self.pick(f"regexp_replace({x},'{rx}','')", f"regexp_replace({x},'{rx}','','g')")

    def plus_seconds(self, ts: str, n: str) -> str:
        return self.pick(f"({ts} + make_dt_interval(0,0,0,{n}))", f"({ts} + to_seconds({n}))")


SPARK, DUCK = Dialect(True), Dialect(False)


def _defect_region(d: Dialect) -> str:
    # Spark knows rows as dealt by the column that the window names: by inspection_id, later joins and groupings on it move no rows.
    key, rows = d.pick("inspection_id", "l_orderkey"), d.pick("(SELECT *, l_orderkey AS inspection_id FROM lineitem) l", "lineitem")
    return f"""SELECT row_number() OVER (PARTITION BY {key} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS region_index,
 {d.pick('inspection_id', 'l_orderkey AS inspection_id')}, CASE WHEN l_returnflag='R' THEN 'scratch' ELSE 'crack' END AS class_code,
 CAST(l_quantity AS INT) AS area_px, l_extendedprice/100 AS length_px, 1+100*l_tax AS max_width_px,
 CAST(l_partkey%200 AS INT) AS bbox_x, CAST(l_suppkey%200 AS INT) AS bbox_y, CAST(l_quantity AS INT) AS bbox_width, CAST(1+l_linenumber AS INT) AS bbox_height,
 l_partkey%200+l_quantity/2 AS centroid_x, l_suppkey%200+(1+l_linenumber)/CAST(2.0 AS DOUBLE) AS centroid_y
 FROM {rows}"""


def _inspection(d: Dialect) -> str:
    return f"""SELECT o.o_orderkey AS inspection_id, concat('batch-', CAST(o.o_custkey AS STRING), '/item-', CAST(o.o_orderkey AS STRING)) AS product_id,
 {d.plus_seconds('o.o_orderdate', 'o.o_orderkey%43200')} AS captured_at, {d.plus_seconds('o.o_orderdate', 'o.o_orderkey%86400')} AS processed_at,
 o.o_orderpriority AS material_code, n.n_name AS station_code,
 CASE WHEN o.o_orderkey%20=7 THEN NULL ELSE year(o.o_orderdate)*100+month(o.o_orderdate) END AS batch_run_id,
 CASE WHEN o.o_orderkey%50=3 THEN NULL ELSE o.o_totalprice/1000 END AS latency_ms, coalesce(r.n,0) AS region_count,
 CASE WHEN r.n IS NOT NULL THEN 'regions_found' WHEN o.o_orderkey%10=0 THEN 'acquisition_failure' WHEN o.o_orderkey%10=1 THEN 'processing_failure' ELSE 'clean' END AS status,
 o.o_custkey%10 AS model_version_id, CASE WHEN o.o_orderpriority='1-URGENT' THEN 2 ELSE 1 END AS profile_id,
 {d.sha256('CAST(o.o_orderkey AS STRING)')} AS image_sha256, concat('store/', CAST(o.o_orderkey AS STRING), '.png') AS source_image_path,
 CASE WHEN r.n IS NOT NULL THEN concat('store/', CAST(o.o_orderkey AS STRING), '_overlay.png') END AS overlay_image_path,
 CASE WHEN r.n IS NULL AND o.o_orderkey%10=0 THEN 'DECODE_FAILED' END AS error_code,
 CASE WHEN r.n IS NULL AND o.o_orderkey%10=1 THEN 'inference failed' END AS error_message
 FROM orders o LEFT JOIN (SELECT inspection_id, count(*) AS n FROM defect_region GROUP BY inspection_id) r ON r.inspection_id=o.o_orderkey
 LEFT JOIN customer c ON c.c_custkey=o.o_custkey LEFT JOIN nation n ON n.n_nationkey=c.c_nationkey"""


def _batch_run(d: Dialect) -> str:
    return """SELECT batch_run_id, min(processed_at) AS started_at, CASE WHEN batch_run_id%12=5 THEN NULL ELSE max(processed_at) END AS finished_at,
 min(material_code) AS material_code, count(*) AS image_count FROM inspection WHERE batch_run_id IS NOT NULL GROUP BY batch_run_id
 UNION ALL SELECT max(batch_run_id)+1, max(processed_at), max(processed_at), '1-URGENT', 0 FROM inspection"""


def _profile(d: Dialect) -> str:
    # One global profile, and for every material that has orders a current and an older one.
    return """SELECT 1 AS profile_id, CAST(NULL AS STRING) AS material_code, 3 AS version_no, CAST(0.30 AS DOUBLE) AS crack_threshold, CAST(0.20 AS DOUBLE) AS scratch_threshold,
 24 AS minimum_area_px, 6 AS minimum_skeleton_px, true AS is_active FROM (SELECT count(*) FROM orders) g
 UNION ALL SELECT 2*k, o_orderpriority, 3, CAST(0.30 AS DOUBLE)+k*CAST(0.05 AS DOUBLE), CAST(0.20 AS DOUBLE), 24, 6, k%3<>2 FROM (SELECT DISTINCT CAST(substr(o_orderpriority,1,1) AS INT) AS k, o_orderpriority FROM orders) p
 UNION ALL SELECT 2*k+1, o_orderpriority, 2, CAST(0.40 AS DOUBLE), CAST(0.20 AS DOUBLE), 24, 6, false FROM (SELECT DISTINCT CAST(substr(o_orderpriority,1,1) AS INT) AS k, o_orderpriority FROM orders) q"""


def _material(d: Dialect) -> str:
    return """SELECT DISTINCT CAST(substr(o_orderpriority,1,1) AS BIGINT) AS material_id, o_orderpriority AS material_code, lower(o_orderpriority) AS material_name,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'supported' WHEN '2' THEN 'thin_coverage' WHEN '3' THEN 'one_product_only' WHEN '4' THEN 'under_evaluation' ELSE 'not_supported' END AS support_status,
 CASE WHEN o_orderpriority LIKE '5%' THEN 'no masks' END AS notes FROM orders"""


def _station(d: Dialect) -> str:
    return """SELECT n_nationkey AS station_id, n_name AS station_code, r_name AS line_code,
 CASE WHEN n_nationkey%3=0 THEN NULL ELSE n_nationkey/CAST(1000 AS DOUBLE) END AS mm_per_pixel
 FROM nation JOIN region ON r_regionkey=n_regionkey"""


def _model_version(d: Dialect) -> str:
    return f"""SELECT s_suppkey AS model_version_id, concat('model-',CAST(s_suppkey AS STRING),'.onnx') AS file_name, concat('v',CAST(s_nationkey AS STRING)) AS version,
 {d.sha256('s_name')} AS artefact_sha256, CASE WHEN s_suppkey%3=0 THEN NULL ELSE s_suppkey*1000 END AS parameter_count,
 CASE WHEN s_suppkey%4=0 THEN NULL ELSE s_acctbal/100 END AS latency_ms, s_suppkey%5=2 AS is_active FROM supplier"""


def _manifest(d: Dialect) -> str:
    return f"""SELECT concat(d.source,'__',CAST(d.doc_id AS STRING)) AS name, d.doc_id, d.source, CASE WHEN d.doc_id%97<>13 THEN d.lang END AS material,
 CASE WHEN l.doc_id IS NULL THEN 'negative' WHEN l.toxic=1 THEN 'hard_negative' WHEN l.quality=1 THEN 'positive' ELSE 'scratch' END AS role,
 CASE WHEN l.doc_id IS NOT NULL AND l.toxic=0 THEN d.n_chars ELSE 0 END AS crack_px,
 CASE WHEN l.doc_id IS NOT NULL AND l.toxic=0 THEN d.n_chars ELSE 0 END/(d.n_chars+CAST(4000 AS DOUBLE)) AS crack_px_frac,
 d.width AS mean_crack_width,
 CASE WHEN d.doc_id%29=0 THEN '' ELSE d.digest END AS phash, concat(d.source,':',substr(d.digest,1,2)) AS grp,
 64+d.doc_id%192 AS h, 64+(d.doc_id*7)%256 AS w, 20+d.doc_id%220 AS brightness, 5+d.doc_id%40 AS contrast,
 (d.doc_id%10)/CAST(20.0 AS DOUBLE) AS dark_frac, (d.doc_id%7)/CAST(15.0 AS DOUBLE) AS blown_frac
 FROM (SELECT doc_id, source, lang, n_chars, length(text)*CAST(1.0 AS DOUBLE)/greatest(1,length(text)-length(replace(text,' ',''))) AS width,
  md5({d.strip('lower(text)', '[^a-z0-9]+')}) AS digest FROM documents) d LEFT JOIN labels l ON l.doc_id=d.doc_id"""


def _manifest_split(d: Dialect) -> str:
    return f"""SELECT m.*, CASE WHEN u<60 THEN 'train' WHEN u<70 THEN 'val' WHEN u<75 THEN 'val_unseen_material' WHEN u<80 THEN 'test_seen'
 WHEN u<85 THEN 'test_factory' WHEN u<88 THEN 'test_factory_scratch' WHEN u<92 THEN 'test_unseen_material' WHEN u<97 THEN 'test_negatives'
 WHEN u<99 THEN 'wood_bg' ELSE 'holdout_x' END AS split FROM (SELECT *, {d.h32('name')}%100 AS u FROM manifest) m"""


def _named(d: Dialect) -> str:
    i = "CAST(doc_id AS STRING)"
    k = "CAST(doc_id%50 AS STRING)"
    return f"""SELECT doc_id, lang AS material, n_chars, CASE doc_id%13 WHEN 9 THEN 'sdx' WHEN 10 THEN 'wood' WHEN 11 THEN 'kolektor1' WHEN 12 THEN 'mvtec' ELSE source END AS source,
 concat(CASE doc_id%13 WHEN 9 THEN 'sdx' WHEN 10 THEN 'wood' WHEN 11 THEN 'kolektor1' WHEN 12 THEN 'mvtec' ELSE source END,'__',
 CASE doc_id%13 WHEN 0 THEN concat('noncrack_',{i}) WHEN 1 THEN concat('CRACK500_2016_',{k},'_1_',{i}) WHEN 2 THEN concat('Rissbilder_for_Florian_9S6A',{k},'_',{i})
 WHEN 3 THEN concat('Volker_',{i}) WHEN 4 THEN concat('a_',{k},'_',{i}) WHEN 5 THEN concat('scratch_',{i}) WHEN 6 THEN concat('photo',{k},'_crop',{i})
 WHEN 7 THEN concat('DeepCrack_',{i}) WHEN 8 THEN concat('GAPS_',{i}) WHEN 9 THEN concat('steel_',{i}) WHEN 10 THEN concat('1',lpad({i},8,'0'))
 WHEN 11 THEN concat('kos',{k},'_Part',CAST(doc_id%8 AS STRING)) ELSE concat('capsule_',{i}) END) AS name FROM documents"""


def _raw_item(d: Dialect) -> str:
    return """SELECT doc_id, source AS folder, n_chars, lang,
 CASE doc_id%15 WHEN 0 THEN 'crackseg9k' WHEN 1 THEN 'magnetic_tile' WHEN 2 THEN 'neu_det' WHEN 3 THEN 'dtd' WHEN 4 THEN 'kolektor' WHEN 5 THEN 'gc10'
 WHEN 6 THEN 'sdnet' WHEN 7 THEN 'severstal' WHEN 8 THEN 'wood' WHEN 9 THEN 'kolektor1' WHEN 10 THEN 'mvtec' WHEN 11 THEN 'sdx' WHEN 12 THEN 'casting' WHEN 13 THEN 'ozgenel' ELSE 'wood_shards' END AS adapter,
 CASE doc_id%15 WHEN 0 THEN CASE (doc_id/15)%5 WHEN 0 THEN 'noncrack' WHEN 1 THEN 'CRACK500' WHEN 2 THEN 'Volker' WHEN 3 THEN 'Ceramic' ELSE 'a_' END
 WHEN 1 THEN CASE (doc_id/15)%3 WHEN 0 THEN 'MT_Crack' WHEN 1 THEN 'MT_Free' ELSE 'MT_Fray' END WHEN 2 THEN CASE (doc_id/15)%2 WHEN 0 THEN 'crazing' ELSE 'inclusion' END
 WHEN 3 THEN CASE (doc_id/15)%3 WHEN 0 THEN 'cracked' ELSE 'woven' END WHEN 6 THEN CASE (doc_id/15)%2 WHEN 0 THEN 'cracked' ELSE 'non-cracked' END
 WHEN 10 THEN CASE (doc_id/15)%2 WHEN 0 THEN 'scratch' ELSE 'crack' END WHEN 11 THEN CASE (doc_id/15)%3 WHEN 0 THEN 'scratch' WHEN 1 THEN 'crack' ELSE 'pits' END
 WHEN 12 THEN CASE (doc_id/15)%2 WHEN 0 THEN 'ok_front' ELSE 'def_front' END WHEN 13 THEN CASE (doc_id/15)%2 WHEN 0 THEN 'positive' ELSE 'negative' END ELSE '' END AS label,
 CASE doc_id%4 WHEN 0 THEN 'plastic' WHEN 1 THEN 'metal' WHEN 2 THEN 'wood' END AS record_material,
 CASE WHEN n_chars%3=0 THEN 0 ELSE n_chars END AS crack_px, CASE WHEN n_chars%4=0 THEN 0 ELSE n_chars END AS knot_px, n_chars%5 AS other_px, n_chars%7<>0 AS has_mask
 FROM documents""".replace("(doc_id/15)", d.pick("(doc_id div 15)", "(doc_id//15)"))


def _pixel(d: Dialect) -> str:
    explode = d.pick("posexplode(embedding) AS (pos,v)", "unnest(range(64)) AS pos, unnest(embedding) AS v")
    return f"""SELECT vec_id AS item_id, label%2+1 AS class_id, CAST(floor(pos/8) AS INT) AS y, CAST(pos%8 AS INT) AS x, CASE WHEN v>0.25 THEN 1 ELSE 0 END AS gt, CASE WHEN v>0.28 OR prev>0.3 OR (v>0.20 AND v<0.215) THEN 1 ELSE 0 END AS pred,
 CASE WHEN v>0.25 AND coalesce(prev,0)<=0.25 THEN 1 ELSE 0 END AS skel_gt, CASE WHEN v>0.28 THEN 1 ELSE 0 END AS skel_pred, 1+10*abs(CAST(v AS DOUBLE)) AS half_width, CAST(v AS DOUBLE) AS v
 FROM (SELECT vec_id, label, pos, v, lag(v) OVER (PARTITION BY vec_id ORDER BY pos) AS prev FROM (SELECT vec_id, label, {explode} FROM embeddings) u) t"""


def _score(d: Dialect) -> str:
    scores = d.pick("transform(embedding, v -> CAST(v AS DOUBLE))", "CAST(embedding AS DOUBLE[])")
    return f"SELECT vec_id AS item_id, label AS gt_class, {scores} AS scores FROM embeddings"


def _run_metric(d: Dialect) -> str:
    return """SELECT concat('R', CAST(user_id%5 AS STRING)) AS tag, user_id AS seed, event_type AS split, day(ts) AS epoch, avg(value) AS metric, min(value) AS low, max(value) AS high
 FROM events GROUP BY user_id, event_type, day(ts)"""


def _run_card(d: Dialect) -> str:
    # One model run per part brand and type: scores, cost and stride family.
    return """SELECT concat(p_brand,'/',p_type) AS model, CASE WHEN min(p_partkey)%11=0 THEN NULL WHEN min(p_partkey)%11=1 THEN CAST('NaN' AS DOUBLE) ELSE avg(p_size)/100 END AS val_score, CASE WHEN min(p_partkey)%7=0 THEN NULL WHEN min(p_partkey)%7=1 THEN CAST('NaN' AS DOUBLE) ELSE avg(p_retailprice)/10000 END AS unseen_score,
 max(p_size)/CAST(6 AS DOUBLE) AS params_m, CASE WHEN min(p_partkey)%5=0 THEN NULL ELSE max(p_retailprice)/4 END AS cpu_ms, CASE WHEN p_type IN ('ECONOMY','STANDARD') THEN '1' ELSE '8' END AS stride
 FROM part GROUP BY p_brand, p_type"""


def _licence(d: Dialect) -> str:
    return """SELECT source, CASE WHEN length(source)=5 THEN 'CC-BY-4.0' ELSE 'CC-BY-NC-SA-4.0' END AS licence, length(source)=5 AS redistribute FROM documents WHERE source <> 'src3' GROUP BY source"""


def _file_list(d: Dialect) -> str:
    return f"""SELECT concat(source,'/',CAST(doc_id AS STRING),CASE WHEN doc_id%7=0 THEN '.txt' WHEN doc_id%7=1 THEN '.JPG' ELSE '.png' END) AS path, source AS folder, n_chars AS bytes, {d.sha256('text')} AS sha256,
 n_chars+CASE WHEN doc_id%11=0 THEN 9000 ELSE 0 END AS expected_bytes, CASE WHEN doc_id%13=0 THEN 'x' ELSE {d.sha256('text')} END AS expected_sha256, doc_id, lang FROM documents"""


def _provenance(d: Dialect) -> str:
    return """SELECT concat(CASE WHEN p_size%3=0 THEN 'negative' ELSE 'crack' END,'_',CAST(p_partkey AS STRING)) AS patch_id, CASE WHEN p_size%3=0 THEN 'negative' ELSE 'crack' END AS kind, p_type AS material, p_brand AS brand,
 concat(coalesce(d.source,'plain'),'__',CAST(p_partkey AS STRING),CASE WHEN p_size%2=0 THEN concat('_crop',CAST(p_size AS STRING)) ELSE '' END) AS bg_id, p_size/CAST(10000.0 AS DOUBLE) AS crack_px_frac
 FROM part LEFT JOIN documents d ON d.doc_id=p_partkey"""


def _annotation(d: Dialect) -> str:
    return """SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS annotation_id,
 CASE WHEN l_returnflag='R' THEN 'Scratches' WHEN l_linestatus='O' THEN 'PVC pipe crack' WHEN l_tax>0.06 THEN 'objects' ELSE 'Paper crack' END AS category, l_quantity AS area, l_quantity/200 AS fg_frac, l_quantity*2/(1+l_linenumber) AS mean_width, concat('rf',CAST(l_suppkey%4 AS STRING)) AS dataset FROM lineitem"""


VIEWS = {
    "defect_region": _defect_region,
    "inspection": _inspection,
    "batch_run": _batch_run,
    "profile": _profile,
    "material": _material,
    "station": _station,
    "model_version": _model_version,
    "manifest": _manifest,
    "manifest_split": _manifest_split,
    "named": _named,
    "raw_item": _raw_item,
    "pixel": _pixel,
    "score": _score,
    "run_metric": _run_metric,
    "run_card": _run_card,
    "licence": _licence,
    "file_list": _file_list,
    "provenance": _provenance,
    "annotation": _annotation,
}
_NAMES = "|".join(list(VIEWS) + list(TABLES))
_USE = re.compile(rf"\b(FROM|JOIN)\s+({_NAMES})\b", re.IGNORECASE)


def _uses(sql: str) -> list[str]:
    return [m.group(2) for m in _USE.finditer(sql)]


class Views:
    """Lazy access to tables and views: ``v["inspection"]`` or ``v.inspection``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name](SPARK)
                inputs = {n: self[n] for n in set(_uses(text))}
                self._made[name] = self.spark.sql(_USE.sub(r"\1 {\2}", text), **inputs)
        return self._made[name]

    def found(self, names: list[str]) -> list[str]:
        """Those of ``names`` that can be laid over the tables which the folder holds."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        listed = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        there = {x.getPath().getName().removesuffix(".parquet") for x in listed}
        ready = lambda n: n in there if n in TABLES else n in VIEWS and all(map(ready, set(_uses(VIEWS[n](SPARK)))))
        return [n for n in names if ready(n)]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name in VIEWS:
            return self[name]
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """Put the views that a DuckDB statement uses in front of it."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in _uses(text):
            if name in VIEWS and name not in wanted:
                wanted.add(name)
                visit(VIEWS[name](DUCK))

    visit(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n](DUCK)})" for n in VIEWS if n in wanted)
    body = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if not head:
        return f"WITH {ctes} {body}" if ctes else body
    rest = body[head.end():]
    recursive = "RECURSIVE " if head.group(1) else ""
    return f"WITH {recursive}{ctes}, {rest}" if ctes else body
