"""Queries over draw plans, text formats and the record log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.functions import text
from fettle.functions.columns import iso
from fettle.operators import corpus, exports, sampling
from fettle.plans.catalog import query
from fettle.schemas import RECORD
from fettle.session import work_path


def u(part: str, seed: int = 7, slot: str = "slot") -> str:
    return f"(('0x'||substr(md5('{seed}{part}:'||{slot}),1,8))::BIGINT/4294967296.0::DOUBLE)"


def idx(pool: str, key: str, table: str, seed: int = 7) -> str:
    return f"(SELECT {pool}, {key}, row_number() OVER (PARTITION BY {pool} ORDER BY md5('{seed}:'||{key}), {key})-1 AS idx, count(*) OVER (PARTITION BY {pool}) AS n FROM {table})"


POOLS = "(SELECT name, CASE WHEN role='positive' AND crack_px>0 THEN 'crack' WHEN role='scratch' AND crack_px>0 THEN 'scratch' ELSE 'negative' END AS pool FROM manifest WHERE role NOT IN ('positive','scratch') OR crack_px>0)"


def slots(v):
    return v.documents.select(F.col("doc_id").alias("slot"))


@query("quota_sampler", f"WITH s AS (SELECT doc_id AS slot FROM documents), p AS (SELECT slot, CASE WHEN {u('pos')}<0.5 THEN CASE WHEN {u('cls')}<0.3 THEN 'scratch' ELSE 'crack' END ELSE 'negative' END AS pool FROM s), i AS {idx('pool', 'name', POOLS)} SELECT slot, p.pool, name FROM p JOIN i ON i.pool=p.pool AND i.idx=floor({u('row')}*i.n)")
def _(v):
    kind = F.expr("CASE WHEN role='positive' AND crack_px>0 THEN 'crack' WHEN role='scratch' AND crack_px>0 THEN 'scratch' ELSE 'negative' END")
    rows = v.manifest.where("role NOT IN ('positive','scratch') OR crack_px>0").select("name", kind.alias("pool"))
    return sampling.quota_sampler(slots(v), rows, "name", 0.5, 0.3, 7)


@query("mix_synth", f"SELECT slot, {u('syn')}<0.25 AS synthetic FROM (SELECT doc_id AS slot FROM documents)")
def _(v):
    return sampling.mix_synth(slots(v), 0.25, 7)


BAL = f"WITH s AS (SELECT doc_id AS slot FROM documents), g AS (SELECT list(m ORDER BY m) AS ms FROM (SELECT DISTINCT material AS m FROM manifest WHERE material IS NOT NULL)), p AS (SELECT slot, ms[CAST(floor({u('grp')}*len(ms)) AS INT)+1] AS material FROM s, g), i AS {idx('material', 'name', 'manifest')}, d AS (SELECT slot, p.material, name FROM p JOIN i ON i.material=p.material AND i.idx=floor({u('row')}*i.n))"


@query("share_in_group", f"{BAL} SELECT slot, material, name FROM d")
def _(v):
    return sampling.group_balanced(slots(v), v.manifest.select("material", "name"), "material", "name", 7)


@query("sample_plan_provenance", f"{BAL} SELECT kind||'_'||lpad(CAST(slot AS VARCHAR),7,'0') AS patch_id, kind, material, name AS bg_id, 7 AS rng_seed, slot AS sample_index FROM (SELECT *, CASE WHEN slot<600 THEN 'crack' ELSE 'negative' END AS kind FROM d)")
def _(v):
    return sampling.sample_plan(slots(v), v.manifest.select("material", "name"), "material", "name", 600, 7)


@query("eval_interleave", f"""WITH r AS (SELECT name, CASE WHEN role IN ('positive','scratch') THEN 'positive' ELSE 'negative' END AS pool FROM manifest_split WHERE (role IN ('positive','scratch') AND crack_px>0) OR role NOT IN ('positive','scratch')),
 i AS {idx('pool', 'name', 'r')}, c AS (SELECT count(*) FILTER (WHERE pool='positive') AS p, count(*) FILTER (WHERE pool='negative') AS n FROM r), k AS (SELECT unnest(range(p+least(p,n))) AS place, p, n FROM c)
 SELECT name, i.pool, place FROM k JOIN i ON (place%2=0 AND i.pool='positive' AND i.idx=(place//2)%p) OR (place%2=1 AND i.pool='negative' AND i.idx=(place//2)%k.n)""")
def _(v):
    rows = corpus.role_pools(v.manifest_split.select("name", "role", "crack_px"), 3).select("name", "pool")
    return sampling.eval_interleave(rows, "name", 7)


@query("text_formats", """SELECT doc_id, CASE WHEN n_chars=0 THEN '?' WHEN n_chars*1000<1024 THEN format('{:.1f}B', n_chars*1000::DOUBLE) WHEN n_chars*1000<1048576 THEN format('{:.1f}KB', n_chars*1000/1024::DOUBLE) ELSE format('{:.1f}MB', n_chars*1000/1048576::DOUBLE) END AS size,
 format('{:,}', n_chars)||' px' AS px, source||'-'||doc_id||'.png' AS file, substr(md5(text),1,4)||'…'||right(md5(text),3) AS digest, 'source='||source||'&lang='||lang AS query FROM documents""")
def _(v):
    n = F.col("n_chars") * 1000
    path = F.concat(F.lit("a/b\\c/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".png"))
    return v.documents.select(
        "doc_id", text.human_size(n).alias("size"), text.pixels(F.col("n_chars")).alias("px"), text.last_segment(path).alias("file"),
        text.short_digest(F.md5("text")).alias("digest"), text.query_string([("source", F.col("source")), ("page", F.lit("")), ("lang", F.col("lang"))]).alias("query"))


@query("time_formats", "SELECT inspection_id, strftime(processed_at, '%d %b %H:%M:%S') AS shown, strftime(captured_at, '%Y-%m-%d') AS day, CASE WHEN inspection_id%3<>0 THEN strftime(processed_at, '%Y-%m-%dT%H:%M:%S') END AS parsed FROM inspection")
def _(v):
    raw = F.when(F.expr("inspection_id%3=0"), F.lit("not a time")).otherwise(iso("processed_at"))
    parsed = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return v.inspection.select("inspection_id", text.short_time(F.col("processed_at")).alias("shown"),
        F.date_format(F.to_date("captured_at"), "yyyy-MM-dd").alias("day"), iso(parsed).alias("parsed"))


@query("record_log_append", "SELECT product_id, CAST(count(region_index) AS BIGINT) AS regions, count(region_index)=0 AS empty FROM inspection i LEFT JOIN defect_region r ON r.inspection_id=i.inspection_id GROUP BY product_id, i.inspection_id")
def _(v):
    path = work_path(v.spark, "records")
    for batch, status in (("found", "status = 'regions_found'"), ("other", "status <> 'regions_found'"), ("found", "true")):
        exports.append_once({"log": exports.records_of(v.inspection.where(status), v.defect_region)}, path, batch, "json")
    log = exports.committed(v.spark, path, "log", RECORD, "json")
    return log.select("product_id", F.coalesce(F.size("regions"), F.lit(0)).cast("bigint").alias("regions"), "empty").withColumn(
        "regions", F.greatest("regions", F.lit(0)))
