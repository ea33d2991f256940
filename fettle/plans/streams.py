"""Streaming queries over the event table; their SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fettle.plans.catalog import query
from fettle.schemas import EVENT
from fettle.streaming import streams


def events(v):
    return streams.event_stream(v.spark, v.sf_dir, EVENT, "events.parquet")


@query("stream_record_log", "SELECT event_id, user_id, event_type, value FROM events")
def _(v):
    return streams.append_log(events(v)).select("event_id", "user_id", "event_type", "value")


@query("stream_latest", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1")
def _(v):
    live = streams.latest_per_station(events(v), "user_id", F.col("event_id"), ["event_id", "event_type", "value"])
    return streams.keyed_state(live, ["user_id"], "latest")


@query("stream_progress", "WITH s AS (SELECT user_id, count(*) AS processed, count(*) FILTER (WHERE event_type='error') AS failures, epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM events GROUP BY 1) SELECT user_id, processed, failures, round((t1-t0)/1e6::DOUBLE/processed*greatest(user_id+60-processed,0),1) AS eta_seconds FROM s")
def _(v):
    expected = v.events.select("user_id").distinct().withColumn("expected", F.col("user_id") + 60)
    state = streams.run_progress(events(v), "user_id", F.col("event_type") == "error", expected)
    return streams.keyed_state(state, ["user_id"], "progress")


@query("stream_status_window", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1,2) SELECT strftime(s,'%Y-%m-%dT%H:%M:%S') AS window_start, strftime(s+INTERVAL 1 HOUR,'%Y-%m-%dT%H:%M:%S') AS window_end, event_type, n FROM w")
def _(v):
    counts = streams.status_windows(events(v), "event_type", "1 hour", "10 minutes")
    windows = streams.keyed_state(counts, ["window_start", "window_end", "event_type"], "windows")
    return windows.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in ("window_start", "window_end")], "event_type", "n")


@query("stream_dedupe_sha", "SELECT DISTINCT sha256(user_id||'/'||event_type||'/'||CAST(floor(value) AS BIGINT)) AS digest FROM events")
def _(v):
    digest = F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.floor("value").cast("string")), 256)
    return streams.first_submissions(events(v), digest)
