"""Streams end with the totals of their batch twins, also over several batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fettle.schemas import EVENT
from fettle.streaming import streams

START = dt.datetime(2026, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(i, START + dt.timedelta(minutes=i), i % 3, "error" if i % 5 == 0 else "view", float(i % 7), "") for i in range(120)]
    df = spark.createDataFrame(rows, EVENT)
    for part in range(3):
        df.where(F.floor(F.col("event_id") / 40) == part).coalesce(1).write.parquet(str(tmp_path / f"part{part}"))
    flat = tmp_path / "events"
    flat.mkdir()
    for part in range(3):
        source = next((tmp_path / f"part{part}").glob("*.parquet"))
        source.rename(flat / f"events-{part}.parquet")
    return str(flat)


def stream(spark, folder):
    raw = spark.readStream.schema(EVENT).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def test_log_is_complete(spark, folder):
    log = streams.append_log(stream(spark, folder))
    assert sorted(r["event_id"] for r in log.collect()) == list(range(120))


def test_latest_and_progress_match_batch(spark, folder):
    live = streams.latest_per_station(stream(spark, folder), "user_id", F.col("event_id"), ["event_id"])
    assert {r["user_id"]: r["event_id"] for r in streams.keyed_state(live, ["user_id"], "latest").collect()} == {0: 117, 1: 118, 2: 119}
    expected = spark.createDataFrame([(0, 50), (1, 40), (2, 30)], "user_id BIGINT, expected BIGINT")
    state = streams.run_progress(stream(spark, folder), "user_id", F.col("event_type") == "error", expected)
    out = {r["user_id"]: r for r in streams.keyed_state(state, ["user_id"], "progress").collect()}
    assert all(r["processed"] == 40 and r["failures"] == 8 for r in out.values())
    assert out[1]["eta_seconds"] == 0.0 and out[0]["eta_seconds"] == round(117 * 60 / 40 * 10, 1)


def windows(spark, folder, home=None):
    counts = streams.status_windows(stream(spark, folder), "event_type", "30 minutes", "10 minutes")
    totals = {}
    for r in streams.keyed_state(counts, ["window_start", "window_end", "event_type"], "windows", home).collect():
        totals[r["window_start"]] = totals.get(r["window_start"], 0) + r["n"]
    return sorted(totals.values())


def test_windows_hold_open_ones(spark, folder):
    assert windows(spark, folder) == [30, 30, 30, 30]


def digest():
    return F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), F.col("value").cast("string")), 256)


def test_resubmitted_payloads_are_dropped_in_any_batches(spark, folder):
    raw = spark.readStream.schema(EVENT).option("pathGlobFilter", "events*.parquet").parquet(folder)
    for events in (stream(spark, folder), raw):
        kept = streams.first_submissions(events, digest())
        assert kept.count() == 21 and kept.select("digest").distinct().count() == 21


def test_streams_resume_in_their_own_folder(spark, folder, tmp_path):
    grow = tmp_path / "grow"
    grow.mkdir()
    home = str(tmp_path / "home")
    live = lambda: streams.latest_per_station(stream(spark, str(grow)), "user_id", F.col("event_id"), ["event_id"])
    assert streams.keyed_state(live(), ["user_id"], "latest", home).count() == 0  # no input yet
    for part in range(3):
        (tmp_path / "events" / f"events-{part}.parquet").rename(grow / f"events-{part}.parquet")
        assert streams.append_log(stream(spark, str(grow)), f"{home}-log").count() == 40 * (part + 1)
        assert max(r["event_id"] for r in streams.keyed_state(live(), ["user_id"], "latest", home).collect()) == 40 * (part + 1) - 1
        assert streams.first_submissions(stream(spark, str(grow)), digest(), f"{home}-digests").count() == 21
        assert sum(windows(spark, str(grow), f"{home}-windows")) == 40 * (part + 1)


def test_compacted_state_resumes(spark, folder, tmp_path):
    grow, home = tmp_path / "grow", str(tmp_path / "home")
    grow.mkdir()
    held = lambda: sorted(p.name for p in (tmp_path / "home" / "results").glob("batch=*"))
    for part in range(3):
        (tmp_path / "events" / f"events-{part}.parquet").rename(grow / f"events-{part}.parquet")
        live = streams.latest_per_station(stream(spark, str(grow)), "user_id", F.col("event_id"), ["event_id"])
        state = streams.keyed_state(live, ["user_id"], "latest", home, deltas=2)
        assert sorted(r["event_id"] for r in state.collect()) == [40 * (part + 1) - k for k in (3, 2, 1)]
        assert len(held()) == (1 if part in (0, 2) else 0)
    assert [p.name for p in (tmp_path / "home" / "results-base" / "base").glob("batch=*")] == ["batch=1"]


def test_a_killed_compaction_leaves_the_old_state(spark, folder, tmp_path, monkeypatch):
    home = str(tmp_path / "home")
    live = streams.latest_per_station(stream(spark, folder), "user_id", F.col("event_id"), ["event_id"])

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(streams, "discard", dies)
        with pytest.raises(RuntimeError):
            streams.keyed_state(live, ["user_id"], "latest", home, deltas=3)
    assert sorted(r["event_id"] for r in streams.keyed_state(live, ["user_id"], "latest", home, deltas=3).collect()) == [117, 118, 119]


def test_recent_submissions_are_dropped(spark, folder):
    kept = streams.first_submissions_within(stream(spark, folder), digest(), "3 hours")
    assert kept.count() == 21 and kept.distinct().count() == 21
