"""Session analytics over batch runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle.functions.columns import percent, ratio, wall_micros
from fettle.operators.batches import run_totals, totals_for_runs
from fettle.operators.history import region_totals, status_totals
from fettle.operators.ranking import percentiles, row_number_by_value

MIN_RATE_SECONDS = 3


def _latency_basics() -> dict[str, Column]:
    return {"latency_avg": F.round(F.avg("latency_ms"), 1), "latency_max": F.round(F.max("latency_ms"), 1),
            "latency_count": F.count("latency_ms")}


def _latency_tails(inspections: DataFrame) -> DataFrame:
    rows = inspections.where(F.col("batch_run_id").isNotNull() & F.col("latency_ms").isNotNull())
    tails = percentiles(rows, ["batch_run_id"], "latency_ms", {"latency_median": 0.5, "latency_p95": 0.95})
    return tails.select("batch_run_id", *[F.round(c, 1).alias(c) for c in ("latency_median", "latency_p95")])


def latency_stats(inspections: DataFrame) -> DataFrame:
    """Average, median, p95, maximum and count of the known latencies per run."""
    rows = inspections.where(F.col("batch_run_id").isNotNull() & F.col("latency_ms").isNotNull())
    basic = rows.groupBy("batch_run_id").agg(*[c.alias(k) for k, c in _latency_basics().items()])
    return basic.join(_latency_tails(inspections), "batch_run_id").select(
        "batch_run_id", "latency_avg", "latency_median", "latency_p95", "latency_max", "latency_count")


def session_durations(runs: DataFrame) -> DataFrame:
    """Seconds and minutes of a run; null unless it ended at or after its start."""
    span = wall_micros("finished_at") - wall_micros("started_at")
    seconds = F.when(span >= 0, span / 1e6)
    return runs.select(
        "batch_run_id", seconds.alias("seconds"),
        F.round(seconds / 60, 1).alias("duration_min"), F.round(seconds, 1).alias("duration_seconds"),
    )


def _rate() -> Column:
    """Items per minute, only where the run lasted long enough to measure a rate."""
    fit = (F.col("seconds") >= MIN_RATE_SECONDS) & (F.col("processed") > 0)
    return F.when(fit, F.round(ratio("processed", F.col("seconds") / 60), 1))


def throughput(durations: DataFrame, totals: DataFrame) -> DataFrame:
    joined = durations.join(totals.select("batch_run_id", "processed"), "batch_run_id", "left")
    return joined.select("batch_run_id", _rate().alias("throughput"))


def session_dashboard(inspections: DataFrame, regions: DataFrame, runs: DataFrame) -> DataFrame:
    """Totals, duration, rate and latency of every run in one row, zeros for a run without inspections."""
    totals = totals_for_runs(runs, run_totals(inspections, regions, extra=_latency_basics()))
    timed = totals.join(session_durations(runs), "batch_run_id", "left").withColumn("throughput", _rate()).drop("seconds")
    return timed.join(_latency_tails(inspections), "batch_run_id", "left")


def overview_totals(inspections: DataFrame) -> DataFrame:
    t = status_totals(inspections.where(F.col("batch_run_id").isNotNull()))
    return t.withColumn("clean_pct", percent("clean", "processed")).withColumn(
        "regions_pct", percent("regions_found", "processed")
    )


def overview_regions(inspections: DataFrame, regions: DataFrame) -> DataFrame:
    batch_items = inspections.where(F.col("batch_run_id").isNotNull()).select("inspection_id")
    return region_totals(regions.join(batch_items, "inspection_id"))


def clean_pct_trend(totals: DataFrame) -> DataFrame:
    return totals.select("batch_run_id", F.concat(F.lit("Run "), F.col("batch_run_id").cast("string")).alias("label"), "clean_pct").orderBy("batch_run_id")


def defect_mix(totals: DataFrame, n: int) -> DataFrame:
    """Crack and scratch counts of the most recent runs, oldest first."""
    top = totals.orderBy(F.col("batch_run_id").desc()).limit(n)
    return top.select("batch_run_id", "crack_regions", "scratch_regions").orderBy("batch_run_id")


def run_timeline(inspections: DataFrame, runs: DataFrame) -> DataFrame:
    """Cumulative processed count against elapsed minutes of each run, never negative.

    Where a time is missing the point falls back to its position.
    """
    rows = inspections.where(F.col("batch_run_id").isNotNull()).select("batch_run_id", "inspection_id", "processed_at")
    lead = wall_micros("processed_at")
    order = [F.col("processed_at").asc(), F.col("inspection_id").asc()]
    numbered = row_number_by_value(rows, ["batch_run_id"], order, lead, "processed", tie="inspection_id")
    joined = numbered.join(runs.select("batch_run_id", "started_at"), "batch_run_id", "left")
    gap = wall_micros("processed_at") - wall_micros("started_at")
    minutes = F.coalesce(F.greatest(F.lit(0.0), gap / 6e7), (F.col("processed") - 1).cast("double"))
    elapsed = F.when(gap.isNull(), (F.col("processed") - 1).cast("double")).otherwise(minutes)
    return joined.select("batch_run_id", "inspection_id", "processed", F.round(elapsed, 4).alias("elapsed_min"))
