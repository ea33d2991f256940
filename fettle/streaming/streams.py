"""Structured Streaming forms of the live view, run progress and the record log.

Each has a batch twin with the same result once all input has arrived. Results and progress live in a folder of the
caller, and a run with the same folder resumes; without one they live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fettle.functions.columns import n_where
from fettle.operators.exports import ATTEMPT, COMMITS, MARK, append_once
from fettle.session import discard, work_path
from fettle.sources.files import read_if_there


def event_stream(spark: SparkSession, folder: str, schema: str, pattern: str) -> DataFrame:
    """Files of a folder as a stream; the event time is cast to a zoned timestamp for watermarks."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append-only file sink, exactly once by its checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


@dataclass(frozen=True)
class Home:
    """Where a stream keeps its results and its progress. A run with the same home resumes where the last one ended."""

    results: str
    progress: str

    @staticmethod
    def of(spark: SparkSession, label: str, folder: str | None = None) -> Home:
        """``folder`` is the caller's own; without one a fresh place in the shared folder is taken."""
        folder = folder or work_path(spark, label)
        return Home(f"{folder}/results", f"{folder}/progress")


def append_log(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Tail a stream into an append-only table and return that table."""
    home = Home.of(stream.sparkSession, "log", folder)
    run_to_files(stream, home.results, home.progress)
    return read_if_there(stream.sparkSession, home.results, stream.schema)


BATCH, UPTO = "batch", "upto"
#: Deltas from which on a keyed state is compacted.
DELTAS = 16


def keyed_state(stream: DataFrame, keys: list[str], label: str, folder: str | None = None, deltas: int = DELTAS) -> DataFrame:
    """Run an aggregation in update mode and return the last row of every key.

    A batch writes only the keys that it changed, in its own folder, so a repeated batch overwrites itself; the merge by
    key happens where the table is read. Once ``deltas`` batches have gathered they are merged into a base, which is committed before the deltas
    that it holds are removed: a reader sees one base and the batches after it, and a killed compaction leaves the old ones.
    """
    spark = stream.sparkSession
    home = Home.of(spark, label, folder)

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{home.results}/{BATCH}={batch}")

    run_batches(stream, "update", home.progress, sink)
    state, upto, later = _merged(spark, home, stream.schema, keys)
    if len(later) >= deltas:
        append_once({"base": state}, f"{home.results}-base", str(max(later)))
        for batch in later:
            discard(spark, f"{home.results}/{BATCH}={batch}")
        for old in upto:
            discard(spark, f"{home.results}-base/base/{BATCH}={old}")
        state, _, _ = _merged(spark, home, stream.schema, keys)
    return state


def _merged(spark: SparkSession, home: Home, schema: StructType, keys: list[str]) -> tuple[DataFrame, list[int], list[int]]:
    """The last row of every key, the bases that are committed and the batches after the newest of them."""
    marks = read_if_there(spark, f"{home.results}-base/{COMMITS}", MARK).select(F.col(BATCH).cast("long").alias(UPTO)).collect()
    bases = sorted(r[UPTO] for r in marks)
    newest = bases[-1] if bases else -1
    rest = [c for c in schema.names if c not in keys]
    deltas = read_if_there(spark, home.results, StructType([*schema.fields]).add(BATCH, "long")).where(F.col(BATCH) > newest)
    later = sorted(r[BATCH] for r in deltas.select(BATCH).distinct().collect())
    rows = deltas
    if bases:
        base = read_if_there(spark, f"{home.results}-base/base", StructType([*schema.fields]).add(BATCH, "long").add(ATTEMPT, "string"))
        good = read_if_there(spark, f"{home.results}-base/{COMMITS}", f"{ATTEMPT} STRING, {BATCH} LONG").where(F.col(BATCH) == newest)
        rows = base.join(good, [BATCH, ATTEMPT], "left_semi").select(*deltas.columns).unionByName(deltas)
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("r")).select(*keys, "r.*").select(*schema.names)
    return merged, bases, later


def latest_per_station(events: DataFrame, station: str, order: Column, fields: list[str]) -> DataFrame:
    return events.groupBy(station).agg(F.max_by(F.struct(*fields), order).alias("r")).select(station, "r.*")


def run_progress(events: DataFrame, run: str, failed: Column, expected: DataFrame) -> DataFrame:
    """Processed items and failures per run, with the time left at the mean pace so far."""
    state = events.groupBy(run).agg(
        F.count("*").alias("processed"), n_where(failed).alias("failures"),
        F.min(F.unix_micros("ts")).alias("t0"), F.max(F.unix_micros("ts")).alias("t1"))
    pace = (F.col("t1") - F.col("t0")) / 1e6 / F.col("processed")
    left = F.greatest(F.col("expected") - F.col("processed"), F.lit(0))
    return state.join(expected, run).select(run, "processed", "failures", F.round(pace * left, 1).alias("eta_seconds"))


def status_windows(events: DataFrame, status: str, width: str, late: str) -> DataFrame:
    """Counts per status and tumbling event-time window, open ones too.

    The watermark bounds the state: events later than ``late`` against the newest one of earlier batches are dropped.
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), status).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), status, "n")


def first_submissions(events: DataFrame, digest: Column, folder: str | None = None) -> DataFrame:
    """The digests of all payloads, each once, however the input was cut into batches.

    Known digests are a table, not state: each batch appends those that the table lacks. A repeated batch looks at earlier batches only.
    """
    spark = events.sparkSession
    home = Home.of(spark, "digests", folder)
    kind = StructType().add("digest", "string").add(BATCH, "long")

    def sink(df: DataFrame, batch: int) -> None:
        known = read_if_there(spark, home.results, kind).where(F.col(BATCH) < batch).select("digest")
        df.distinct().join(known, "digest", "left_anti").write.mode("overwrite").parquet(f"{home.results}/{BATCH}={batch}")

    run_batches(events.select(digest.alias("digest")), "append", home.progress, sink)
    return read_if_there(spark, home.results, kind).select("digest")


def first_submissions_within(events: DataFrame, digest: Column, late: str, folder: str | None = None) -> DataFrame:
    """The digests of payloads, each once within ``late`` of its first event: state that ends, for feeds whose repeats come soon.

    Where repeats may come at any time, use ``first_submissions``.
    """
    spark = events.sparkSession
    home = Home.of(spark, "recent-digests", folder)
    fresh = events.select("ts", digest.alias("digest")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"]).select("digest")
    run_to_files(fresh, home.results, home.progress)
    return read_if_there(spark, home.results, fresh.schema)
