"""Readers and writers of manifests, run records, logs and provenance files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").partitionBy("source").parquet(path)


def write_manifest_csv(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str, fmt: str = "csv", split: str | None = None,
                  exclude_materials: tuple[str, ...] = ()) -> DataFrame:
    """Manifest with a declared schema; the filters reach the scan."""
    df = spark.read.schema(schema).format(fmt).option("header", "true").option("escape", '"').load(path)
    if split:
        df = df.where(F.col("split") == split)
    return without_materials(df, exclude_materials) if exclude_materials else df


def without_materials(df: DataFrame, materials: tuple[str, ...]) -> DataFrame:
    return df.where(~F.col("material").isin(*materials))


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run records, one JSON object per file on one line or many; malformed files and other values are skipped."""
    text = spark.read.text(path, wholetext=True).where(F.ltrim(F.col("value"), F.lit(" \t\r\n")).startswith("{"))
    read = F.from_json("value", f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return text.select(read.alias("r")).select("r.*").where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_if_there(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    """A table that may not have been written yet: then it has no rows."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(length, sha256) of one file, read alone; no row where it is not there."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "length BIGINT, sha256 STRING")
    return files.select("length", F.sha2("content", 256).alias("sha256"))


def write_runs(records: DataFrame, payload: str, path: str) -> None:
    """One file for each record, as the training jobs leave them."""
    records.select(payload, F.xxhash64(payload).alias("run_file")).write.partitionBy("run_file").text(path)


def find_run(runs: DataFrame, tag: str) -> DataFrame:
    """The run of a tag: evaluation reports share the tag but carry no arguments."""
    return runs.where((F.col("tag") == tag) & F.col("args").isNotNull())


def rescued_runs(checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """A minimal record for every checkpoint without one; existing records stay untouched."""
    return checkpoints.join(runs.select("run"), "run", "left_anti").withColumn("rescued", F.lit(True))
