"""Tables of the store written once by key, so that later joins and groupings on the key move no rows.

The catalog knows how a table is bucketed; a table of the same number of buckets on the same key is joined bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fettle.session import work_path

BUCKETS = 64


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """``rows`` as the catalog table ``table``, one sorted file for each bucket of ``key``; returns the table.

    The files are in ``path`` or in a fresh place of the shared folder. One shuffle now, none in queries on the key. As
    many buckets as keep one at some hundred MB; a hot key fills its own bucket, as it would fill a task.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path or work_path(spark, table)).saveAsTable(table)
    return spark.table(table)


def write_store(inspections: DataFrame, regions: DataFrame, prefix: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Inspections and their regions bucketed alike by ``inspection_id``."""
    return (write_bucketed(inspections, f"{prefix}_inspection", "inspection_id", buckets), write_bucketed(regions, f"{prefix}_defect_region", "inspection_id", buckets))


def drop_store(spark: SparkSession, prefix: str) -> None:
    for name in ("inspection", "defect_region"):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")
