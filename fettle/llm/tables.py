"""Settled tables that do not outlive what is made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fettle.session import discard, settle_at, work_path


class Tables:
    """Tables in the shared folder, each removed once all that reads it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written and read back."""
        path = work_path(self.spark, label)
        out = settle_at(df, path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            discard(self.spark, self.held.pop(id(table))[1])

    def drop_all(self) -> None:
        self.drop(*[table for table, _ in self.held.values()])
