"""Arrow functions on Spark rows, with this package shipped to the workers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import fettle

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the workers, once an application; Spark's own file server carries them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(fettle.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "fettle_sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def kept_fields(rows: DataFrame, names: list[str]) -> list[T.StructField]:
    """The named columns of ``rows``, in that order, all nullable."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return [T.StructField(n, kinds[n]) for n in names]


def map_arrow(rows: DataFrame, work: Callable, fields: list[T.StructField], **parameters) -> DataFrame:
    """``work(batches, schema=..., **parameters)`` over ``rows``; it yields record batches of ``fields``."""
    ship(rows.sparkSession)
    schema = T.StructType(fields)
    return rows.mapInArrow(partial(work, schema=to_arrow_schema(schema), **parameters), schema)
