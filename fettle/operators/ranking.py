"""Exact ranks, percentiles and per-group limits that no hot group can overload.

A plain window over a group sorts the whole group in one task. Here a group is cut into
cells by an order-preserving bucket; cells are counted with map-side combining, the few
counts are summed into offsets, and only then rows are numbered inside their cell.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fettle.functions.columns import ColumnLike, col
from fettle.session import settle

GROUP = "__g"
BEYOND = (1 << 31) - 1


def bucket_count(df: DataFrame) -> int:
    """Cells per group follow the cluster: twice its shuffle partitions."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _grouped(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add the group as one column that is never null, so that windows and plain equi-joins share a shuffle."""
    return df.withColumn(GROUP, F.struct(*groups) if groups else F.lit(0))


def _edges(df: DataFrame, *values: Column) -> list[list[float]]:
    """Quantile edges of each value, one fewer than buckets; duplicates mark values that are frequent.

    One pass with mergeable sketches for all values; only lists of fixed length reach the driver. Without a value
    there are no edges.
    """
    n = bucket_count(df)
    names = [f"__x{i}" for i in range(len(values))]
    named = df.select(*[v.cast("double").alias(k) for k, v in zip(names, values)])
    return named.approxQuantile(names, [i / n for i in range(1, n)], 1 / (2 * n))


def with_quantile_bucket(df: DataFrame, value: ColumnLike, out: str = "__b", frequent: str | None = None,
                         edges: list[float] | None = None) -> DataFrame:
    """Add a bucket number that rises with ``value`` and holds about an even share of all rows.

    The edges only steer the balance, never the result. Equal values share a bucket, nulls
    fall below all. ``frequent`` flags rows whose value alone fills a bucket, and nulls; within their
    bucket they come first, since a bucket starts at its edge.
    """
    if edges is None:
        (edges,) = _edges(df, col(value))
    x, steps = col(value).cast("double"), sorted(set(edges))
    number = F.lit(0)
    if steps:
        splits = [float("-inf"), *steps, float("inf")]
        step = Bucketizer(splits=splits, inputCol="__x", outputCol="__y", handleInvalid="keep").transform(df.withColumn("__x", x))
        number = F.col("__y").cast("int")
    else:
        step = df.withColumn("__x", x)
    step = step.withColumn(out, F.when(F.col("__x").isNull(), -1).otherwise(number))
    if frequent:
        heavy = [e for e, n in Counter(edges).items() if n > 1]
        often = F.coalesce(F.col("__x").isin(heavy), F.lit(False)) if heavy else F.lit(False)
        step = step.withColumn(frequent, F.col("__x").isNull() | often)
    return step.drop("__x", "__y")


def _numbered(cells: DataFrame, kept: Sequence[str], buckets: Sequence[str], order: Sequence[Column],
              out: str, total: str | None, descending: bool) -> DataFrame:
    """Number rows inside their cell and add the cell's offset; the join reuses the window's shuffle."""
    keys = [GROUP, *buckets]
    counts = cells.groupBy(*keys).agg(F.count("*").alias("__n"))
    direction = [F.col(b).desc() if descending else F.col(b).asc() for b in buckets]
    before = W.partitionBy(GROUP).orderBy(*direction).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn("__total", F.sum("__n").over(W.partitionBy(GROUP)))
    local = cells.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    joined = local.join(offsets.drop("__n"), keys)
    extra = [F.col("__total").cast("bigint").alias(total)] if total else []
    return joined.select(*kept, (F.col("__off") + F.col("__rn")).cast("bigint").alias(out), *extra)


def row_number_by_value(df: DataFrame, groups: Sequence[str], order: Sequence[Column], lead: ColumnLike,
                        out: str = "rn", total: str | None = None, descending: bool = False,
                        tie: ColumnLike | None = None, tie_digest: str | None = None, tie_text: str | None = None) -> DataFrame:
    """``row_number()`` over ``groups`` in ``order``, whose first column follows ``lead``.

    Where many rows may share one lead value, give the second order column too: as a number
    (``tie``), as a hex digest (``tie_digest``) or as an ascending text (``tie_text``, for which the rows are dealt out
    by range once more); it cuts the cells of frequent values further.
    """
    if tie_text:
        dealt = df.repartitionByRange(bucket_count(df), F.col(tie_text)).withColumn("__t", F.spark_partition_id())
        cells = with_quantile_bucket(_grouped(settle(dealt, "ranking"), groups), lead, frequent="__e")
        # cells of a descending lead are taken from the last to the first, the text runs upwards all the same
        cells = cells.withColumn("__b2", F.when(F.col("__e"), -F.col("__t") if descending else F.col("__t")).otherwise(BEYOND)).drop("__e", "__t")
        return _numbered(cells, df.columns, ["__b", "__b2"], order, out, total, descending)
    settled = settle(df, "ranking")
    rows = _grouped(settled, groups)
    if tie is None and tie_digest is None:
        return _numbered(with_quantile_bucket(rows, lead), df.columns, ["__b"], order, out, total, descending)
    if tie_digest:
        cells = with_quantile_bucket(rows, lead, frequent="__e")
        cells = cells.withColumn("__t", F.conv(F.substring(tie_digest, 1, 2), 16, 10).cast("int"))
    else:
        lead_edges, tie_edges = _edges(rows, col(lead), col(tie))
        cells = with_quantile_bucket(rows, lead, frequent="__e", edges=lead_edges)
        cells = with_quantile_bucket(cells, tie, "__t", edges=tie_edges)
    cells = cells.withColumn("__b2", F.when(F.col("__e"), F.col("__t")).otherwise(BEYOND)).drop("__e", "__t")
    return _numbered(cells, df.columns, ["__b", "__b2"], order, out, total, descending)


def row_number_by_hash(df: DataFrame, groups: Sequence[str], digest: str, tie: str,
                       out: str = "rn", total: str | None = None) -> DataFrame:
    """``row_number()`` over ``groups`` in digest order; even cells by leading digits, no extra pass.

    The digits follow the shuffle partitions: at least two cells for each.
    """
    digits = max(1, math.ceil(math.log(bucket_count(df), 16)))
    cells = _grouped(settle(df, "ranking"), groups).withColumn("__b", F.substring(digest, 1, digits))
    return _numbered(cells, df.columns, ["__b"], [F.col(digest), F.col(tie)], out, total, False)


def first_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, spread: str,
            out: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group. Salted cells are cut to ``n`` before groups meet."""
    salted = df.withColumn("__s", F.pmod(F.xxhash64(spread), F.lit(bucket_count(df))))
    inner = W.partitionBy(*groups, "__s").orderBy(*order)
    outer = W.partitionBy(*groups).orderBy(*order)
    cut = salted.withColumn("__rn", F.row_number().over(inner)).where(F.col("__rn") <= n).drop("__rn", "__s")
    return cut.withColumn(out, F.row_number().over(outer)).where(F.col(out) <= n)


def percentiles(df: DataFrame, groups: Sequence[str], value: ColumnLike, wanted: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one column per entry of ``wanted``.

    Only the cells that hold a wanted rank are sorted, after equal values were counted.
    """
    groups = list(groups)
    keys = [GROUP, "__b"]
    base = settle(df.select(*groups, col(value).cast("double").alias("__v")).where("__v IS NOT NULL"), "percentiles")
    cells = with_quantile_bucket(_grouped(base, groups), "__v").drop(*groups)
    hist = cells.groupBy(*keys).agg(F.count("*").alias("__cnt"))
    before = W.partitionBy(GROUP).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumns({
        "__lo": F.coalesce(F.sum("__cnt").over(before), F.lit(0)), "__n": F.sum("__cnt").over(W.partitionBy(GROUP))})
    ranks = {}
    for name, p in wanted.items():
        low = f"floor((__n - 1) * {float(p)!r}D)"
        ranks[name] = {"lo": low, "hi": f"least({low} + 1, __n - 1)"}
    every = [r for pair in ranks.values() for r in pair.values()]
    need = hist.where(" OR ".join(f"({r} >= __lo AND {r} < __lo + __cnt)" for r in every)).drop("__cnt")
    hot = cells.join(need, keys)
    ties = hot.groupBy(*keys, "__lo", "__n", "__v").agg(F.count("*").alias("__cnt"))
    run = W.partitionBy(*keys).orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    ties = ties.withColumn("__at", F.col("__lo") + F.coalesce(F.sum("__cnt").over(run), F.lit(0)))
    parts = [
        F.expr(f"max(CASE WHEN {r} >= __at AND {r} < __at + __cnt THEN __v END)").alias(f"__{tag}_{name}")
        for name, pair in ranks.items() for tag, r in pair.items()]
    found = ties.groupBy(GROUP, "__n").agg(*parts)
    return found.selectExpr(*[f"{GROUP}.`{g}`" for g in groups], *[
        f"__lo_{name} + (__hi_{name} - __lo_{name}) * ((__n - 1) * {float(p)!r}D - {ranks[name]['lo']}) AS `{name}`"
        for name, p in wanted.items()])


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: dict[str, ColumnLike], number: str | None = None) -> DataFrame:
    """Add the sums of measures over all rows of the group before a row (the row itself left out), and its number from 1.

    ``order`` must name every row: rows that are equal in it stay in one cell. The rows are dealt by range of (groups, order), so a
    hot group is cut into as many cells as it fills; a cell's sums become offsets, and a window only spans one cell of a group.
    """
    measures = {f"__m{i}": col(c) for i, c in enumerate(sums.values())}
    named = df.select("*", *[c.alias(k) for k, c in measures.items()])
    dealt = named.repartitionByRange(bucket_count(df), *[F.col(g) for g in groups], *order).withColumn("__cell", F.spark_partition_id())
    cells = _grouped(settle(dealt, "running"), groups)
    parts = cells.groupBy(GROUP, "__cell").agg(F.count("*").alias("__n"), *[F.sum(m).alias(f"{m}s") for m in measures])
    before = W.partitionBy(GROUP).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(GROUP, "__cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}off") for c in ["__n", *[f"{m}s" for m in measures]]])
    inside = W.partitionBy(GROUP, "__cell").orderBy(*order)
    ahead = inside.rowsBetween(W.unboundedPreceding, -1)
    local = cells.withColumns({"__rn": F.row_number().over(inside), **{f"{m}l": F.coalesce(F.sum(m).over(ahead), F.lit(0)) for m in measures}})
    joined = local.join(offsets, [GROUP, "__cell"])
    out = [(F.col(f"{m}l") + F.col(f"{m}soff")).alias(name) for name, m in zip(sums, measures)]
    count = [(F.col("__rn") + F.col("__noff")).cast("bigint").alias(number)] if number else []
    return joined.select(*df.columns, *out, *count)
