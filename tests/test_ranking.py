"""The skew-safe ranks equal plain windows, also when one group or value dominates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fettle.functions.columns import draw_hash
from fettle.operators.history import region_neighbours
from fettle.operators.ranking import first_n, percentiles, row_number_by_hash, row_number_by_value


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 else f"g{rng.randrange(20)}"
        value = None if i % 97 == 0 else 5.0 if i % 4 == 0 else round(rng.expovariate(0.1), 2)
        rows.append((i, None if i % 501 == 0 else group, value))
    return spark.createDataFrame(rows, "id INT, grp STRING, v DOUBLE").repartition(5).cache()


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}


@pytest.mark.parametrize("groups", [[], ["grp"]])
def test_row_number_by_value(skewed, groups):
    order = [F.col("v").asc(), F.col("id").asc()]
    want = skewed.withColumn("rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    plain = row_number_by_value(skewed, groups, order, "v")
    tied = row_number_by_value(skewed, groups, order, "v", tie="id", total="n")
    assert pairs(plain, "id", "rn") == pairs(want, "id", "rn") == pairs(tied, "id", "rn")
    sizes = skewed.groupBy(*groups).count().collect()
    assert {r["n"] for r in tied.select("n").distinct().collect()} == {r["count"] for r in sizes}


def test_row_number_descending(skewed):
    order = [F.col("v").desc_nulls_last(), F.col("id").desc()]
    want = skewed.withColumn("rn", F.row_number().over(W.partitionBy("grp").orderBy(*order)))
    got = row_number_by_value(skewed, ["grp"], order, "v", tie="id", descending=True)
    assert pairs(got, "id", "rn") == pairs(want, "id", "rn")


def test_row_number_with_digest_tie(skewed):
    drawn = skewed.withColumn("d", draw_hash(1, "id"))
    order = [F.col("v").asc(), F.col("d").asc()]
    want = drawn.withColumn("rn", F.row_number().over(W.partitionBy("grp").orderBy(*order)))
    got = row_number_by_value(drawn, ["grp"], order, "v", tie_digest="d")
    assert pairs(got, "id", "rn") == pairs(want, "id", "rn")


def test_row_number_by_hash(skewed):
    drawn = skewed.withColumn("d", draw_hash(1, "id"))
    want = drawn.withColumn("rn", F.row_number().over(W.partitionBy("grp").orderBy("d", "id")))
    got = row_number_by_hash(drawn, ["grp"], "d", "id", total="n")
    assert pairs(got, "id", "rn") == pairs(want, "id", "rn")


def test_ranks_do_not_depend_on_partitioning(skewed):
    order = [F.col("v").asc(), F.col("id").asc()]
    one = row_number_by_value(skewed.repartition(1), ["grp"], order, "v")
    many = row_number_by_value(skewed.repartition(13, "id"), ["grp"], order, "v")
    assert pairs(one, "id", "rn") == pairs(many, "id", "rn")


def test_first_n(skewed):
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    want = skewed.withColumn("rn", F.row_number().over(W.partitionBy("grp").orderBy(*order))).where("rn <= 7")
    assert pairs(first_n(skewed, ["grp"], order, 7, "id"), "id", "rn") == pairs(want, "id", "rn")


@pytest.mark.parametrize("groups", [[], ["grp"]])
def test_percentiles(skewed, groups):
    wanted = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {tuple(r[g] for g in groups): [round(r[k], 6) for k in wanted] for r in percentiles(skewed, groups, "v", wanted).collect()}
    rows = skewed.groupBy(*groups).agg(*[F.percentile("v", F.lit(p)).alias(k) for k, p in wanted.items()]).collect()
    assert got == {tuple(r[g] for g in groups): [round(r[k], 6) for k in wanted] for r in rows}


def test_percentiles_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([("a", 2.5), ("b", None)], "grp STRING, v DOUBLE")
    assert [tuple(r) for r in percentiles(one, ["grp"], "v", {"m": 0.5}).collect()] == [("a", 2.5)]


def test_region_neighbours(spark):
    regions = spark.createDataFrame([(1, 1), (1, 3), (1, 2), (2, 9)], "inspection_id LONG, region_index INT")
    got = {(r.inspection_id, r.region_index): (r.prev_index, r.next_index) for r in region_neighbours(regions).collect()}
    assert got == {(1, 1): (None, 2), (1, 2): (1, 3), (1, 3): (2, None), (2, 9): (None, None)}


@pytest.mark.parametrize("values", [[], [None, None, None], [2.0] * 5, [None, 1.0, 1.0, float("nan")]])
def test_ranking_of_empty_null_and_equal_leads(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id LONG, v DOUBLE")
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    want = df.withColumn("rn", F.row_number().over(W.orderBy(*order)))
    for tie in (None, "id"):
        assert pairs(row_number_by_value(df, [], order, "v", tie=tie), "id", "rn") == pairs(want, "id", "rn")
    assert percentiles(df.where("NOT isnan(v)"), [], "v", {"m": 0.5}).count() <= 1


@pytest.mark.parametrize("descending", [False, True])
def test_equal_leads_rank_by_text(spark, descending):
    rows = [(f"n{(k * 37) % 101:03d}", None if k % 4 == 0 else 0.0 if k % 2 else float(k % 7)) for k in range(101)]
    df = spark.createDataFrame(rows, "name STRING, v DOUBLE")
    lead = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    want = df.withColumn("rn", F.row_number().over(W.orderBy(lead, F.col("name").asc())))
    got = row_number_by_value(df, [], [lead, F.col("name").asc()], "v", descending=descending, tie_text="name")
    assert pairs(got, "name", "rn") == pairs(want, "name", "rn")
