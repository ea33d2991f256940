"""Apportionment against a list of all quotients, and the mix's promises on skewed and odd tables."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fettle.llm import mixing

SCHEMA = "doc_id BIGINT, text STRING, source STRING"


@pytest.mark.parametrize("seed", range(2))
def test_apportionment_equals_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for g in range(12):
        n = rng.choice([1, 2, 5, 40])
        votes = [rng.choice([0, 1, 1, 2, 7, rng.randrange(1, 5_000)]) for _ in range(n)]
        seats = rng.choice([0, 1, n // 2, n, 3 * n, sum(votes), 2 * sum(votes)])
        rows += [(g, k, v, seats) for k, v in enumerate(votes)]
        best = sorted((-(v / (2 * i + 1)), k) for k, v in enumerate(votes) if v for i in range(2 * seats + 2))[:seats]
        want |= {(g, k): sum(x == k for _, x in best) for k in range(n)}
    df = spark.createDataFrame(rows, "g INT, k INT, votes BIGINT, seats BIGINT")
    got = mixing.apportioned(df, ["g"], "k", "votes", "seats", "got").collect()
    assert {(r["g"], r["k"]): r["got"] for r in got} == want


def level(sizes: list[int], weights: list[int], share: float = 1.5) -> list[float]:
    """Targets by sharing the excess again until no source is above twice its size."""
    full = [False] * len(sizes)
    while True:
        rest = share * sum(sizes) - sum(2 * s for s, f in zip(sizes, full) if f)
        w = sum(w for w, f in zip(weights, full) if not f)
        out = [2.0 * s if f else rest * x / w for s, x, f in zip(sizes, weights, full)]
        over = [f or t >= 2 * s for s, t, f in zip(sizes, out, full)]
        if over == full:
            return out
        full = over


def documents(spark, sizes: dict, words: int):
    """Documents of up to ``words`` words each, so many words a source."""
    rng, rows = random.Random(5), []
    for source, size in sizes.items():
        while size > 0:
            n = min(size, rng.randrange(1, words))
            rows.append((len(rows), " ".join(["w"] * n) + " \t\n", source))
            size -= n
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("sizes", [
    {"a": 60_000, "b": 3_000, "c": 20_000, None: 9_000, "é": 40_000}, {"a": 5, "b": 70_000}, {"a": 1, "b": 1, "c": 1, "d": 1}, {f"s{k:02}": 50 + k * k for k in range(30)},
])
def test_sources_come_near_their_targets(spark, sizes):
    docs = documents(spark, sizes, 90)
    rows = mixing.mix(docs, shard_docs=64).collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, level([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])))
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    assert len(rows) == docs.count()
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), (s, taken[s], want[s])


def test_reruns_agree_on_other_partitions(spark):
    docs = documents(spark, {"a": 9_000, "b": 2_000, None: 500}, 40)
    first, again = (mixing.mix(d, shard_docs=16).orderBy("doc_id").collect() for d in (docs, docs.repartition(13)))
    assert first == again
    assert mixing.mix(docs, shard_docs=16, seed="other").orderBy("doc_id").collect() != first


def test_nulls_blanks_repeats_long_texts_and_clashing_names(spark, odd_docs, no_docs):
    extra = odd_docs.withColumns({n: F.lit(1) for n in ("key", "digest", "size", "shard", "words", "taken", "target", "start", "quota", "no", "at")})
    rows = mixing.mix(extra).collect()
    assert len(rows) == odd_docs.count() and max(r["size"] for r in rows) == 40_000
    for r in rows:
        assert r["size"] or not r["taken"]
    whole = {r["source"]: r["source_size"] for r in rows}
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(whole.values()), rel=0.01)
    assert mixing.mix(no_docs).collect() == []
    (lone,) = mixing.mix(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()
    assert (lone["size"], lone["target"], lone["taken"]) == (0, 0.0, 0)
