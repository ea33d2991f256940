from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fettle.llm import jaccard


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """(id, set size, component) of each row by comparing all pairs."""
    sets = [shingles(t, size) if k is not None else set() for k, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(shingles(t, size)), least[find(i)] if sets[i] else k) for i, (k, t) in enumerate(rows)), key=str)


def corpus(seed, n=260):
    """Base texts with edited copies at all distances, shared passages, and a large group around one base."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(12)]
    rows = []
    for k in range(n):
        text = list(bases[0] if k % 3 == 0 else rng.choice(bases))
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text[at:at] = passage
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_equals_all_pairs(spark, seed, size, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = jaccard.linked(df, size=size, percent=percent, hot=4 + 8 * seed).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, size, percent)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = jaccard.linked(odd_docs).select("doc_id", "n_shingles", "component_id").collect()
    want = [(k, n, c if k is not None else None) for k, n, c in brute(rows, 4, 85)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert jaccard.linked(no_docs).count() == 0


def test_one_of_each_keeps_columns(spark, odd_docs, no_docs):
    named = odd_docs.withColumnsRenamed({"source": "component_id", "n_chars": "n_shingles"})
    kept = jaccard.one_of_each(named)
    assert kept.columns == named.columns
    found = jaccard.linked(odd_docs).select("doc_id", "component_id", "n_shingles").distinct().collect()
    want = sorted(r.doc_id for r in found if r.doc_id is not None and r.doc_id == r.component_id)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == want
    assert kept.where("doc_id IS NULL").count() == 2
    assert jaccard.one_of_each(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 163)] + [(7, k) for k in range(8, 60)] + [(60, 59)]
    found = {r.c: r.root for r in jaccard.components(spark.createDataFrame(edges, "c1 LONG, c2 LONG")).collect()}
    assert found == {k: 100 for k in range(101, 164)} | {k: 7 for k in range(8, 61)}
    assert jaccard.components(spark.createDataFrame([], "c1 LONG, c2 LONG")).count() == 0


def test_lengths():
    n, percent = 100, 85
    nothing = np.zeros(0, np.int64)
    assert jaccard.chosen_length(n, nothing, nothing, percent) == (1, 1)
    length, asked = jaccard.chosen_length(n, np.array([0, 1]), np.array([9_999, 9_999]), percent)
    assert length - asked == 2 and asked >= 1  # two hot hashes ask for two more matches
    assert jaccard.chosen_length(n, np.arange(30), np.full(30, 9_999), percent) == (0, 0)
    longer, _ = jaccard.chosen_length(n, np.arange(10), np.full(10, 40), percent)
    assert longer > 1  # many candidates: a longer prefix is cheaper


def test_bloom_passes_all_members(spark):
    ids = spark.range(5_000).select((F.col("id") * 37).alias("rep"))
    bits = jaccard.bloom(ids, "rep")
    held = [r.b for r in ids.select(F.pmod(F.xxhash64("rep"), F.lit(jaccard.BLOOM_BITS)).alias("b")).collect()]
    assert all(bits[b >> 6] >> (b & 63) & 1 for b in held)


def families(sizes, shared, seed=4, words=120, edits=3):
    """Groups of near copies of bases of which each holds the first words of one common text."""
    rng = random.Random(seed)
    common, rows = [f"c{k}" for k in range(words)], []
    for f, (size, part) in enumerate(zip(sizes, shared)):
        base = common[:part] + [f"f{f}_{k}" for k in range(words - part)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("shared", [(80, 80, 70), (110, 105, 118)])
def test_families_equal_all_pairs(spark, shared):
    rows = families((40, 50, 60), shared)
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id LONG, text STRING")).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 85)


def test_two_families_make_no_pairs_of_their_members(spark, monkeypatch):
    made, candidates = [], jaccard.prefix_candidates

    def counted(*a):
        found = candidates(*a)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "prefix_candidates", counted)
    rows = families((300, 300), (80, 80), edits=2)
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id LONG, text STRING")).select("component_id").distinct().count()
    assert got == 2 and made[0] < 100
