from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fettle.llm import quality


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    starts = {}
    for i in range(len(words) - 2):
        starts.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for found in starts.values() if len(found) > 1 for i in found for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def measured(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, t STRING")
    rows = df.select("k", quality.measured(F.col("t")).alias("m")).orderBy("k").collect()
    return [(r.m.n_words, r.m.word_chars, r.m.n_symbols, r.m.n_dup_lines, r.m.n_repeat_words) for r in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#%é　", max_size=80), min_size=30, max_size=60))
def test_counts_equal_brute_force(spark, texts):
    assert measured(spark, texts) == [plain(t) for t in texts]


def test_odd_texts(spark, odd_docs, no_docs):
    texts = [r.text for r in odd_docs.select("text").collect()]
    assert measured(spark, texts) == [plain(t) for t in texts]
    report = quality.quality_report(odd_docs)
    assert report.count() == odd_docs.count()
    assert report.where("base_failed AND kept").count() == 0
    assert quality.quality_report(no_docs).count() == 0
    assert quality.filter_documents(no_docs).columns == no_docs.columns


def test_outliers_of_a_group_fail_and_names_may_clash(spark):
    good = " ".join(f"w{k}" for k in range(100))
    bad = " ".join(f"w{k}%%%%" for k in range(100))
    rows = [(k, bad if k % 50 == 0 else good, "en", "hot" if k % 3 else "s", "c") for k in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_words STRING")
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in range(1_000) if k % 50}


def test_fences_of_small_groups_come_from_wider_ones(spark):
    m = F.struct(F.lit(100).cast("long").alias("n_words"), F.lit(256).cast("long").alias("word_chars"), F.col("s").alias("n_symbols"),
                 F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"), F.lit(1).cast("long").alias("n_lines"))
    rows = spark.createDataFrame([("en", "big", 40)] * 300 + [("en", "few", 0)] * 3 + [(None, None, 0)], "lang STRING, source STRING, s LONG").withColumn("__q_m", m)
    found = {(r["__q_lang"], r["__q_source"]): r["__q_symbols"] for r in quality.fences(quality.sketches(rows)).collect()}
    drawn = lambda n, own, wider: (n * own + 200 * wider) / (n + 200)
    assert found == {("en", "big"): 64, ("en", "few"): pytest.approx(drawn(3, 0, 40) + 24), (None, None): pytest.approx(drawn(1, 0, drawn(1, 0, 40)) + 24)}


def test_no_fence_jumps_with_a_groups_size(spark):
    m = F.struct(F.lit(100).cast("long").alias("n_words"), F.lit(256).cast("long").alias("word_chars"), F.col("s").alias("n_symbols"),
                 F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"), F.lit(1).cast("long").alias("n_lines"))
    sizes = (1, 50, 199, 200, 201, 2_000)
    rows = [("en", f"g{n}", 10) for n in sizes for _ in range(n)] + [("en", "rest", 100)] * 6_000
    df = spark.createDataFrame(rows, "lang STRING, source STRING, s LONG").withColumn("__q_m", m)
    found = {r["__q_source"]: r["__q_symbols"] for r in quality.fences(quality.sketches(df)).collect()}
    tops = [found[f"g{n}"] for n in sizes]
    assert tops == sorted(tops, reverse=True) and tops[2] - tops[4] < 2 and tops[0] > 2 * tops[-1]


def test_no_python_in_the_plan(odd_docs):
    plan = quality.measure(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
