from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fettle.llm import contamination as C
from fettle.llm.fmindex import FMIndex

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(text, items, size):
    """(words, hit words, items) of one text."""
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            part = w[i : i + size]
            for at in range(len(own) - len(part) + 1):
                if own[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    found.add(name)
    return len(own), len(hit), sorted(found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=0, max_size=120), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=8))
def test_index_finds_all_places(text, phrases):
    index = FMIndex(np.array(text, np.int64))
    width = max(map(len, phrases))
    matrix = np.array([p + [0] * (width - len(p)) for p in phrases])
    low, high = index.search(matrix, np.array([len(p) for p in phrases]))
    for k, p in enumerate(phrases):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def frames(spark, texts, items):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id LONG, text STRING")
    return docs, spark.createDataFrame(items, "item_id STRING, text STRING")


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="aAbé .\n1", max_size=60), min_size=20, max_size=40), st.lists(st.text(alphabet="aAbé .1", max_size=14), min_size=1, max_size=9))
def test_equals_brute_force(spark, texts, items):
    docs, bench = frames(spark, texts, [(f"i{k}", t) for k, t in enumerate(items)])
    got = C.scan(docs, bench, size=3).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [brute(t, [(f"i{k}", x) for k, x in enumerate(items)], 3) for t in texts]


def test_blocks_of_the_benchmark_add_up(spark):
    items = [(f"i{k}", " ".join(f"w{(k * 7 + j) % 40}" for j in range(20))) for k in range(30)]
    texts = [" ".join(f"w{(k * 5 + j) % 40}" for j in range(60)) for k in range(8)]
    docs, bench = frames(spark, texts, items)
    whole, parts = C.scan(docs, bench), C.scan(docs, bench, block_words=100)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_spans_cut_and_rule(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    clean, short = "Ü one, two three", " ".join(f"c{k}" for k in range(300))
    docs, bench = frames(spark, [f"É é! {passage.upper()}; end", clean, f"{short} {passage}", passage], [("a", passage), (None, passage), ("b", ""), ("c", None)])
    got = C.scan(docs, bench).withColumn("cut", C.without_spans()).orderBy("doc_id").collect()
    assert [r.cut for r in got] == ["É é! ; end", clean, f"{short} ", ""]
    assert [r.contaminated for r in got] == [True, False, False, True]
    assert [r["items"] for r in got] == [["a"], [], ["a"], ["a"]]
    assert [r.doc_id for r in C.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [1, 2]


def test_odd_texts_and_names(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e"), (2, None), (2, "word"), (2, "word")], "item_id LONG, text STRING")
    items = [(str(k), t) for k, t in ((1, "a b c d e"), (2, "word"))]
    named = odd_docs.withColumnsRenamed({"source": "n_hit", "n_chars": "items"})
    got = C.scan(named, bench).collect()
    want = sorted(str((r.doc_id, *brute(r.text, items, 13))) for r in odd_docs.collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == want
    kept = C.drop_contaminated(named, bench)
    assert kept.columns == named.columns and kept.where(F.col("n_hit") == "s").count() > 0
    assert C.scan(no_docs, bench).count() == 0
    assert C.scan(odd_docs, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
