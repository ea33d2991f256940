from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest

from fettle.llm import langid as L

TABLE = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(TABLE).select("doc_id", "text", "lang")
    model = L.fit(docs)
    rows = L.predict(docs.select("doc_id", "lang", L.held_out().alias("held_out"), "text"), model).collect()
    assert len(rows) == 1_000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_learns_nothing_from_held_out_rows(spark):
    rows = [(k, "alpha beta gamma " * 3, "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else "yy") for k in range(40)]
    model = L.fit(spark.createDataFrame([*rows, (None, "alpha", "zz"), (99, None, "ww"), (98, "alpha", None)], "doc_id LONG, text STRING, lang STRING"))
    assert model.langs == ["yy"]


def tiny():
    words = {"the": [90, 2], "le": [2, 90]}
    grams = Counter()
    table = {}
    for word, counts in words.items():
        for n in range(1, L.LONGEST + 1):
            for g in L.grams(word, n):
                grams[g] += 1
                table[g] = [a + b for a, b in zip(table.get(g, [0, 0]), counts, strict=True)]
    return L.Model(["en", "fr"], words, table), words, table


def test_word_first_then_shorter_grams():
    model, words, table = tiny()
    judge = L.Judge(model)
    assert judge.judge("THE the")[0] == "en" and judge.judge("le")[0] == "fr"

    def log(counts, of, k):
        total = sum(c[k] + L.SMOOTH for c in of.values())
        return math.log((counts[k] + L.SMOOTH) / total)

    # known words score their own frequency
    assert judge.sums(["the", "le"]) == pytest.approx([sum(log(words[w], words, k) for w in ("the", "le")) for k in (0, 1)])
    # an unseen word takes the longest n-grams of which one is known: "<the" and no 5-gram of <then>
    four = {g: c for g, c in table.items() if len(g) == 4}
    known = [g for g in L.grams("then", 4) if g in four]
    assert known == ["<the"] and not any(g in table for g in L.grams("then", 5))
    assert judge.sums(["then"]) == pytest.approx([log(four["<the"], four, k) for k in (0, 1)])


def test_a_full_cache_changes_nothing(monkeypatch):
    text = " ".join(f"thele{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    want = L.Judge(tiny()[0]).sums(text.split())
    monkeypatch.setattr(L, "CACHE", 10)
    small = L.Judge(tiny()[0])
    assert small.sums(text.split()) == pytest.approx(want)
    assert small.judge("le " + text) == L.Judge(tiny()[0]).judge("le " + text)


def test_odd_texts(spark, odd_docs, no_docs):
    model = L.fit(spark.read.parquet(TABLE))
    got = L.predict(odd_docs.withColumnsRenamed({"source": "score"}).select("doc_id", "score", "text"), model).collect()
    assert len(got) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id IS NOT NULL").collect()}
    for r in got:
        if r.doc_id is not None:
            letters = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters)
    assert L.predict(no_docs.select("doc_id", "text"), model).count() == 0
    none = L.fit(no_docs)
    assert {r.lang_pred for r in L.predict(odd_docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_every_entry_that_is_held_twice_is_kept(spark):
    rows = [(k, " ".join(f"{x}longerword" for x in "abcdefgh"), "aa") for k in range(200)] + [(k, "pear plum", "bb") for k in range(200, 220)] + [(300, "once", "bb")]
    model = L.fit(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"))
    assert set(model.words) == {"pear", "plum", *(f"{x}longerword" for x in "abcdefgh")}


def test_whole_result_equals_plain_code(spark):
    """Every document of the smallest table judged by counts and sums in plain Python; all labelled ones are in the sample."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    learned = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    number = Counter(r.lang for r in learned)
    langs = sorted(number, key=lambda x: (-number[x], x))
    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for r in learned:
        words[r.lang].update(L.LETTERS.findall(r.text.lower()))
    for x in langs:
        for w, n in words[x].items():
            for k in range(1, L.LONGEST + 1):
                for g in L.grams(w, k):
                    grams[x][g] += n

    def table(counts):
        held = [w for w, n in sum(counts.values(), Counter()).items() if n >= 2]
        total = {}
        for w in held:
            for x in langs:
                total[x, len(w)] = total.get((x, len(w)), 0) + counts[x][w] + L.SMOOTH
        return held, total

    known, _ = table(words)
    whole = {x: sum(words[x][w] + L.SMOOTH for w in known) for x in langs}
    pieces, sizes = table(grams)
    known, pieces = set(known), set(pieces)

    def score(word, x):
        if word in known:
            return math.log((words[x][word] + L.SMOOTH) / whole[x])
        for k in range(min(L.LONGEST, len(word) + 2), 0, -1):
            found = [g for g in L.grams(word, k) if g in pieces]
            if found:
                return sum(math.log((grams[x][g] + L.SMOOTH) / sizes[x, k]) for g in found) / len(found)
        return 0.0

    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs.select("doc_id", "text"), L.fit(docs)).collect()}
    for r in rows:
        found = Counter(L.LETTERS.findall((r.text or "").lower()))
        if not found:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        sums = {x: sum(n * score(w, x) for w, n in found.items()) for x in langs}
        best = max(langs, key=lambda x: (sums[x], -langs.index(x)))
        assert got[r.doc_id][0] == best and got[r.doc_id][1] == pytest.approx(1 / sum(math.exp(s - sums[best]) for s in sums.values()), rel=1e-6)
    assert len(got) == len(rows)
