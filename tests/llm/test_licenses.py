from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fettle.llm import licenses as L

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """Words and (label, place) of the exact phrases."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places = [(label, i) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


WORD = st.sampled_from(["MIT", "mit", "License", "license,", "apache", "General", "public", "é", "licence", "x\x00y", "-", "\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD, max_size=20))
def test_exact_places(parts):
    text = " ".join(parts)
    laid, n = L.layout(text)
    assert (n, sorted((x["label"], x["first_word"]) for x in L.Scanner().exact(laid))) == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_edited_notices_are_found_with_true_spans(data):
    notice, label, k = data.draw(st.sampled_from(L.NOTICES))
    text = list(notice)
    for _ in range(data.draw(st.integers(0, k))):
        at = data.draw(st.integers(1, len(text) - 2))
        if text[at] != " " and text[at - 1] != " " and text[at + 1] != " ":
            text[at] = data.draw(st.sampled_from("qzé"))
    edited = "".join(text).encode().decode()
    laid, n = L.layout(f"before {edited} after")
    found, best = L.Scanner().fuzzy(laid)
    if edits(edited.encode(), notice.encode()) <= k:
        assert label in {x["label"] for x in found} and best > 0.7
    words = laid.decode().split()
    for x in found:
        span = " ".join(words[x["first_word"] : x["first_word"] + x["n_words"]]).encode()
        assert any(edits(span, p.encode()) <= x["edits"] <= most for p, y, most in L.NOTICES if y == x["label"])


def test_pieces_cover_the_notice():
    for notice, _, k in L.NOTICES:
        parts = L.pieces(notice, k)
        assert len(parts) == k + 1 and b"".join(p for _, p in parts).decode() == notice and all(p for _, p in parts)


def test_rows(spark, odd_docs, no_docs):
    named = odd_docs.withColumnsRenamed({"source": "score", "n_chars": "places"})
    got = L.scan(named).collect()
    assert sorted(str((r.doc_id, r.n_words)) for r in got) == sorted(str((r.doc_id, plain(r.text)[0])) for r in odd_docs.collect())
    assert all(r.score == 0 and r["places"] == [] for r in got)
    assert L.scan(no_docs).count() == 0
    many = "mit license " * 20_000  # one text full of places
    row = L.scan(spark.createDataFrame([(1, many)], "doc_id LONG, text STRING")).first()
    assert len(row["places"]) == 20_000 and row.score == 1.0


def test_no_label_and_no_place_is_missed(spark):
    """Each notice is searched for in whole texts, without seeds, and each phrase at every word."""
    import random

    import regex

    rng = random.Random(9)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:80]
    for _ in range(60):
        notice, _, k = rng.choice(L.NOTICES)
        edited = list(notice)
        for _ in range(rng.randrange(2 * k + 1)):
            edited[rng.randrange(len(edited))] = rng.choice("qz")
        texts.append(f"some words {''.join(edited)} and {rng.choice(L.PHRASES)[0]}, more")
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        laid, _ = L.layout(r["text"])
        want = {label for p, label, k in L.NOTICES if regex.search(b"(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(p).encode(), k), laid)}
        assert {x["label"] for x in r["fuzzy"]} == want
        assert (r["n_words"], sorted((x["label"], x["first_word"]) for x in r["places"])) == plain(r["text"])
