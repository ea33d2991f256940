from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fettle.llm import linededup as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_patience_is_a_common_order(a, b):
    found = D.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(i < k and j < m for (i, j), (k, m) in zip(found[:-1], found[1:], strict=True))
    assert len(found) <= lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(12)), st.sets(st.integers(0, 11)))
def test_patience_is_longest_where_lines_are_unique(a, gone):
    b = [x for x in sorted(a) if x not in gone]
    assert len(D.patience(list(a), b)) == lcs(a, b)


def test_blocks_copies_and_short_lines(spark):
    long = "\n".join(f"a long line number {k} with more than enough words in it" for k in range(4))
    rows = [(1, f"{long}\nfirst"), (2, f"head\n{long}\ntail"), (3, f"{long}\nfirst"), (4, "first\nother"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "head\ntail", 3: "", 4: "first\nother", 5: None}
    assert {r.doc_id for r in D.without_repeats(docs).collect()} == {1, 2, 4, 5}


def test_a_line_of_many_documents(spark):
    hot = "a very common line that is in every one of these many documents"
    rows = [(k, f"{hot}\nown text of {k}") for k in range(300)]
    got = {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got == {k: t if k == 0 else f"own text of {k}" for k, t in rows}


def test_blocks_name_the_earlier_document(spark):
    long = "\n".join(f"a long line number {k} with more than enough words in it" for k in range(4))
    docs = spark.createDataFrame([(1, f"\n{long}\nfirst"), (2, f"head\n{long}\ntail"), (7, f"{long}\nfirst\n{long}")], "doc_id LONG, text STRING")
    got = {r["row"]["id"]: [(b["early"], b["early_nth"], b["nth"], b["n_lines"]) for b in r["blocks"]] for r in D.deletions(docs).collect()}
    assert got == {2: [(1, 0, 1, 4)], 7: [(1, 0, 0, 5), (1, 0, 5, 4)]}


def test_subsequence_is_longest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        found = D.subsequence(a, b, 0, len(a), 0, len(b))
        assert len(found) == lcs(a, b) and all(a[i] == b[j] for i, j in found) and found == sorted(set(found))


def test_odd_texts(spark, odd_docs, no_docs):
    named = odd_docs.withColumnsRenamed({"source": "row", "n_chars": "lines"})
    got = D.dedup_lines(named)
    assert got.count() == odd_docs.count() and set(named.columns) < set(got.columns)
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in odd_docs.collect())
    assert D.dedup_lines(no_docs).count() == 0 and D.without_repeats(no_docs).columns == no_docs.columns
    same = spark.createDataFrame([(1, "x " * 12 + "\nb"), (1, "x " * 12 + "\nc"), (1, "x " * 12 + "\nb")], "doc_id LONG, text STRING")
    assert sorted(len(r.text) for r in D.dedup_lines(same).collect()) in ([1, 26, 26], [1, 1, 26])


def all_pairs(docs, min_words):
    """The texts without the runs of lines that any earlier document has too: brute force over all pairs of documents."""
    lines = {k: [(i, x.strip(" \t\x0b\f\r")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\f\r")] for k, t in docs.items()}
    gone = {k: set() for k in docs}
    for late, own in lines.items():
        for early in (lines[k] for k in docs if k < late):
            for i in range(len(early)):
                for j in range(len(own)):
                    n = 0
                    while i + n < len(early) and j + n < len(own) and early[i + n][1] == own[j + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in own[j : j + n]) >= min_words:
                        gone[late].update(i for i, _ in own[j : j + n])
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in docs.items()}


def texts(spark, docs):
    return {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")).collect()}


def test_a_passage_of_many_documents_in_another_order(spark):
    p, q1, q2 = "\n".join(f"p{k} " + "word " * 13 for k in range(4)), "q1 " + "word " * 12, "q2 " + "word " * 12
    for n in (6, 7, 9):
        docs = {1: f"{p}\n{q1}\n{q2}"} | {k: f"{q1}\n{q2}\n{p}\nown {k}" for k in range(2, n + 1)}
        assert texts(spark, docs) == {k: t if k == 1 else f"own {k}" for k, t in docs.items()}


def test_short_lines_of_a_passage_with_different_first_holders(spark):
    verse = [f"v{k} one two three" for k in range(6)]
    docs = {k: f"{verse[k]}\nown {k}" for k in range(6)} | {k: "\n".join([*verse, f"own {k}"]) for k in range(6, 20)}
    assert texts(spark, docs) == {k: t if k < 7 else f"own {k}" for k, t in docs.items()}


def test_equals_brute_force_over_all_pairs(spark):
    rng = random.Random(11)
    pool = [f"l{k} " + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 12))) for k in range(9)] + ["", "  "]
    docs = {k: "\n".join(rng.choice(pool) if rng.random() < 0.85 else f"own {k} {j}" for j in range(rng.randint(0, 14))) for k in range(60)}
    assert texts(spark, docs) == all_pairs(docs, D.MIN_WORDS)


def test_a_passage_twice_in_one_document(spark):
    p = "\n".join(f"p{k} " + "word " * 5 for k in range(3))
    q, r, s = (f"{x} one two" for x in "qrs")
    docs = {1: p, 2: f"{q}\n{p}\n{r}\n{p}\n{s}", 3: f"{q}\n{r}\n{s}"}
    assert texts(spark, docs) == {1: p, 2: docs[3], 3: docs[3]}
    held = lambda t: [{"nth": n, "line": n, "key": x, "words": len(x.split())} for n, x in enumerate(t.split("\n"))]
    assert D.common_blocks(held(docs[1]), held(docs[2]), D.MIN_WORDS) == [1, 2, 3, 5, 6, 7]
    assert texts(spark, {1: f"{p}\n{q}\n{p}", 2: f"{r}\n{p}"}) == {1: f"{p}\n{q}\n{p}", 2: r}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_blocks_hold_those_of_the_alignment(a, b):
    held = lambda keys: [{"nth": n, "line": n, "key": x, "words": x + 1} for n, x in enumerate(keys)]
    found, block = set(D.common_blocks(held(a), held(b), 8)), []
    for pair in [*D.patience(a, b), None]:
        if pair and block and pair == (block[-1][0] + 1, block[-1][1] + 1):
            block.append(pair)
            continue
        if sum(b[j] + 1 for _, j in block) >= 8:
            assert {j for _, j in block} <= found
        block = [pair]
