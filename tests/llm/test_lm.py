from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fettle.llm import lm

SF = "/root/testdata/sf0.01/documents.parquet"


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in lm.fresh_weights().items()}
    near, target = rng.integers(0, lm.VOCABULARY, (20, 2 * lm.SIDE)), np.sort(rng.integers(0, lm.VOCABULARY, 20))
    g = lm.gradients(weights, near, target)
    for k, at in (("e", (near[3, 1], 2)), ("w", (5, 7)), ("b", (3,)), ("c", (4, 9)), ("cb", (2,)), ("o", (target[0] // 32, 3, 4)), ("ob", (target[5] // 32, 8))):
        both = []
        for step in (1e-5, -1e-5):
            moved = {n: v.copy() for n, v in weights.items()}
            moved[k][at] += step
            both.append(-lm.forward(moved, near, target).sum() / len(target))
        assert (both[0] - both[1]) / 2e-5 == pytest.approx(g[k][at], abs=1e-6)


def test_probabilities_sum_to_one():
    weights = lm.fresh_weights(3)
    near = np.array([[1, 2, 3, 4]])
    total = sum(np.exp(lm.forward(weights, near, np.array([t]))[0]) for t in range(lm.VOCABULARY))
    assert total == pytest.approx(1, abs=1e-4)


def test_windows_stop_at_the_ends_of_texts():
    got = lm.windows(np.array([5, 6, 7, 8, 9]), np.array([0, 2, 2, 5]))
    assert got.tolist() == [[0, 0, 6, 0], [0, 5, 0, 0], [0, 0, 8, 9], [0, 7, 9, 0], [7, 8, 0, 0]]
    assert lm.windows(np.zeros(0, np.int64), np.array([0, 0])).shape == (0, 4)


def test_vocabulary_holds_the_most_frequent_words(spark):
    import re

    docs = spark.read.parquet(SF)
    count = Counter()
    for r in docs.select("text").collect():
        count.update(re.findall(rb"[0-9a-z\x80-\xff]+", bytes(lm.B.LOWER[np.frombuffer(r.text.encode(), np.uint8)])))
    words = lm.vocabulary(docs)
    best = count.most_common(50)
    text = b" ".join(w for w, _ in best).decode()
    ((_, _, numbers, bounds),) = list(lm.tokens(pa.array([text]), words))
    assert bounds.tolist() == [0, 50] and (numbers <= lm.WORDS).all() and len(set(numbers.tolist())) == 50


def test_training_beats_frequencies_and_order_matters(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text")
    words = lm.vocabulary(docs)
    weights = lm.train(docs, words, rounds=6)
    rows = lm.score(docs, words, weights).collect()
    texts = pa.array([r.text for r in docs.orderBy("doc_id").collect()])
    numbers = np.concatenate([x for _, _, x, _ in lm.tokens(texts, words)])
    share = np.bincount(numbers, minlength=lm.VOCABULARY) / len(numbers)
    unigram = np.log(share[numbers]).mean()
    assert sum(r.pll for r in rows) / sum(r.n_tokens for r in rows) > unigram
    assert len(numbers) == sum(r.n_tokens for r in rows)


def test_odd_texts(spark, odd_docs, no_docs):
    words = lm.vocabulary(odd_docs)
    weights = lm.train(odd_docs, words)
    got = lm.score(odd_docs.withColumnsRenamed({"source": "pll"}).select("doc_id", "pll", "text"), words, weights).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.n_tokens == 0) == (r.pll == 0) == (r.pll_mean is None)
        assert r.n_tokens == 0 or (np.isfinite(r.pll) and r.pll < 0)
    none = lm.vocabulary(no_docs)
    assert lm.score(no_docs, none, lm.train(no_docs, none)).count() == 0
    again = lm.train(odd_docs, words)
    assert all(np.array_equal(weights[k], again[k]) for k in weights)


def test_rare_words_score_by_their_own_counts(spark):
    common = " ".join(f"c{k}" for k in range(lm.WORDS))
    rows = [(0, " ".join([common] * 6)), (1, "xaaending " * 4), (2, "xbbending " * 3 + "xccending"), (3, "a xaaending b"), (4, "a xbbending b"), (5, "a xccending b")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    counts = lm.word_counts(docs)
    words = lm.vocabulary(docs, counts=counts)
    weights = lm.train(docs, words)
    cell = {r.doc_id: r.pll for r in lm.score(docs, words, weights).collect()}
    assert cell[3] == cell[4] == cell[5]
    for near in (0, 3, lm.NEAR):
        inside = lm.shares(counts, words, near)
        got = {r.doc_id: r.pll for r in lm.score(docs, words, weights, inside=inside).collect()}
        total = np.exp(inside.totals[lm.cells(np.frombuffer(b"ing", np.uint8), np.array([0]), np.array([3]))[0]])
        assert total >= 11
        assert got[3] - got[4] == pytest.approx(np.log(5 / 4), abs=1e-6) and got[4] - got[5] == pytest.approx(np.log(4 / 2), abs=1e-6)
        assert got[1] - cell[1] == pytest.approx(4 * np.log(5 / total), abs=1e-6)
    assert len(got) == len(rows)


def test_every_token_is_a_target_once(spark):
    from types import SimpleNamespace as Shared

    texts = ["one", "two words", None, "", "a b c d e f g h i", *["x y z"] * 5]
    words = lm.vocabulary(spark.createDataFrame([(t,) for t in texts], "text STRING"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    schema = pa.schema([("n", pa.int64()), ("flat", pa.binary())])
    seen = [sum(b["n"][0].as_py() for b in lm._train(iter([batch]), "text", Shared(value=words), Shared(value=lm.fresh_weights()), r, schema)) for r in range(lm.ROUNDS)]
    assert sum(seen) == sum(len(x) for _, _, x, _ in lm.tokens(batch["text"], words)) == 27
    assert lm.ROUNDS == lm.MASK


def test_training_as_registered_beats_frequencies(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text")
    words = lm.vocabulary(docs)
    rows = lm.score(docs, words, lm.train(docs, words)).collect()
    numbers = np.concatenate([x for _, _, x, _ in lm.tokens(pa.array([r.text for r in docs.collect()]), words)])
    share = np.bincount(numbers, minlength=lm.VOCABULARY) / len(numbers)
    assert sum(r.pll for r in rows) / len(numbers) > np.log(share[numbers]).mean()


def test_whole_result_equals_plain_code(spark):
    """Every document of the smallest table scored token by token from full softmaxes, with the counts of all words."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counts = lm.word_counts(docs)
    words = lm.vocabulary(docs, counts=counts)
    weights = {k: v.astype(np.float64) for k, v in lm.train(docs, words).items()}
    rows = docs.collect()
    spoken = {r.doc_id: re.findall(rb"[0-9a-z\x80-\xff]+", bytes(lm.B.LOWER[np.frombuffer((r.text or "").encode(), np.uint8)])) for r in rows}
    count = Counter(w for own in spoken.values() for w in own)
    names = list(count)
    data, ends = np.frombuffer(b"".join(names), np.uint8), np.cumsum([len(w) for w in names])
    number = dict(zip(names, words.numbers(data, ends - [len(w) for w in names], ends)[0].tolist()))
    totals = Counter()
    for w, n in count.items():
        totals[number[w]] += n if number[w] > lm.WORDS else 0

    def tail(x):
        return x - np.log(np.exp(x - x.max()).sum()) - x.max()

    def token(near, target):
        hidden = np.tanh(weights["e"][near].ravel() @ weights["w"] + weights["b"])
        group, inner = divmod(target, lm.CLASSES)
        return tail(hidden @ weights["c"] + weights["cb"])[group] + tail(hidden @ weights["o"][group] + weights["ob"][group])[inner]

    got = {r.doc_id: r for r in lm.score(docs, words, weights, inside=lm.shares(counts, words)).collect()}
    assert len(got) == len(rows)
    for k in sorted(spoken, key=lambda k: len(spoken[k]))[:60]:
        own = spoken[k]
        ids = [0] * lm.SIDE + [number[w] for w in own] + [0] * lm.SIDE
        want = 0.0
        for i, w in enumerate(own):
            near = [ids[i + lm.SIDE + s] for s in (*range(-lm.SIDE, 0), *range(1, lm.SIDE + 1))]
            want += token(near, number[w]) + (np.log(count[w] / totals[number[w]]) if number[w] > lm.WORDS else 0)
        assert got[k].n_tokens == len(own) and got[k].pll == pytest.approx(want, rel=1e-6, abs=1e-6)
