"""Masked pseudo-likelihood of texts under a bidirectional window network, in numpy.

Every token is predicted from the ``SIDE`` tokens before and after it; the sum of the log-probabilities scores a text.

* Tokens are words, lower-cased. Words are counted over the whole corpus, in a table of all of them. The ``WORDS`` most frequent have
  a number each, the others share ``SUFFIXES`` numbers (cells) by their last three bytes. Number 0 stands beyond the ends of a text.
* The network is small and predicts numbers. A word without a number of its own has the probability of its cell times its share of
  the cell's tokens in the corpus, so every word has its own count. The counts of about ``NEAR`` words are broadcast to save moving them;
  those of all others are joined by word hash, and a word that was counted once needs no row. What is joined grows with the corpus.
* The network: embeddings of the window, one hidden layer, and a two-level softmax over ``CLASSES`` classes of ``CLASSES``
  tokens, so that a token costs two short rows instead of the whole vocabulary.
* Training goes over all documents: in each round every partition runs from the same weights over its texts, masking every
  ``MASK``-th token (another one in each round, so ``ROUNDS`` rounds make every token a target once); the weights are averaged by
  masked tokens in a tree of tasks. A lost task is run
  again with the same result. What is broadcast, the vocabulary, the near counts and the weights, has a fixed size.

Defined results: null, empty and wordless texts have no tokens, score 0 and no mean; repeated rows are scored one by one;
an empty corpus leaves the weights as they were set and has no result. Very long texts are blocks of their own in memory. Other columns are kept, but for
the text and columns named like a result. The weights depend on how the corpus is cut into partitions (files and their sizes), not on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm import blocks as B
from fettle.llm.arrow import field, kept_fields, map_arrow
from fettle.session import settle

CLASSES = 32
VOCABULARY = CLASSES * CLASSES
SUFFIXES = 256
WORDS = VOCABULARY - SUFFIXES - 1
NEAR = 1 << 17
SIDE = 2
WIDTH = 16
HIDDEN = 32
MASK = 2
BATCH = 1024
ROUNDS = 2
RATE = 0.1
UNITS = 1e9
FAR = 60.0

Weights = dict[str, np.ndarray]


class Vocabulary:
    """Token numbers from word hashes; ``hashes`` of the frequent words, the most frequent first."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and hash of every word."""
        h = B.hash_spans(data, starts, ends).view(np.int64)
        out = np.zeros(len(h), np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == h, 1 + self.order[at], 0)
        rest = np.flatnonzero(out == 0)
        out[rest] = cells(data, starts[rest], ends[rest])
        return out, h


class Shares:
    """Counts inside the cells: log totals by number (0 for words with a number), the near words, and ``far``, a table (h, units)."""

    def __init__(self, totals: np.ndarray, hashes: np.ndarray, n: np.ndarray, far: DataFrame):
        order = np.argsort(hashes)
        self.totals, self.sorted, self.logs, self.far = np.log(np.maximum(totals, 1)), hashes[order], np.log(n[order]), far

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.totals, self.sorted, self.logs


def cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number that a word shares with others, from its last three bytes."""
    last = np.zeros(len(ends), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        last = last * np.uint64(257) + np.where(at >= starts, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return 1 + WORDS + (B.mix(last) % np.uint64(SUFFIXES)).astype(np.int64)


def windows(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The ``2 * SIDE`` neighbours of every token; 0 beyond the ends of its text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros((len(numbers), 2 * SIDE), np.int64)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = (slice(None, step), slice(-step, None)) if step < 0 else (slice(step, None), slice(None, -step))
        out[b, k] = np.where(text[a] == text[b], numbers[a], 0) if len(numbers) > abs(step) else 0
    return out


def fresh_weights(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    shape = {"e": (VOCABULARY, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,),
             "o": (CLASSES, HIDDEN, CLASSES), "ob": (CLASSES, CLASSES)}
    scale = {"e": 0.1, "w": (2 * SIDE * WIDTH) ** -0.5, "c": HIDDEN**-0.5, "o": HIDDEN**-0.5}
    return {k: (scale.get(k, 0.0) * rng.standard_normal(s)).astype(np.float32) for k, s in shape.items()}


def by_number(numbers: np.ndarray) -> np.ndarray:
    """A stable order by token number; sixteen bits let numpy sort in linear time."""
    return np.argsort(numbers.astype(np.uint16), kind="stable")


def logits(weights: Weights, near: np.ndarray, target: np.ndarray):
    """Of the classes, and of the tokens in each target's class; rows must be ordered by class. Also what the way back needs."""
    x = weights["e"][near].reshape(len(near), -1)
    hidden = x @ weights["w"]
    hidden += weights["b"]
    np.tanh(hidden, out=hidden)
    by_class = hidden @ weights["c"]
    by_class += weights["cb"]
    group, inner = target // CLASSES, target % CLASSES
    cut = np.searchsorted(group, np.arange(CLASSES + 1))
    inside = np.empty((len(near), CLASSES), hidden.dtype)
    for k in range(CLASSES):
        a, b = cut[k], cut[k + 1]
        if a < b:
            np.matmul(hidden[a:b], weights["o"][k], out=inside[a:b])
            inside[a:b] += weights["ob"][k]
    return by_class, inside, (x, hidden, group, inner, cut)


def told(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one place; ``x`` is used up."""
    own = np.clip(x[np.arange(len(x)), at], -FAR, FAR)
    return own - np.log(exponentials(x))


def exponentials(x: np.ndarray) -> np.ndarray:
    """In place, of values held between -FAR and FAR, where single precision has no overflow; the sums of the rows."""
    np.clip(x, -FAR, FAR, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def forward(weights: Weights, near: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target; rows must be ordered by class."""
    by_class, inside, (_, _, group, inner, _) = logits(weights, near, target)
    return told(by_class, group) + told(inside, inner)


def gradients(weights: Weights, near: np.ndarray, target: np.ndarray) -> Weights:
    """Of the mean negative log-probability; rows must be ordered by class, and there must be some."""
    dc, di, (x, hidden, group, inner, cut) = logits(weights, near, target)
    n, rows = len(near), np.arange(len(near))
    for part, at in ((dc, group), (di, inner)):
        part /= exponentials(part)[:, None]
        part[rows, at] -= 1
        part /= n
    dh, ones = dc @ weights["c"].T, np.ones(n, dc.dtype)
    g = {"c": hidden.T @ dc, "cb": ones @ dc, "o": np.zeros_like(weights["o"]), "ob": np.zeros_like(weights["ob"])}
    for k in range(CLASSES):
        a, b = cut[k], cut[k + 1]
        if a < b:
            g["o"][k], g["ob"][k] = hidden[a:b].T @ di[a:b], ones[a:b] @ di[a:b]
            dh[a:b] += di[a:b] @ weights["o"][k].T
    hidden *= hidden
    np.subtract(1, hidden, out=hidden)
    dh *= hidden
    g["w"], g["b"] = x.T @ dh, ones @ dh
    dx, ids = (dh @ weights["w"].T).reshape(-1, WIDTH), near.ravel()
    order = by_number(ids)
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    g["e"] = np.zeros_like(weights["e"])
    g["e"][ids[order][first]] = np.add.reduceat(dx[order], first, axis=0)
    return g


class Trainer:
    """Adagrad from the given weights over batches of masked tokens."""

    def __init__(self, weights: Weights):
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in weights.items()}
        self.near, self.target, self.seen = [], [], 0

    def add(self, near: np.ndarray, target: np.ndarray, last: bool = False) -> None:
        self.near.append(near)
        self.target.append(target)
        if sum(map(len, self.target)) < BATCH and not last:
            return
        near, target = np.concatenate(self.near), np.concatenate(self.target)
        whole = len(target) if last else len(target) // BATCH * BATCH
        for a in range(0, whole, BATCH):
            self.step(near[a : min(a + BATCH, whole)], target[a : min(a + BATCH, whole)])
        self.near, self.target = [near[whole:]], [target[whole:]]

    def step(self, near: np.ndarray, target: np.ndarray) -> None:
        order = by_number(target)
        for k, v in gradients(self.weights, near[order], target[order]).items():
            self.squares[k] += v * v
            self.weights[k] -= RATE * v / np.sqrt(self.squares[k])
        self.seen += len(target)


def hashed_tokens(column, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, token numbers, word hashes, bounds) of the blocks of a column."""
    for first, end, data, offsets in B.blocks(column):
        data = B.LOWER[data]
        starts, ends, bounds = B.words(data, offsets, B.LETTERS)
        yield first, end, *vocabulary.numbers(data, starts, ends), bounds


def tokens(column, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, token numbers, bounds) of the blocks of a column."""
    for first, end, numbers, _, bounds in hashed_tokens(column, vocabulary):
        yield first, end, numbers, bounds


def _word_counts(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in B.blocks(batch[text]):
            data = B.LOWER[data]
            starts, ends, _ = B.words(data, offsets, B.LETTERS)
            h, at, n = np.unique(B.hash_spans(data, starts, ends).view(np.int64), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(cells(data, starts[at], ends[at])), pa.array(n.astype(np.int64))], schema=schema)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, cell, n) of every word of the corpus, as a settled table."""
    fields = [field("h", T.LongType()), field("cell", T.LongType()), field("n", T.LongType())]
    found = map_arrow(docs.select(text), _word_counts, fields, text=text)
    return settle(found.groupBy("h").agg(F.min("cell").alias("cell"), F.sum("n").alias("n")), "word-counts")


def vocabulary(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent words of the corpus, counted over all documents."""
    counts = word_counts(docs, text) if counts is None else counts
    rows = counts.orderBy(F.desc("n"), "h").limit(WORDS).collect()
    return Vocabulary(np.array([r.h for r in rows], np.int64))


def shares(counts: DataFrame, words: Vocabulary, near: int = NEAR) -> Shares:
    """The shares of all words without a number of their own; at most ``near`` of them, of the highest counts, are not in the table."""
    own = set(words.sorted.tolist())
    rest = counts.where(~F.col("h").isin(list(own))) if own else counts
    totals = np.zeros(VOCABULARY)
    for r in rest.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        totals[r["cell"]] = r["n"]
    step = F.floor(16 * F.log2("n")).alias("step")
    least, taken = math.inf, 0
    for r in sorted(rest.where("n > 1").groupBy(step).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        taken += r["k"]
        if taken > near:
            break
        least = r["n"]
    rows = rest.where(F.col("n") >= least).select("h", "n").collect() if least < math.inf else []
    far = rest.where((F.col("n") > 1) & (F.col("n") < least) if least < math.inf else F.col("n") > 1)
    return Shares(totals, np.array([r["h"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64), far.select("h", F.round(F.log("n") * UNITS).cast("long").alias("units")))


def _train(batches: Iterator[pa.RecordBatch], text: str, words, weights, round_: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    trainer = Trainer(weights.value)
    for batch in batches:
        for _, _, numbers, bounds in tokens(batch[text], words.value):
            masked = np.arange(round_ % MASK, len(numbers), MASK)
            trainer.add(windows(numbers, bounds)[masked], numbers[masked])
    trainer.add(np.zeros((0, 2 * SIDE), np.int64), np.zeros(0, np.int64), last=True)
    if trainer.seen:
        flat = np.concatenate([trainer.weights[k].ravel() for k in sorted(trainer.weights)])
        yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], schema=schema)


def train(docs: DataFrame, words: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` passes over all documents."""
    context = docs.sparkSession.sparkContext
    weights, shared = fresh_weights(), context.broadcast(words)
    fields = [field("n", T.LongType()), field("flat", T.BinaryType())]
    for round_ in range(rounds):
        own = map_arrow(docs.select(text), _train, fields, text=text, words=shared, weights=context.broadcast(weights), round_=round_)
        sums = own.rdd.map(lambda r: (r.n, np.frombuffer(r.flat, np.float32).astype(np.float64) * r.n))
        zero = (0, np.zeros(sum(v.size for v in weights.values())))
        add = lambda a, b: (a[0] + b[0], a[1] + b[1])
        # so deep that the last step brings the driver about 32 sums, however many partitions there are
        depth = max(2, math.ceil(math.log(max(2, sums.getNumPartitions()), 32)))
        n, flat = sums.treeAggregate(zero, add, add, depth=depth)
        if n:
            at = 0
            for k in sorted(weights):
                size = weights[k].size
                weights[k] = (flat[at : at + size] / n).reshape(weights[k].shape).astype(np.float32)
                at += size
    return weights


def log_probabilities(weights: Weights, numbers: np.ndarray, bounds: np.ndarray, step: int = 4 * BATCH) -> np.ndarray:
    """Of every token given its neighbours."""
    out = np.empty(len(numbers))
    near = windows(numbers, bounds)
    for a in range(0, len(numbers), step):
        target = numbers[a : a + step]
        order = by_number(target)
        out[a + order] = forward(weights, near[a : a + step][order], target[order])
    return out


def _score(batches: Iterator[pa.RecordBatch], text: str, kept: list[str], words, weights, near, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, numbers, h, bounds in hashed_tokens(batch[text], words.value):
            logp = log_probabilities(weights.value, numbers, bounds)
            columns = [batch[c].slice(first, end - first) for c in kept]
            if near:
                totals, known, logs = near.value
                logp -= totals[numbers]
                rare = np.flatnonzero(numbers > WORDS)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h[rare]), len(known) - 1)
                    found = known[at] == h[rare]
                    logp[rare[found]] += logs[at[found]]
                    rare = rare[~found]
                ends = pa.array(np.searchsorted(rare, bounds).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(h[rare])).cast(schema.field(len(kept)).type))
            sums = np.concatenate([[0.0], np.cumsum(logp)])
            n, total = np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(total), mean], schema=schema)


def score(docs: DataFrame, words: Vocabulary, weights: Weights, text: str = "text", inside: Shares | None = None) -> DataFrame:
    """``docs`` without the text, with n_tokens, pll (the sum of log-probabilities) and pll_mean.

    Without ``inside`` a word that has no number of its own scores as its cell; with it, as itself (a word that was never counted, as one
    that was counted once).
    """
    own = [field("n_tokens", T.LongType()), field("pll", T.DoubleType()), field("pll_mean", T.DoubleType())]
    kept = [c for c in docs.columns if c != text and c not in {f.name for f in own}]
    context, rows = docs.sparkSession.sparkContext, docs.select(*kept, text)
    shared = {"words": context.broadcast(words), "weights": context.broadcast(weights)}
    if inside is None:
        return map_arrow(rows, _score, kept_fields(rows, kept) + own, text=text, kept=kept, near=None, **shared)
    rows, kept = rows.withColumn("__uid", F.monotonically_increasing_id()), [*kept, "__uid"]
    fields = kept_fields(rows, kept) + [field("__far", T.ArrayType(T.LongType())), *own]
    scored = settle(map_arrow(rows, _score, fields, text=text, kept=kept, near=context.broadcast(inside.near()), **shared), "scored")
    # whole units, so that the sums don't depend on their order
    more = scored.select("__uid", F.explode("__far").alias("h")).join(inside.far, "h").groupBy("__uid").agg(F.sum("units").alias("__units"))
    both = scored.drop("__far").join(more, "__uid", "left").withColumn("pll", F.col("pll") + F.coalesce("__units", F.lit(0)) / UNITS)
    return both.withColumn("pll_mean", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))).drop("__uid", "__units")
