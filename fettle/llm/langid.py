"""Language of a text, word first, with backoff to character n-grams.

A known word scores its log frequency in each language. An unseen word is framed by marks and falls back to the longest
n-grams, of 5 characters down to 1, of which one is known; it scores their mean log frequency. The language with the
largest sum wins, ``score`` is its share of the posterior.

The model is fitted on a bounded sample of labelled documents: about ``SAMPLE`` for each language, chosen by hash of the
id. Words and n-grams that the sample holds once are left out, no others; so the broadcast model is bounded by the sample and by
nothing else. Every document is judged, whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text where nothing was
learned (an empty table teaches nothing and has no result). Letters of which no n-gram is known leave all languages equal, and the one with
most labelled documents wins. Ties go to the more frequent, then to the first language by name. Repeated rows are judged one by one. Very long texts
are judged whole, one at a time. Other columns are kept, but for the text and columns named ``lang_pred`` or ``score``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm.arrow import kept_fields, map_arrow
from fettle.session import settle

SAMPLE = 400
LONGEST = 5
CACHE = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
SMOOTH = 0.5


def grams(word: str, n: int) -> list[str]:
    framed = f"<{word}>"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


class Model:
    """Log frequencies by language; ``words`` and ``grams`` give rows of their tables."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams_: dict[str, list[int]]):
        self.langs = langs
        self.words, self.word_rows = self._table(words)
        self.grams, self.gram_rows = {}, np.zeros((0, len(langs)))
        tables = []
        for n in range(1, LONGEST + 1):
            of_size = {g: c for g, c in grams_.items() if len(g) == n}
            index, rows = self._table(of_size)
            self.grams.update({g: k + sum(map(len, tables)) for g, k in index.items()})
            tables.append(rows)
        self.gram_rows = np.concatenate(tables) if tables else self.gram_rows

    @staticmethod
    def _table(counts: dict[str, list[int]]) -> tuple[dict[str, int], np.ndarray]:
        names = sorted(counts)
        if not names:
            return {}, np.zeros((0, 1))
        c = np.array([counts[w] for w in names], float) + SMOOTH
        return {w: k for k, w in enumerate(names)}, np.log(c / c.sum(axis=0))

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean of its longest known n-grams, zeros where none is known."""
        flat, sizes = [], []
        for word in words:
            found: list[int] = []
            for n in range(min(LONGEST, len(word) + 2), 0, -1):
                if found := [k for g in grams(word, n) if (k := self.grams.get(g)) is not None]:
                    break
            flat.extend(found)
            sizes.append(len(found))
        size = np.array(sizes, np.int64)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.gram_rows[flat], axis=0)]) if flat else np.zeros((1, len(self.langs)))
        end = np.cumsum(size)
        return (sums[end] - sums[end - size]) / np.maximum(size, 1)[:, None]


class Judge:
    """Scores texts; keeps the rows of the words it has met, ``CACHE`` at most."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index = dict(self.model.words)
        self.rows = np.zeros((len(self.index) + CACHE, len(self.model.langs)))
        if self.index:
            self.rows[: len(self.index)] = self.model.word_rows

    def _learn(self, words: list[str]) -> None:
        start = len(self.index)
        self.rows[start : start + len(words)] = self.model.unseen(words)
        self.index.update((w, start + k) for k, w in enumerate(words))

    def sums(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.index})
        if len(self.index) + len(new) > len(self.rows):
            self._reset()
            new = list({w for w in words if w not in self.index})
        if len(new) > CACHE:  # one text with more unseen words than the cache holds
            names = list(own := Counter(words))
            return sum(self._weighted(names[k : k + CACHE], own) for k in range(0, len(names), CACHE))
        self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, count=len(words))
        return self.rows[at].sum(axis=0)

    def _weighted(self, words: list[str], count: Counter) -> np.ndarray:
        known = [w for w in words if w in self.model.words]
        rest = [w for w in words if w not in self.model.words]
        rows = np.concatenate([self.rows[[self.model.words[w] for w in known]] if known else self.rows[:0], self.model.unseen(rest)])
        return np.array([count[w] for w in known + rest]) @ rows

    def judge(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall((text or "").lower())
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        sums = self.sums(words)
        best = int(np.argmax(sums))
        return self.model.langs[best], float(1 / np.exp(sums - sums[best]).sum())


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Counts of words and n-grams by language over the sample, made by Spark; the model is bounded by parameters."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = sorted(((r["n"], r["l"]) for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    langs = [x for _, x in counts]
    if not langs:
        return Model([], {}, {})
    grid = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(v) for n, x in counts for v in (x, min(grid, math.ceil(grid * sample / n)))]), F.col(lang))
    chosen = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(grid)) < share)
    tokens = chosen.select(F.col(lang).alias("l"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    words = settle(tokens.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n")), "words")
    framed = F.concat(F.lit("<"), F.col("w"), F.lit(">"))
    size = F.char_length(framed)

    def pieces(k: int) -> Column:
        starts = F.when(size >= k, F.sequence(F.lit(1), size - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(framed, i, F.lit(k)))

    cut = F.flatten(F.array(*[pieces(k) for k in range(1, LONGEST + 1)]))
    grams_ = words.select("l", "n", F.explode(cut).alias("w")).groupBy("l", "w").agg(F.sum("n").alias("n"))

    place = {x: k for k, x in enumerate(langs)}

    def table(counted: DataFrame) -> dict[str, list[int]]:
        """Counts by language of the entries that the sample holds twice or more."""
        held = counted.groupBy("w").agg(F.collect_list(F.struct("l", "n")).alias("of"), F.sum("n").alias("all")).where("all >= 2")
        out = {}
        for batch in held.select("w", F.col("of.l").alias("l"), F.col("of.n").alias("n")).toArrow().to_batches():
            for w, ls, ns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = [0] * len(langs)
                for x, n in zip(ls, ns, strict=True):
                    row[place[x]] = n
                out[w] = row
        return out

    return Model(langs, table(words), table(grams_))


def _predict(batches: Iterator[pa.RecordBatch], shared, text: str, kept: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    judge = Judge(shared.value)
    for batch in batches:
        found = [judge.judge(x.as_py()) for x in batch[text]]
        own = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + own, schema=schema)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score; reads the text alone."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*kept, text)
    fields = kept_fields(rows, kept) + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_arrow(rows, _predict, fields, shared=docs.sparkSession.sparkContext.broadcast(model), text=text, kept=kept)
