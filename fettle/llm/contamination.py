"""Benchmark passages in documents: an FM-index over each shard of documents, searched for all test phrases.

A phrase is a window of ``size`` consecutive words of a benchmark item, or the whole item if it is shorter. A shard is a
block of documents of about 1 MB inside a task (a longer text is a shard of its own). Its index holds the runs of benchmark words that are long enough for a
phrase; other words can't be part of one. Backward search gives each phrase's range of suffixes, sampled suffix positions
its places, and places that overlap or touch are merged into removal spans. Words are compared byte for byte in the end.

The benchmark is split by hash of the item into blocks of about ``block_words`` words; a block is what a task holds at
once, and with more than one, each is a pass over the documents with the results, text included, written in between: each further
block costs a read and a write of the corpus.

Defined results: null and empty texts have no words and no hits; very long texts are searched whole; without documents there is no result; an empty benchmark hits nothing; repeated items count
once; an item without id hits but is not listed; repeated documents are judged one by one; a document column named like a
result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm import blocks as B
from fettle.llm.arrow import kept_fields, map_arrow
from fettle.llm.fmindex import FMIndex
from fettle.session import settle

SIZE = 13
BLOCK_WORDS = 200_000
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("__hit_words", T.ArrayType(T.LongType())),
])
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class Phrases:
    """The distinct windows of some items, as rows of word numbers; number 0 is no benchmark word."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = SIZE):
        data, at = B.column_bytes(pa.array([text for _, text in items], pa.string()))
        data = B.LOWER[data]
        starts, ends, bounds = B.words(data, at, B.LETTERS)
        hashes = B.hash_spans(data, starts, ends)
        self.hashes, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = [data[starts[i] : ends[i]].tobytes() for i in first]
        owners: dict[tuple[int, ...], set[str]] = {}
        for k, (name, _) in enumerate(items):
            own = (number[bounds[k] : bounds[k + 1]] + 1).tolist()
            for i in range(max(1, len(own) - size + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + size]), set()).update([name] if name is not None else [])
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.matrix = np.zeros((len(owners), int(self.lengths.max(initial=0))), np.int64)
        for k, x in enumerate(owners):
            self.matrix[k, : len(x)] = x

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence in a shard, each inside one text."""
        nothing = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(starts):
            return nothing, nothing
        number = self.numbers(B.hash_spans(data, starts, ends))
        # runs of benchmark words inside one text, as long as the shortest phrase at least
        known = number > 0
        fresh = np.zeros(len(known) + 1, bool)
        fresh[bounds] = True
        edge = known[1:] != known[:-1]
        cut = np.flatnonzero(np.concatenate([[True], edge | fresh[1:-1]]))
        size = np.diff(np.concatenate([cut, [len(known)]]))
        use = known[cut] & (size >= self.lengths.min())
        cut, size = cut[use], size[use]
        if not len(cut):
            return nothing, nothing
        # each run and a separator after it; symbols are one more, as 1 separates
        total = int(size.sum() + len(size))
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        place = np.arange(total) - np.repeat(begin, size + 1) + np.repeat(cut, size + 1)
        ends_run = begin + size
        place[ends_run] = -1
        text = np.where(place < 0, 1, number[place] + 1)
        index = FMIndex(text)
        low, high = index.search(self.matrix + 1, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = place[index.locate(rows)] if len(rows) else nothing
        # equal hashes are held against the words themselves
        hit = covered(first, self.lengths[phrase], len(starts))
        wrong = np.zeros(len(starts) + 1, np.int64)
        for i in np.flatnonzero(hit):
            wrong[i + 1] = data[starts[i] : ends[i]].tobytes() != self.words[number[i] - 1]
        wrong = np.cumsum(wrong)
        good = wrong[first + self.lengths[phrase]] == wrong[first]
        return phrase[good], first[good]


def covered(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + length, -1)
    return np.cumsum(edges[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def scan_shard(phrases: Phrases, data, offsets, earlier_words, earlier_items) -> list[tuple]:
    """A result row for each text of a shard; hits of earlier passes are taken in."""
    data = B.LOWER[data]
    starts, ends, bounds = B.words(data, offsets, B.LETTERS)
    phrase, first = phrases.find(data, starts, ends, bounds)
    hit = covered(first, phrases.lengths[phrase], len(starts)) if len(first) else np.zeros(len(starts), bool)
    doc = np.searchsorted(bounds, first, side="right") - 1
    names: dict[int, set[str]] = {}
    for d, p in set(zip(doc.tolist(), phrase.tolist(), strict=True)):
        names.setdefault(d, set()).update(phrases.owners[p])
    out = []
    for k in range(len(offsets) - 1):
        a, b = bounds[k], bounds[k + 1]
        own, listed = hit[a:b], names.get(k, set()) | set(earlier_items[k] or ())
        for x, y in zip((earlier_words[k] or [])[::2], (earlier_words[k] or [])[1::2], strict=True):
            own[x:y] = True
        if not own.any():
            out.append((b - a, 0, len(listed), sorted(listed), [], []))
            continue
        x, y = runs(own)
        text = data[offsets[k] : offsets[k + 1]]
        char = B.char_starts(text)
        from_, to = char[starts[a + x] - offsets[k]] - 1, char[ends[a + y - 1] - offsets[k] - 1]
        spans = [{"start": s, "end": e} for s, e in zip(from_.tolist(), to.tolist(), strict=True)]
        out.append((b - a, int(own.sum()), len(listed), sorted(listed), spans, np.stack([x, y], 1).ravel().tolist()))
    return out


def _scan(batches: Iterator[pa.RecordBatch], shared, kept: list[str], text: str, schema: pa.Schema, earlier: list[str]) -> Iterator[pa.RecordBatch]:
    phrases = shared.value
    for batch in batches:
        for first, end, data, offsets in B.blocks(batch[text]):
            n = end - first
            before = [batch[c].slice(first, n).to_pylist() for c in earlier] or [[None] * n] * 2
            rows = scan_shard(phrases, data, offsets, *before)
            own = [pa.array([r[i] for r in rows], schema.field(len(kept) + i).type) for i in range(len(RESULT))]
            yield pa.RecordBatch.from_arrays([batch[c].slice(first, n) for c in kept] + own, schema=schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE,
         block_words: int = BLOCK_WORDS, keep_text: bool = True, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, spans (characters) and contaminated, each named with ``prefix``.

    contaminated: a word is hit, and hit words are a twentieth of all or more.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text"))
    total = items.select(F.sum(F.size(F.split("text", r"[\x00-/:-@\[-`{-\x7f]+")))).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))
    part = F.pmod(F.xxhash64(F.coalesce("name", F.lit("")), F.coalesce("text", F.lit(""))), F.lit(n_blocks))
    result = [T.StructField(prefix + f.name, f.dataType) for f in RESULT]
    own = {f.name for f in result} | {prefix + "contaminated"}
    rows = docs.select(*[c for c in docs.columns if c not in own or c == text])
    for block in range(n_blocks):
        phrases = Phrases([(x.name, x.text) for x in items.where(part == block).distinct().collect()], size)
        last, again = block == n_blocks - 1, block > 0
        kept = [c for c in rows.columns if c not in own and (keep_text or not last or c != text)]
        fields = kept_fields(rows, kept) + result
        shared = spark.sparkContext.broadcast(phrases)
        earlier = [prefix + c for c in ("__hit_words", "items")] if again else []
        rows = map_arrow(rows, _scan, fields, shared=shared, kept=kept, text=text, earlier=earlier)
        rows = rows if last else settle(rows, "contamination")
    n_hit, n_words = F.col(prefix + "n_hit"), F.col(prefix + "n_words")
    return rows.drop(prefix + "__hit_words").withColumn(prefix + "contaminated", (n_hit > 0) & (20 * n_hit >= n_words))


def without_spans(text: str = "text", spans: str = "spans"):
    """A column: the text with the removal spans cut out."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]).cast("int").alias("a"),
        F.when(i == F.size(spans), F.char_length(text)).otherwise(F.get(spans, i)["start"]).cast("int").alias("b")))
    return F.array_join(F.transform(gaps, lambda g: F.substr(F.col(text), g["a"] + 1, g["b"] - g["a"])), "")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, as they came."""
    return scan(docs, benchmark, prefix="__dc_").where(~F.col("__dc_contaminated")).select(*docs.columns)
