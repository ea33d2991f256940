"""Lines that a later document shares with an earlier one, found by aligning the two.

A line is known by the hash of its text without blanks at its ends; blank lines are left alone. A block is a run of neighbouring
lines of ``MIN_WORDS`` words or more; every line of a block that also stands in an earlier document, wherever it stands in
either of them and however often, is deleted. Later means a larger id.

1. Pairs. Each line begins one shortest run of ``MIN_WORDS`` words and ends another. A run that several documents hold is a rare
   line sequence even where its lines are frequent; every holder meets the run's first holder, so a passage of n documents makes n - 1
   pairs and the lines of any longer block are covered by runs inside it.
2. Alignment. The shared runs of a pair say where equal lines stand in both. ``patience`` aligns them: lines that are unique in both, in
   the longest rising order, then the gaps between, and an exact longest common subsequence in small gaps without unique lines.
3. Blocks. Aligned neighbours that hold a whole run are a block. A run that no block covers (its text stands in another order, or
   repeats) is aligned again around itself, until every shared run is covered; so the deletions equal those of comparing all pairs.

Runs are told apart by 128 bits; what moves is a run's hashes, a row, its place and its line hashes. All pairs of one later document
meet in one task, and only with their shared runs.

Defined results: null and empty texts stay as they are, an empty table stays empty; a row without id is
neither compared nor changed; rows with the same id are told apart by their text, the larger text hash counting as later,
and equal rows get equal results; nothing is deleted from the first holder of a run. Very long texts are blocks of their own in memory. Other columns
are kept, whatever their names, but for ``__n_lines``, ``__n_deleted`` and ``__th``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm import blocks as B
from fettle.llm.arrow import field, map_arrow
from fettle.llm.tables import Tables
from fettle.session import settle

MIN_WORDS = 10
NEWLINE = 10
BLANKS = " \t\x0b\f\r"
#: Cells of the table of a gap without unique lines; larger gaps are left to the runs that they do not cover.
GAP = 1 << 14
#: A second value for each byte, for the second half of a line's 128 bits.
OTHER = np.random.default_rng(11).permutation(256).astype(np.uint8)

Block = tuple[int, int, int]  # place in the later document, place in the earlier one, lines


def in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (sorted by the first place) whose second places rise."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        back[k] = at[n - 1] if n else -1
        ends[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def subsequence(a: list[int], b: list[int], x: int, xe: int, y: int, ye: int) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of ``a[x:xe]`` and ``b[y:ye]``."""
    best = [[0] * (ye - y + 1)]
    for i in range(xe - 1, x - 1, -1):
        row, under = [0] * (ye - y + 1), best[-1]
        for j in range(ye - y - 1, -1, -1):
            row[j] = under[j + 1] + 1 if a[i] == b[y + j] else max(under[j], row[j + 1])
        best.append(row)
    best.reverse()
    out, i, j = [], 0, 0
    while i < xe - x and j < ye - y:
        if a[x + i] == b[y + j]:
            out.append((x + i, y + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in ``a``, in ``b``) of the lines that match, both rising."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        x, xe, y, ye = open_.pop()
        while x < xe and y < ye and a[x] == b[y]:
            out.append((x, y))
            x, y = x + 1, y + 1
        while x < xe and y < ye and a[xe - 1] == b[ye - 1]:
            xe, ye = xe - 1, ye - 1
            out.append((xe, ye))
        if x >= xe or y >= ye:
            continue
        in_a, in_b = Counter(a[x:xe]), Counter(b[y:ye])
        place = {b[j]: j for j in range(y, ye) if in_b[b[j]] == 1}
        anchors = in_order([(i, place[a[i]]) for i in range(x, xe) if in_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            if (xe - x) * (ye - y) <= GAP and in_a.keys() & in_b.keys():
                out += subsequence(a, b, x, xe, y, ye)
            continue
        out += anchors
        edges = [(x - 1, y - 1), *anchors, (xe, ye)]
        open_.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True) if i + 1 < k and j + 1 < m)
    return sorted(out)


def aligned_blocks(shared: list[tuple[int, int, list[int]]]) -> list[Block]:
    """The common blocks of a pair, from its shared runs: (place in the later, place in the earlier, line keys).

    Aligned lines that are neighbours in both documents make a block if it holds a whole run; runs that are left are blocks of
    their own, as far as their neighbours agree.
    """
    late, early = {}, {}
    for j, i, keys in shared:
        late.update(zip(range(j, j + len(keys)), keys))
        early.update(zip(range(i, i + len(keys)), keys))
    a, b = sorted(early), sorted(late)
    ends = sorted((j, j + len(keys)) for j, _, keys in shared)
    blocks: list[Block] = []
    covered: set[int] = set()

    def add(j: int, i: int, n: int) -> None:
        blocks.append((j, i, n))
        covered.update(range(j, j + n))

    def close(j: int, i: int, n: int) -> None:
        k = bisect_left(ends, (j, 0))
        while k < len(ends) and ends[k][0] < j + n:
            if ends[k][1] <= j + n:
                add(j, i, n)
                return
            k += 1

    start: tuple[int, int, int] | None = None
    for x, y in patience([early[i] for i in a], [late[j] for j in b]):
        i, j = a[x], b[y]
        if start and (j, i) == (start[0] + start[2], start[1] + start[2]):
            start = (start[0], start[1], start[2] + 1)
            continue
        if start:
            close(*start)
        start = (j, i, 1)
    if start:
        close(*start)
    for j, i, keys in shared:
        n = len(keys)
        if all(k in covered for k in range(j, j + n)):
            continue
        while (j - 1) in late and late[j - 1] == early.get(i - 1):
            j, i, n = j - 1, i - 1, n + 1
        while (j + n) in late and late[j + n] == early.get(i + n):
            n += 1
        add(j, i, n)
    return blocks


def common_blocks(early: list[dict], late: list[dict], min_words: int) -> list[int]:
    """The lines of ``late`` (their places in the text) in blocks that it shares with ``early``, every copy of each."""

    def stretches(held: list[dict]) -> Iterator[tuple[int, int]]:
        """Of each line the shortest run of neighbours that begins with it, and the one that ends with it."""
        for k in range(len(held)):
            for step in (1, -1):
                n, at = held[k]["words"], k
                while n < min_words and 0 <= at + step < len(held) and held[at + step]["nth"] == held[at]["nth"] + step:
                    at += step
                    n += held[at]["words"]
                if n >= min_words:
                    yield min(k, at), max(k, at) + 1

    known: dict[tuple, int] = {}
    for a, e in stretches(early):
        known.setdefault(tuple(x["key"] for x in early[a:e]), early[a]["nth"])
    runs_ = {(late[a]["nth"], tuple(x["key"] for x in late[a:e])) for a, e in stretches(late)}
    shared = [(j, known[keys], list(keys)) for j, keys in sorted(runs_) if keys in known]
    line = {x["nth"]: x["line"] for x in late}
    return sorted({line[k] for j, _, n in aligned_blocks(shared) for k in range(j, j + n)})


def runs(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """The shortest runs of a block of texts: text, hash, check, place among its text's lines with a word, first line and end (as places in what follows);
    then of those lines the place in their text and the key."""
    starts, ends, bounds = B.words(data, offsets, B.NOT_BLANK)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 8
    broken = np.concatenate([[0], np.cumsum(data == NEWLINE)])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    place = broken[starts] - broken[offsets[text]]
    new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
    last = np.append(new[1:], len(starts))
    key, check = (B.hash_spans(d, starts[new], ends[last - 1]) for d in (data, OTHER[data]))
    text, lines, n = text[new], place[new], len(new)
    upto = np.append(new, len(starts))
    head, tail = np.searchsorted(text, text), np.searchsorted(text, text, side="right")
    forward = np.searchsorted(upto, upto[:-1] + min_words)
    backward = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    at = np.arange(n)
    f, b = forward <= tail, backward >= head
    spans = np.unique(np.concatenate([at[f] * (n + 1) + forward[f], backward[b] * (n + 1) + at[b] + 1]))
    a, e = spans // (n + 1), spans % (n + 1)
    h = (e - a).astype(np.uint64)
    h2 = ~h
    for k in range(int((e - a).max(initial=0))):
        more = np.flatnonzero(a + k < e)
        h[more] = B.mix(h[more] * np.uint64(B.BASE) + key[a[more] + k])
        h2[more] = B.mix(h2[more] * np.uint64(B.BASE) + check[a[more] + k])
    return text[a], h.view(np.int64), h2.view(np.int64), a - head[a], a, e, lines, key.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], text: str, min_words: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in B.blocks(batch[text]):
            owner, h, check, nth, a, e, lines, keys = runs(data, offsets, min_words)
            if not len(h):
                continue
            ends = np.concatenate([[0], np.cumsum(e - a)])
            inside = np.arange(ends[-1]) + np.repeat(a - ends[:-1], e - a)
            rows = batch["row"].slice(first, end - first).take(pa.array(owner))
            listed = lambda x, k: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)).cast(schema.field(k).type)
            yield pa.RecordBatch.from_arrays([rows, pa.array(h), pa.array(check), pa.array(nth.astype(np.int32)), listed(lines[inside].astype(np.int32), 4), listed(keys[inside], 5)], schema=schema)


def _align(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Align each pair of a row; rows come sorted by later and earlier document."""
    row, early, shared, line, found = None, None, [], {}, []

    def close_pair() -> None:
        for j, i, n in aligned_blocks(shared):
            found.append({"early": early["id"], "early_h": early["h"], "early_nth": i, "nth": j, "n_lines": n})

    def close_row() -> dict:
        return {"row": row, "lines": sorted({line[k] for b in found for k in range(b["nth"], b["nth"] + b["n_lines"])}), "blocks": found}

    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if x["row"] != row or x["first"] != early:
                if row is not None:
                    close_pair()
                shared, early = [], x["first"]
            if x["row"] != row:
                if row is not None:
                    out.append(close_row())
                row, line, found = x["row"], {}, []
            line.update(zip(range(x["nth"], x["nth"] + len(x["lines"])), x["lines"]))
            shared.append((x["nth"], x["early_nth"], x["keys"]))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if row is not None:
        close_pair()
        yield pa.RecordBatch.from_pylist([close_row()], schema=schema)


def deletions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, tables: Tables | None = None) -> DataFrame:
    """(row, lines, blocks): the places of the lines to delete, and the blocks that each earlier document accounts for.

    ``row`` is a struct of id and text hash. A block has the earlier document's id and text hash, its place there and here among the lines with a word,
    and its number of lines. ``tables`` holds what is written on the way.
    """
    tables = tables or Tables(docs.sparkSession)
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("row")
    held = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(row, F.col(text).alias("text"))
    kind = held.schema["row"].dataType
    block = T.StructType([T.StructField("early", kind["id"].dataType), T.StructField("early_h", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("early_nth", "nth", "n_lines")]])
    whole, ints = T.LongType(), T.ArrayType(T.IntegerType())
    fields = [field("row", kind), field("run", whole), field("check", whole), field("nth", T.IntegerType()), field("lines", ints), field("keys", T.ArrayType(whole))]
    occ = tables.settle(map_arrow(held, _runs, fields, text="text", min_words=min_words), "runs")
    holders = occ.groupBy("run", "check").agg(F.min(F.struct("row", "nth")).alias("first"), F.max("row").alias("last")).where("first.row < last")
    first = tables.settle(holders.select("run", "check", F.col("first.row").alias("first"), F.col("first.nth").alias("early_nth")), "holders")
    later = occ.join(first, ["run", "check"]).where(F.col("first") < F.col("row")).select("row", "first", "nth", "early_nth", "lines", "keys")
    pairs = later.repartition("row").sortWithinPartitions("row", "first", "nth")
    return map_arrow(pairs, _align, [field("row", kind), field("lines", ints), field("blocks", T.ArrayType(block))])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the shared lines cut from ``text``, and __n_lines and __n_deleted."""
    tables = Tables(docs.sparkSession)
    found = settle(deletions(docs, id_col, text, min_words, tables), "deleted")
    tables.drop_all()
    gone = found.select(F.col("row.id").alias("__id"), F.col("row.h").alias("__h"), F.col("lines").alias("__lines"))
    hashed = docs.withColumn("__th", F.xxhash64(text))
    joined = hashed.join(gone, (F.col(id_col) == F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    split = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__lines"))
    cut = F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(split))
    return joined.select(
        *[F.when(F.col("__lines").isNull(), F.col(text)).otherwise(cut).alias(text) if c == text else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias("__n_lines"), F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("__n_deleted"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the shared lines cut; documents that lose all their words with them go."""
    done = dedup_lines(docs, id_col, text)
    left = F.btrim(F.col(text), F.lit(BLANKS + "\n")) != ""
    return done.where((F.col("__n_deleted") == 0) | left).select(*docs.columns)
