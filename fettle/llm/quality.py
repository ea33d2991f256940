"""Quality rules with adaptive thresholds, in DataFrame functions only.

``measure`` gives counts for each text, ``judge`` turns them into a verdict:

* fixed rules: fewer than 50 words, or more than half of the words in repeated 3-word windows;
* adaptive rules: each metric's ratio is laid on a grid of 1/256. The grid counts by language and source
  are a quantile sketch that merges by addition: exact in rank, off by 1/256 at most in value, never more
  than 257 cells for a group and metric. A group's quartiles are drawn toward its language's, and those toward the corpus',
  as if ``PRIOR`` documents of the wider sketch stood in each: few documents hardly move a fence, many make their own, and
  nothing switches at a size. A document fails where its metric lies over the group's far fence,
  ``q75 + 3 * max(q75 - q25, least spread)``; the least spread keeps a homogeneous group from failing
  ordinary documents.

Defined results: a null or blank text has no words and fails the word rule; very long texts are measured whole; null language or source is a group of
its own; repeated rows are judged one by one; no input gives no output. Input columns beside those named are not read
by ``judge`` and are kept by ``filter_documents``; own columns start with ``__q_``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle.session import settle

MIN_WORDS = 50
GRID = 256
PRIOR = 200
FENCE = 3
#: metric -> (numerator, denominator, least spread in cells of the grid)
METRICS = {
    "symbols": ("n_symbols", "word_chars", 8),
    "dup_lines": ("n_dup_lines", "n_lines", 32),
    "repeats": ("n_repeat_words", "n_words", 32),
}
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """How many words the 3-word windows at ``starts`` (ascending) cover."""
    first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last"))
    return F.aggregate(starts, first, step, lambda a: a["n"])


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more; n log n in the words of a text.

    Windows are told apart by 64-bit hashes. Only texts with an equal pair are sorted: as longs of 40 bits of hash and
    24 of place, and as full (hash, place) pairs where those bits don't suffice.
    """
    places = (1 << 24) - 1

    def full(h: Column) -> Column:
        def again(marks: Column) -> Column:
            kept = F.filter(marks, lambda x, i: (x["h"] == F.get(marks, i - 1)["h"]) | (x["h"] == F.get(marks, i + 1)["h"]))
            return _covered(F.sort_array(F.transform(kept, lambda x: x["i"])))

        return bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again)

    def short(h: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(places)).cast("int")
        equal = lambda x, y: x.bitwiseXOR(y).between(0, places)

        def told(again: Column) -> Column:
            keys = F.size(F.array_distinct(F.transform(again, lambda x: F.shiftright(x, 24))))
            hashes = F.size(F.array_distinct(F.transform(again, lambda x: F.get(h, place(x)))))
            return F.when(keys == hashes, _covered(F.sort_array(F.transform(again, place)))).otherwise(full(h))

        marks = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~places)).bitwiseOR(i.cast("long"))))
        return bind(marks, lambda m: bind(F.filter(m, lambda x, i: equal(x, F.get(m, i - 1)) | equal(x, F.get(m, i + 1))), told))

    def counted(h: Column) -> Column:
        repeats = F.when(F.size(h) > places, full(h)).otherwise(short(h))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats)

    window = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(F.slice(window, F.lit(1), F.size(words) - 2), counted))


def measured(text: Column) -> Column:
    """A struct of ``COUNTS`` for one text."""
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    length = F.char_length

    held = reduce(or_, [F.contains(whole, F.lit(c)) for c in SYMBOLS])
    symbols = F.when(held, length(whole) - length(F.translate(whole, SYMBOLS, ""))).otherwise(0)

    def counts(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
        )

    return bind(words, lambda w: bind(lines, lambda ls: counts(w, ls)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__q_m`` of counts."""
    return docs.withColumn("__q_m", measured(F.col(text)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def cell(m: Column, metric: str) -> Column:
    """The grid cell of a metric, 0 to ``GRID``."""
    top, whole, _ = METRICS[metric]
    return F.when(m[whole] > 0, F.floor(F.least(m[top], m[whole]) * GRID / m[whole])).otherwise(0).cast("int")


def sketches(measured_docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Grid counts by language, source, metric and cell; summed before the shuffle, merged by addition."""
    m = F.col("__q_m")
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), cell(m, k).alias("cell")) for k in METRICS])
    return (
        measured_docs.select(F.col(lang).alias("__q_lang"), F.col(source).alias("__q_source"), F.explode(cells).alias("c"))
        .groupBy("__q_lang", "__q_source", "c.metric", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row for each language and source with its upper fence, in cells, for each metric."""

    def quartiles(keys: list[str], name: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        run = merged.withColumns({"upto": F.sum("n").over(group.orderBy("cell")), "of": F.sum("n").over(group)})
        at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("of"), F.col("cell"))).cast("double")
        return run.groupBy(*keys, "metric").agg(F.struct(at(25).alias("q1"), at(75).alias("q3"), F.first("of").alias("n")).alias(name))

    own = quartiles(["__q_lang", "__q_source"], "own")
    wider = quartiles(["__q_lang"], "wider").withColumnsRenamed({"__q_lang": "__q_l", "metric": "__q_m2"})
    whole = quartiles([], "whole").withColumnRenamed("metric", "__q_metric")
    joined = own.join(wider, F.col("__q_lang").eqNullSafe(F.col("__q_l")) & (F.col("metric") == F.col("__q_m2"))).join(whole, F.col("metric") == F.col("__q_metric"))

    def drawn(part: str, q: str, to: Column) -> Column:
        n = F.col(f"{part}.n")
        return (n * F.col(f"{part}.{q}") + prior * to) / (n + prior)

    low, high = (drawn("own", q, drawn("wider", q, F.col(f"whole.{q}"))) for q in ("q1", "q3"))
    spread = F.create_map(*[x for k, (_, _, least) in METRICS.items() for x in (F.lit(k), F.lit(float(least)))])[F.col("metric")]
    fenced = joined.withColumn("fence", high + FENCE * F.greatest(high - low, spread))
    one = [F.max(F.when(F.col("metric") == k, F.col("fence"))).alias(f"__q_{k}") for k in METRICS]
    return fenced.groupBy("__q_lang", "__q_source").agg(*one)


def judge(measured_docs: DataFrame, lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """``measured_docs`` (a settled table, as it is read twice) with ``base_failed``, ``__q_over`` and ``kept``.

    ``__q_over`` lists the metrics over their fence. The fences are a written table of one row for a language and
    source, so Spark's own size check decides whether they are broadcast.
    """
    limits = settle(fences(sketches(measured_docs, lang, source), prior), "fences")
    m = F.col("__q_m")
    joined = measured_docs.join(limits, F.col(lang).eqNullSafe(F.col("__q_lang")) & F.col(source).eqNullSafe(F.col("__q_source")), "left")
    over = F.array_compact(F.array(*[F.when(cell(m, k) > F.col(f"__q_{k}"), F.lit(k)) for k in METRICS]))
    failed = base_failed(m)
    return joined.withColumn("__q_over", over).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.size("__q_over") == 0))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts and verdict for each row of ``docs``; texts are read once and not shuffled."""
    keep = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = settle(measure(keep).drop("text"), "quality")
    return judge(rows).select("doc_id", *[F.col("__q_m")[k].alias(k) for k in COUNTS], "base_failed", F.col("__q_over").alias("over"), "kept")


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came."""
    rows = settle(measure(docs, text), "quality")
    return judge(rows, lang, source).where("kept").select(*docs.columns)
