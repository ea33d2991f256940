"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Targets. Sources in code point order (null last) weigh ``weights`` in turn and share ``share`` times all words; no target
   exceeds ``most`` times its source, the excess goes to the others by weight. With the sources in the order of ``most * size / weight``
   the full ones are a prefix, so prefix sums give the level at which the rest stand; nothing is repeated until it settles.
2. Shards and blocks. A source's documents are dealt to shards of about ``shard_docs`` by digest; a shard's words are cut into equal
   blocks of about ``block`` words (smaller everywhere where the smallest shard would have fewer than ``FINEST`` blocks, one word at least).
3. Quotas. Blocks go to the highest quotients ``votes / (2k + 1)``: first to sources by target, then each source's to its shards by their
   blocks. Most of them are certain by arithmetic; only about five quotients for each source or shard are ranked.
4. Selection. A shard's documents stand in a seeded digest order and its blocks are cut from it; each block is taken as often as the quota
   allows for all, and the first blocks once more. What a document gives is its overlap with them, at most ``most`` times its words.

The text is read once; what follows works on three numbers a document. Hot sources are only ever grouped with partial sums or by shard.

Defined results. A null or blank text has size 0 and gives nothing; a source of such texts has target 0. Null is a source, the last.
Repeated rows are documents like others; equal ids stand in one shard by size. A null id has the digest of an empty one. An empty table
has no result. Long texts are counted whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fettle.operators.ranking import running
from fettle.session import settle

WORD = r"[^\x20\x09-\x0D]+"
SHARE, MOST, WEIGHTS = 1.5, 2, (3, 1, 2)
BLOCK, FINEST, SHARD_DOCS = 256, 64, 1024
SEED = "mix"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, its key for joins (never null), the seeded digest and the number of words."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("digest"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Adds ``target`` (and whether it is ``full``) to sources with ``key``, ``source`` and ``source_size``."""
    every = F.array(*[F.lit(float(w)) for w in weights])
    numbered = running(sources, [], [F.col("source").isNull().asc(), F.col("source").asc()], {}, "no")
    weighed = numbered.withColumn("weight", F.get(every, ((F.col("no") - 1) % len(weights)).cast("int")))
    ceiling = most * F.col("source_size")
    ratio = ceiling / F.col("weight")
    ordered = settle(running(weighed.withColumn("ratio", ratio), [], [F.col("ratio").asc(), F.col("no").asc()], {"before": ceiling, "weight_before": "weight"}, "at"), "sources")
    whole = ordered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).select(F.struct("size", "weight").alias("x")).scalar()
    level = (share * whole["size"] - F.col("before")) / (whole["weight"] - F.col("weight_before"))
    stands = ordered.select("at", "ratio", level.alias("level")).where("level <= ratio").agg(F.min_by("level", "at")).scalar()
    return ordered.select(
        "key", "source_size", (stands.isNull() | (F.col("ratio") <= stands)).alias("full"),
        F.when(stands.isNull() | (F.col("ratio") <= stands), ceiling.cast("double")).otherwise(stands * F.col("weight")).alias("target"))


def apportioned(rows: DataFrame, groups: Sequence[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: of each group's ``seats`` those that go to a row by the highest quotients ``votes / (2k + 1)``, the lesser key on a tie.

    With m rows, V votes and s seats the last quotient that wins lies between V / (s + m / 2) and V / (s - m / 2): a row's seats above that
    are certain, those below are lost, and the few between are ranked.
    """
    s, m, v = F.col(seats), F.col("__m"), F.col("__v")
    sums = rows.where(F.col(votes) > 0).groupBy(*groups).agg(F.count("*").alias("__m"), F.sum(votes).cast("double").alias("__v"))
    known = rows.where(F.col(votes) > 0).join(sums, list(groups))
    certain = F.floor(F.col(votes) * (2 * s - m) / (2 * v) + 0.5) - 1
    known = known.withColumn("__least", F.greatest(F.when(2 * s > m, certain).otherwise(0), F.lit(0)).cast("bigint"))
    known = settle(known.withColumn("__most", (F.floor(F.col(votes) * (2 * s + m) / (2 * v) + 0.5) + 1).cast("bigint")), "votes")
    open_ = known.groupBy(*groups).agg((F.min(seats) - F.sum("__least")).alias("__open"))
    quotients = known.select(*groups, key, F.col(votes).cast("double").alias("__votes"), F.explode(F.sequence("__least", F.col("__most"))).alias("__k"))
    quotients = quotients.select(*groups, key, "__k", (F.col("__votes") / (2 * F.col("__k") + 1)).alias("__quotient"))
    ranked = running(quotients, groups, [F.col("__quotient").desc(), F.col(key).asc(), F.col("__k").asc()], {}, "__rank")
    won = ranked.join(open_, list(groups)).where(F.col("__rank") <= F.col("__open")).groupBy(*groups, key).agg(F.count("*").alias("__won"))
    got = known.join(won, [*groups, key], "left").select(*groups, key, (F.col("__least") + F.coalesce("__won", F.lit(0))).alias(out))
    return rows.join(got, [*groups, key], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def quotas(cells: DataFrame, sources: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Blocks of each shard and the number of them that is to be taken: ``key``, ``shard``, ``words``, ``blocks``, ``quota``.

    ``cells``: ``key``, ``shard``, ``words`` of the shards with words; ``sources`` as ``targets`` gives them.
    """
    least = cells.agg(F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"min(words) div {FINEST}"))).alias("b")).scalar()
    cut = cells.withColumn("__b", least).withColumn("blocks", F.expr("greatest(1L, (2 * words + __b) div (2 * __b))")).drop("__b")
    shards = settle(cut, "shards")
    own = shards.groupBy("key").agg(F.sum("blocks").alias("source_blocks")).join(sources, "key")
    votes = F.when(F.col("full"), 0.0).otherwise(F.col("source_blocks") * F.col("target") / F.col("source_size"))
    own = settle(own.withColumns({"votes": votes, "mix": F.lit(0)}), "source-votes")
    seats = own.agg(F.round(F.sum("votes")).cast("bigint")).scalar()
    shared = apportioned(own.withColumn("seats", seats), ["mix"], "key", "votes", "seats", "shared")
    top = most * F.col("source_blocks")
    got = shared.select("key", F.when(F.col("full"), top).otherwise(F.least(top, F.col("shared"))).alias("source_quota"))
    return apportioned(shards.join(got, "key"), ["key"], "shard", "blocks", "source_quota", "quota").select("key", "shard", "words", "blocks", "quota")


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: Sequence[int] = WEIGHTS, block: int = BLOCK,
        shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) of each document."""
    rows = settle(sized(docs, seed), "sizes")
    grouped = settle(rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "source-sizes")
    sources = settle(targets(grouped.select("key", "source", "source_size"), share, most, weights), "targets")
    shard = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") % F.ceil(F.col("n_docs") / shard_docs)
    dealt = rows.join(grouped.select("key", "n_docs"), "key").withColumn("shard", shard).drop("n_docs")
    cells = dealt.where("size > 0").groupBy("key", "shard").agg(F.sum("size").alias("words"))
    plan = quotas(settle(cells, "cells"), sources, block, most)
    before = W.partitionBy("key", "shard").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    taken = placed.join(plan, ["key", "shard"], "left").join(sources.select("key", "source_size", "target"), "key")
    once_more = F.expr("(quota % blocks) * words div blocks")
    return taken.select("doc_id", "source", "size", "source_size", "target", _taken(once_more).alias("taken"))


def _taken(end: Column) -> Column:
    """Whole rounds over all blocks, and what of the document lies before ``end``, where the blocks of the last round stop."""
    return F.coalesce(F.expr("quota div blocks") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), end - F.col("start"))), F.lit(0)).cast("bigint")
