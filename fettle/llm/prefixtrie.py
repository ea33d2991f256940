"""The trie of conversation prefixes by truncation peeling.

Two conversations share a node of depth d where their first d turns have equal roles and texts. The trie is peeled from its
greatest depth: the conversations that end at a depth meet the nodes that survived from below, equal sequences become one
node with all its sums, its last turn is stripped, and what is left is grouped anew. So nodes are found and summed in the
same pass, and a node is moved once for each regrouping.

* Equal conversations are one entry from the start (their ids are gathered in pieces of 256 neighbouring numbers and
  streamed into the digest), so a group of copies costs one row a level.
* The upper ``HEAD`` levels, which a third of all conversations may share, are regrouped by one ``groupBy`` each: partial
  sums are made before the shuffle.
* Below, a band of levels (9-16, 17-32, ...) is peeled in one shuffle by the prefix above the band, inside the tasks, as long as no
  such prefix leads to more than ``ENTRIES`` turns of the band. A band with a fuller prefix is regrouped level by level.

A node's identity is a chain of SHA-256 digests, cut to 128 bits, over the roles and texts on its path.

Defined results. A null role or text counts as empty. Rows without ``conv_id`` belong to no conversation and are left out. Turns are
ordered by ``turn``, null first; equal numbers (repeated rows too, which stay) by digest. A conversation without turns is a member of the
root only. An empty table has no node, not even the root. Texts are digested in the scan and never moved, however long;
a worker holds 24 bytes for each turn of one conversation. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm.arrow import field, map_arrow
from fettle.session import settle

KEY = 16
HEAD = 8
#: Turns of one band under one prefix that a task may hold.
ENTRIES = 1 << 20
#: Conversations of one piece of a group of copies share all but this many bits of their id.
PIECE_BITS = 8

_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_PATH = [field("depth", T.IntegerType()), field("keys", T.BinaryType()), field("chars", T.ArrayType(T.LongType()))]
_ENTRY = [*_PATH, field("conv_id", T.LongType()), *[field(n, T.LongType()) for n in _SUMS], field("ends_sha256", T.StringType())]
_ENTRY_NAMES = [f.name for f in _ENTRY]


def turn_lists(rows: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id`` and its ``turns`` in order, each as digest and number of code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, KEY)
    turn = F.struct(F.col("turn").alias("at"), digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    told = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"))
    lists = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(lists: DataFrame, every: int, most: int, taken: Column) -> DataFrame:
    """Each conversation's first ``taken`` turns (``most`` at most) replaced by those of the conversation at its id's multiple of ``every``.

    That conversation may have fewer turns, then all are used, or be absent, then none.
    """
    lists = settle(lists, "turn-lists")
    heads = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__head"), F.slice("turns", 1, most).alias("__turns"))
    own = lists.withColumn("__head", F.col("conv_id") - F.col("conv_id") % every).withColumn("__taken", taken.cast("int"))
    joined = own.join(heads, "__head", "left")
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("__taken") + 1, F.greatest(F.size("turns") - F.col("__taken"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("__turns", F.lit(1), F.col("__taken")), none), rest).alias("turns"))


def _chains(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The chain of prefix keys of each conversation, as one run of bytes."""
    for batch in batches:
        turns, keys, chars = batch.column("turns"), [], []
        flat, at = turns.flatten(), turns.offsets.to_pylist()
        digests, lengths = flat.field("digest").to_pylist(), flat.field("chars").to_pylist()
        at = [x - at[0] for x in at] if at else [0]
        for first, end in zip(at, at[1:], strict=False):
            chain, key = [], b""
            for digest in digests[first:end]:
                key = hashlib.sha256(key + digest).digest()[:KEY]
                chain.append(key)
            keys.append(b"".join(chain))
            chars.append(lengths[first:end])
        depth = [len(c) for c in chars]
        yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), pa.array(keys, pa.binary()), pa.array(chars, pa.list_(pa.int64())), batch.column("conv_id")], schema=schema)


def _ended(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct conversation, from its pieces in ascending order; the ids run through the digest."""
    entry, digest = None, None

    def close() -> list:
        return [*entry, 0, 0, 0, digest.hexdigest()]

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if entry is not None and row["keys"] == entry[1]:
                entry[4] += row["n"]
                digest.update(b",")
            else:
                if entry is not None:
                    out.append(close())
                entry, digest = [row["depth"], row["keys"], row["chars"], row["conv_id"], row["n"]], hashlib.sha256()
            digest.update(row["ids"].encode())
        if out:
            yield _batch(out, schema)
    if entry is not None:
        yield _batch([close()], schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def distinct_conversations(lists: DataFrame) -> DataFrame:
    """One entry for each distinct sequence of turns: its path of prefix keys, members and the digest of their ids."""
    chains = map_arrow(lists.select("conv_id", "turns"), _chains, [*_PATH, field("conv_id", T.LongType())])
    piece = F.shiftright("conv_id", PIECE_BITS)
    pieces = chains.groupBy("keys", piece.alias("piece")).agg(
        F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    streams = pieces.repartition("keys").sortWithinPartitions("keys", "piece")
    return map_arrow(streams.select("depth", "keys", "chars", "conv_id", "n", "ids"), _ended, _ENTRY)


def _key(depth: int) -> Column:
    return F.substring("keys", KEY * (depth - 1) + 1, KEY) if depth else F.unhex(F.lit(""))


def _fullest(entries: DataFrame, depths: list[int]) -> dict[int, int]:
    """For each depth the number of entries that reach below it through its fullest prefix."""
    at = F.explode(F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d < F.col("depth")))
    through = entries.select("keys", at.alias("at")).groupBy("at", F.expr(f"substring(keys, {KEY} * (at - 1) + 1, {KEY})").alias("prefix")).count()
    return {r["at"]: r["n"] for r in through.groupBy("at").agg(F.max("count").alias("n")).collect()}


def _peel_band(batches: Iterator[pa.RecordBatch], schema: pa.Schema, low: int) -> Iterator[pa.RecordBatch]:
    """Peel the entries under each prefix of depth ``low`` down to it; entries of a prefix follow each other."""
    levels: dict[int, dict[bytes, list]] = {}
    prefix = None

    def meet(keys: bytes, chars: list, depth: int, conv: int, sums: list[int], ends: str | None) -> None:
        own = levels.setdefault(depth, {}).setdefault(keys, [chars, conv, [0, 0, 0, 0], None])
        own[1] = min(own[1], conv)
        own[2] = [a + b for a, b in zip(own[2], sums, strict=True)]
        own[3] = ends or own[3]

    def peeled() -> list:
        out = []
        for depth in range(max(levels, default=low), low, -1):
            for keys, (chars, conv, (n, children, leaves, saved), ends) in levels.pop(depth, {}).items():
                leaves, saved = leaves if children else 1, saved + (n - 1) * chars[depth - 1]
                out.append([depth, keys[-2 * KEY :], None, conv, n, children, leaves, saved, ends])
                meet(keys[:-KEY], chars, depth - 1, conv, [n, 1, leaves, saved], None)
        for keys, (chars, conv, sums, _) in levels.pop(low, {}).items():
            out.append([low, keys, chars[:low], conv, *sums, None])
        return out

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = row["keys"][KEY * (low - 1) : KEY * low]
            if own != prefix:
                out += peeled()
                prefix = own
            meet(row["keys"], row["chars"], row["depth"], row["conv_id"], [row[n] for n in _SUMS], row["ends_sha256"])
        if out:
            yield _batch(out, schema)
    if out := peeled():
        yield _batch(out, schema)


def _node(keys: str, depth: str) -> list[Column]:
    """A node's own key and its parent's, which end its path."""
    return [F.expr(f"substring({keys}, length({keys}) - {KEY - 1}, {KEY})").alias("key"), F.expr(f"CASE WHEN {depth} > 1 THEN substring({keys}, length({keys}) - {2 * KEY - 1}, {KEY}) ELSE X'' END").alias("parent"), F.col(depth), "conv_id", *_SUMS, "ends_sha256"]


def _regrouped(entries: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth, complete: equal sequences meet, newly ended and surviving ones alike."""
    nodes = entries.groupBy(_key(depth).alias("__key")).agg(
        F.first("keys").alias("keys"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in _SUMS], F.max("ends_sha256").alias("ends_sha256")).drop("__key")
    last = F.get("chars", F.lit(depth - 1)) if depth else F.lit(0)
    return nodes.withColumns({
        "depth": F.lit(depth), "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * last}).select(*_ENTRY_NAMES)


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth`` as survivors of the depth above: each is one child."""
    return nodes.select(
        F.lit(depth - 1).alias("depth"), F.substring("keys", 1, KEY * (depth - 1)).alias("keys"), F.slice("chars", 1, depth - 1).alias("chars"), "conv_id",
        "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))


def bands(deepest: int, head: int = HEAD) -> list[tuple[int, int]]:
    """(low, high] bands of depths below ``head``, the deepest first; each is as wide as all above it."""
    edges = [head]
    while edges[-1] < deepest:
        edges.append(2 * edges[-1])
    return [(low, min(high, deepest)) for low, high in zip(edges, edges[1:], strict=False)][::-1]


def trie(lists: DataFrame, entries_bound: int = ENTRIES, head: int = HEAD) -> DataFrame:
    """All nodes of the trie over ``turn_lists``-like rows: ``key``, ``parent`` (keys), ``depth``, ``conv_id`` and ``parent_conv_id``
    (smallest members), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    ended = settle(distinct_conversations(lists), "trie-ended")
    deepest = ended.agg(F.max("depth")).first()[0]
    below = bands(deepest or 0, head)
    full = _fullest(ended, [low for low, _ in below]) if below else {}
    found: list[DataFrame] = []
    alive = ended.where("false")

    def level(depth: int) -> None:
        nonlocal alive
        nodes = settle(_regrouped(alive.unionByName(ended.where(F.col("depth") == depth)), depth), "trie-level")
        found.append(nodes.select(*_node("keys", "depth")))
        alive = _stripped(nodes, depth) if depth else alive

    for low, high in below:
        if full.get(low, 0) * (high - low) > entries_bound:
            for depth in range(high, low, -1):
                level(depth)
            continue
        entries = alive.unionByName(ended.where((F.col("depth") > low) & (F.col("depth") <= high)))
        dealt = entries.withColumn("__at", _key(low)).repartition("__at").sortWithinPartitions("__at").drop("__at")
        peeled = settle(map_arrow(dealt, _peel_band, _ENTRY, low=low), "trie-band")
        found.append(peeled.where("chars IS NULL").select(*_node("keys", "depth")))
        alive = peeled.where("chars IS NOT NULL")
    for depth in range(min(head, deepest or 0), -1, -1):
        level(depth)
    root = found[-1].agg(F.min("conv_id")).scalar()
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.where("depth > 0 AND n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("__conv"))
    parent_conv = F.when(F.col("depth") == 1, root).otherwise(F.col("__conv"))
    return nodes.join(parents, "parent", "left").select(
        "key", "parent", F.col("depth").cast("bigint").alias("depth"), "conv_id", parent_conv.alias("parent_conv_id"), *_SUMS,
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
