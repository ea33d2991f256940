"""The trie against a brute force over all prefixes of all conversations."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fettle.llm import prefixtrie, queries

SF = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def spoken(rows) -> dict[int, list[tuple[str, str]]]:
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}


def shared(convs: dict) -> dict:
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs: dict) -> list[tuple]:
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
        saved[node] = own + sum(saved[c] for c in children[node])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()), key=repr)


def told(df) -> list[tuple]:
    return sorted((tuple(r[n] for n in NAMES) for r in df.select(NAMES).collect()), key=repr)


def made(n: int, long: int) -> list[tuple]:
    """Conversations that share heads of all lengths, copies of one, long ones that part late, ones without a partner."""
    rows = []
    for c in range(n):
        for t in range(c % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if t < 3 else c % 11}"))
    for c in range(n, n + 600):
        rows += [(c, t, "user", f"copy {t}") for t in range(3)]
    for c in range(n + 600, n + 600 + long):
        rows += [(c, t, "user", f"long {t}" if t < 9 + c % 4 else f"{c % 5} late {t}") for t in range(7 + c % 12)]
    return rows


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.queries()["op12_conversation_trie"](spark, SF)) == brute(shared(spoken(rows)))


@pytest.mark.parametrize("bound", [1 << 20, 40])
def test_bands_and_single_levels_agree(spark, bound):
    rows = made(120, 40)
    lists = prefixtrie.turn_lists(spark.createDataFrame(rows, SCHEMA))
    want = brute(spoken(rows))
    assert told(prefixtrie.trie(lists, entries_bound=bound, head=4)) == want


def test_shared_heads_beyond_their_ends(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (100, 103, 104, 217, 301) for t in range({100: 2, 103: 1, 104: 9}.get(c, 3))]
    lists = prefixtrie.turn_lists(spark.createDataFrame(rows, SCHEMA))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    assert told(prefixtrie.trie(prefixtrie.with_shared_heads(lists, 100, 5, taken))) == brute(shared(spoken(rows)))


def test_nulls_ties_long_texts_and_clashing_names(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", "x" * 300_000), (2, None, "user", "first"), (2, 0, "", ""), (2, 1, "user", "x" * 300_000),
            (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "nobody"), (-7, None, None, None), (9, 5, "user", "é\U0001f600")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("keys", "chars", "depth", "key", "parent", "turns", "n_convs", "__at")})
    assert told(prefixtrie.trie(prefixtrie.turn_lists(df))) == brute(spoken(rows))


def test_an_empty_table_has_no_node(spark):
    lists = prefixtrie.turn_lists(spark.createDataFrame([], SCHEMA))
    assert prefixtrie.trie(lists).columns[:4] == ["key", "parent", "depth", "conv_id"] and told(prefixtrie.trie(lists)) == []
    none = F.lit(0)
    assert told(prefixtrie.trie(prefixtrie.with_shared_heads(lists, 100, 5, none))) == []
