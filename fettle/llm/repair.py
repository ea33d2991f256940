"""Repair of conversation structure by depth-first branch and bound.

A conversation is well formed where its role initials read ``(s?(ua)+)?``. Row by row it may be kept (K, 0), given the role that is
due (R, 3) or deleted (D, 4; blank and repeated rows must be), and empty turns may be inserted (I, 3) anywhere; a truncated
row that stays costs 3 more. The cheapest edits are wanted, and of those the ASCII-least string of initials (the audit).

``search`` finds them for one conversation: an explicit stack of partial repairs, best estimate on top; lower bounds for each
suffix, from a pass backwards over rows in which a system turn counts as if an answer had come before it (so a lone
system turn seems well formed, the bound's one liberty); the incumbent (cost, audit), which cuts what cannot beat it; and for
each node (rows used, state) the best (cost, audit) that reached it, which cuts every worse prefix. An emptied stack proves
the incumbent. Prefixes are linked, not copied, so memory follows the turns.

Spark shuffles the rows by conversation and sorts them by turn; a worker streams its rows and holds one conversation.

Defined results. A null role or text is one space. Null turns come first, equal turns by role and text; ``conv_id`` null is a
conversation like another. Repeated rows are repeated turns. Rows with ``copies`` 0 only name their conversation; without other
rows it has zeros, no audit and no turns. An empty table has no result. Long texts are held one conversation at a
time. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm.arrow import field, map_arrow

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
OPEN, SYSTEM, USER, DONE = range(4)  # nothing yet, after the system turn, after a user turn, after an answer
ROLES = {"u": "user", "a": "assistant"}
#: The initial that is due in each state and where it leads; a system turn may only open.
DUE = {OPEN: ("u", USER), SYSTEM: ("u", USER), USER: ("a", DONE), DONE: ("u", USER)}
PAIRS = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"

Link = tuple  # (link before, letter, number of letters)


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none."""
    out, seen = [], set()
    for role, text in rows:
        said = text.rstrip(BLANKS)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def bounds(rows: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """Lower bounds on the cost of the rows from each place on: nothing told yet, a user turn due, an answer due.

    ``rows``: role initial and fault. The states after a system turn and after an answer are taken for one.
    """
    fresh, user, answer = 0, 0, INSERT
    out = [(fresh, user, answer)]
    for initial, fault in reversed(rows):
        now = [DELETE + fresh, DELETE + user, DELETE + answer]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault else 0
            to_answer, to_user = more + (KEEP if initial == "u" else REROLE) + answer, more + (KEEP if initial == "a" else REROLE) + user
            now = [min(now[0], to_answer), min(now[1], to_answer), min(now[2], to_user)]
            if initial == "s":
                now[0] = min(now[0], more + KEEP + user)
        a, b = now[1], now[2]
        fresh, user, answer = min(now[0], INSERT + b), min(a, INSERT + b), min(b, INSERT + a)
        out.append((fresh, user, answer))
    return out[::-1]


def spelled(link: Link | None) -> str:
    letters = []
    while link:
        letters.append(link[1])
        link = link[0]
    return "".join(reversed(letters))


def order(a: Link | None, b: Link | None) -> int:
    """Below 0, 0 or above 0 as the string of ``a`` stands before, starts with or is, or stands after that of ``b`` (of no more letters than a)."""
    n = b[2] if b else 0
    while a and a[2] > n:
        a = a[0]
    found = 0
    while a is not b:
        if a[1] != b[1]:
            found = -1 if a[1] < b[1] else 1
        a, b = a[0], b[0]
    return found


def search(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """The least cost and the ASCII-least audit of it, for role initials and faults."""
    n, least = len(rows), bounds(rows)
    place = {OPEN: 0, SYSTEM: 1, DONE: 1, USER: 2}
    best: int | None = None
    path: list[Link | None] = []  # the incumbent's link at each length
    table: dict[tuple[int, int], tuple[int, Link | None]] = {}
    stack = [(least[0][0], 0, 0, OPEN, None)]

    def hopeless(estimate: int, link: Link | None) -> bool:
        if best is None or estimate < best:
            return False
        length = link[2] if link else 0
        if estimate > best or length >= len(path):
            return estimate > best or order(link, path[-1]) >= 0
        return order(link, path[length]) > 0

    def dominated(cost: int, i: int, state: int, link: Link | None) -> bool:
        known = table.get((i, state))
        if known is None or cost < known[0]:
            return False
        if cost > known[0]:
            return True
        a, b = link[2] if link else 0, known[1][2] if known[1] else 0
        if a >= b:
            return order(link, known[1]) >= 0
        return order(known[1], link) < 0

    while stack:
        estimate, cost, i, state, link = stack.pop()
        if hopeless(estimate, link) or dominated(cost, i, state, link):
            continue
        table[i, state] = (cost, link)
        if i == n and state in (OPEN, DONE):
            best, path, step = cost, [], link
            while step:
                path.append(step)
                step = step[0]
            path = [None, *reversed(path)]
        length = link[2] + 1 if link else 1
        due, then = DUE[state]
        steps = [(INSERT, "I", i, then)]
        if i < n:
            initial, fault = rows[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault else 0
                steps.append((more + REROLE, "R", i + 1, then))
                if initial == due:
                    steps.append((more + KEEP, "K", i + 1, then))
                elif initial == "s" and state == OPEN:
                    steps.append((more + KEEP, "K", i + 1, SYSTEM))
        nodes = [(cost + c + least[j][place[s]], cost + c, j, s, (link, letter, length)) for c, letter, j, s in steps]
        nodes = [x for x in nodes if best is None or x[0] <= best]
        stack += sorted(nodes, key=lambda x: (x[0], x[4][1]), reverse=True)
    return best, spelled(path[-1])


def rebuilt(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns after the edits: the state says which role is due."""
    out, state, left = [], OPEN, iter(rows)
    for letter in audit:
        role, text = next(left) if letter != "I" else ("", "")
        if letter == "D":
            continue
        due, then = DUE[state]
        if letter == "K" and state == OPEN and role[:1] == "s":
            then = SYSTEM
        out.append((role if letter == "K" else ROLES[due], text))
        state = then
    return out


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = [field("conv_id", T.LongType()), *[field(n, T.LongType()) for n in _COUNTS], field("audit", T.StringType()), field("repaired", T.ArrayType(_TURN))]


def repaired(conv: int | None, turns: list[int | None], rows: list[tuple[str, str]]) -> list:
    marks, initials = faults(rows), [role[:1] for role, _ in rows]
    cost, audit = search(list(zip(initials, marks, strict=True)))
    counts = [gaps(turns), *[marks.count(k) for k in ("blank", "duplicate", "truncated")], sum(a + b not in PAIRS for a, b in zip(initials, initials[1:], strict=False))]
    return [conv, *counts, cost, audit, [{"role": r, "text": t} for r, t in rebuilt(rows, audit)]]


def _stream(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    conv, turns, rows, open_ = None, [], [], False

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    for one in batches:
        out, held = [], 0
        for own, turn, role, text, copies in zip(*[c.to_pylist() for c in one.columns], strict=True):
            if not open_ or own != conv:
                if open_:
                    out.append(repaired(conv, turns, rows))
                    held += sum(len(t) for _, t in rows)
                conv, turns, rows, open_ = own, [], [], True
                if held > 1 << 22:
                    yield batch(out)
                    out, held = [], 0
            turns += [turn] * copies
            rows += [(role, text)] * copies
        if out:
            yield batch(out)
    if open_:
        yield batch([repaired(conv, turns, rows)])


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and its ``repaired`` turns.

    ``rows``: ``conv_id``, ``turn``, ``role``, ``text``; ``copies`` names a column that says how often a row stands there (once without it).
    """
    spoken = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    number = F.col(copies).cast("int") if copies else F.lit(1)
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spoken("role"), spoken("text"), number.alias("__copies"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return map_arrow(dealt, _stream, _RESULT)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with seeded faults: by the digest of (conversation, turn) a row is dropped, emptied, loses its full stops, is said twice or becomes the user's.

    ``copies`` is 0 for a dropped row, 2 for one that is said twice, else 1.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("__kind"))
    return marked.select(
        "conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("__kind") == 0, 0).when(F.col("__kind") == 3, 2).otherwise(1).alias("copies"))
