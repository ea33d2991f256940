"""Repair against a plain dynamic program over (cost, audit) and, for small cases, over all strings of edits."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from fettle.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
FORM = re.compile(r"(s?(ua)+)?")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def program(rows) -> tuple[int, str, str]:
    """(cost, audit, initials) by a table over all rows and states, inserts closed over by repetition."""
    def closed(cells):
        for _ in range(3):
            for s, (c, a, r) in list(cells.items()):
                for x in "ua":
                    t = NEXT.get((s, x))
                    if t and (c + 3, a + "I", r + x) < cells.get(t, (10**9, "", "")):
                        cells[t] = (c + 3, a + "I", r + x)
        return cells

    cells = closed({"": (0, "", "")})
    for initial, fault in rows:
        new = {}
        def offer(s, x):
            if s is not None and x < new.get(s, (10**9, "", "")):
                new[s] = x
        for s, (c, a, r) in cells.items():
            offer(s, (c + 4, a + "D", r))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                offer(NEXT.get((s, initial)), (c + more, a + "K", r + initial))
                for x in "ua":
                    offer(NEXT.get((s, x)), (c + more + 3, a + "R", r + x))
        cells = closed(new)
    return min(v for s, v in cells.items() if s in ("", "a"))


def every_edit(rows) -> tuple[int, str]:
    """Over all strings of at most n + 3 edits."""
    best = (10**9, "")
    for length in range(len(rows) + 4):
        for audit in itertools.product("DIKR", repeat=length):
            if sum(x != "I" for x in audit) != len(rows):
                continue
            for roles in itertools.product("ua", repeat=sum(x in "IR" for x in audit)):
                role, left, cost, initials = iter(roles), iter(rows), 0, ""
                for x in audit:
                    initial, fault = next(left) if x != "I" else ("", "")
                    if fault in ("blank", "duplicate") and x != "D":
                        cost = 10**9
                    cost += {"D": 4, "I": 3, "K": 0, "R": 3}[x] + (3 if fault == "truncated" and x != "D" else 0)
                    initials += "" if x == "D" else initial if x == "K" else next(role)
                if FORM.fullmatch(initials):
                    best = min(best, (cost, "".join(audit)))
    return best


ROW = st.tuples(st.sampled_from("suax"), st.sampled_from(["", "", "blank", "duplicate", "truncated"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_search_equals_all_edits(rows):
    assert repair.search(rows) == every_edit(rows) == program(rows)[:2]


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=40))
def test_search_equals_the_program(rows):
    assert repair.search(rows) == program(rows)[:2]
    low = repair.bounds(rows)
    assert low[0][0] <= repair.search(rows)[0]


def test_long_conversations_are_searched_in_proportion():
    rows = [("suaxua"[k * k % 6], ["", "", "truncated", "", "blank"][k * 7 % 5]) for k in range(3_000)]
    assert repair.search(rows) == program(rows)[:2]


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield conv, [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)


def brute(rows):
    convs = defaultdict(list)
    for conv, told in damage(rows):
        convs[conv] += told
    out = []
    for conv, told in convs.items():
        told.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, marks = set(), []
        for _, role, text in told:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            marks.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in told]
        cost, audit, form = program(list(zip(initials, marks)))
        left, roles, lines = iter(told), iter(form), []
        for x in audit:
            _, role, text = next(left) if x != "I" else (0, "", "")
            if x != "D":
                due = next(roles)
                lines.append((role if x == "K" else {"u": "user", "a": "assistant"}[due]) + ":" + text)
        known = {t for t, _, _ in told if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((*[r[n] for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")],
                    hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"]).encode()).hexdigest()) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.queries()["op13_conversation_repair"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_nulls_ties_long_texts_and_clashing_names(spark):
    odd = [None, "", " \n", "word", "Done.", "done. ", "é!", "x " * 200_000 + "?"]
    rows = [(c, t if t % 3 else None, r, odd[((c or 3) + t) % len(odd)]) for c in (1, 2, None, -4, 50) for t, r in enumerate(("system", "user", None, "assistant", "user", "", "usher", "User"))]
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS copies", "2 AS __kind", "3 AS cost", "4 AS repaired")
    assert digest(repair.repair(repair.damaged(df), copies="copies")) == brute(rows)


def test_conversations_that_lose_every_row(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.repair(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)), copies="copies").collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", [])
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA)), copies="copies").collect() == []


def test_undamaged_rows_as_they_are(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 4, "user", "There?"), (1, 5, "assistant", "Yes"), (2, 0, "assistant", "Hello.")]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["gaps"], got[1]["illegal"], got[1]["cost"], got[1]["audit"]) == (2, 1, 6, "KKIKK")
    assert [t["role"] for t in got[1]["repaired"]] == ["system", "user", "assistant", "user", "assistant"]
    assert (got[2]["cost"], got[2]["audit"]) == (3, "IK")
