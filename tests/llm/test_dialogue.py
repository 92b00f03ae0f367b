"""Conversation repair against a plain dynamic programme and against all scripts."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest

from chromaloom.llm import dialogue as d, queries
from tests.oracle import compare, connect

R = random.Random(9)


def plain_best(rows):
    """Cheapest (cost, audit) by a table over (row, last role); rows are (initial, kind)."""
    n = len(rows)
    rest = [[None] * 4 for _ in range(n + 1)]
    for i in reversed(range(n + 1)):
        for _ in range(4):                                   # inserts within a row of the table
            for q in range(4):
                want = "uuau"[q]
                nxt = {"u": 2, "a": 3}[want]
                options = [(0, "")] if i == n and q in (0, 3) else []
                if rest[i][nxt] is not None:
                    options.append((3 + rest[i][nxt][0], "I" + rest[i][nxt][1]))
                if i < n:
                    role, kind = rows[i]
                    after = rest[i + 1]
                    if after[q] is not None:
                        options.append((4 + after[q][0], "D" + after[q][1]))
                    if kind != 2:
                        more = 3 if kind == 1 else 0
                        to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role))
                        if to is not None and after[to] is not None:
                            options.append((more + after[to][0], "K" + after[to][1]))
                        if after[nxt] is not None:
                            options.append((3 + more + after[nxt][0], "R" + after[nxt][1]))
                rest[i][q] = min([o for o in options] + ([rest[i][q]] if rest[i][q] else []), default=None)
    return rest[0][0]


def all_scripts(rows):
    """Every script with at most two inserts between rows, for very short conversations."""
    found = []
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost, roles, audit, bad = 0, [], "", False
            for k in range(len(rows) + 1):
                audit += "I" * gaps[k]
                roles += ["?"] * gaps[k]
                cost += 3 * gaps[k]
                if k == len(rows):
                    break
                role, kind = rows[k]
                audit += edits[k]
                if edits[k] == "D":
                    cost += 4
                    continue
                bad |= kind == 2
                cost += (3 if kind == 1 else 0) + (3 if edits[k] == "R" else 0)
                roles.append(role if edits[k] == "K" else "?")
            text = "".join(roles)
            if not bad and (not text or any(len(text) == len(p) and all(a in ("?", b) for a, b in zip(text, p)) and not (p[0] == "s" and text[0] == "?")
                                            for p in ("ua" * (len(text) // 2), "s" + "ua" * ((len(text) - 1) // 2)) if len(p) > 1)):
                found.append((cost, audit))
    return min(found)


def codes(rows):
    return bytes(4 * kind + "suax".index(role) for role, kind in rows)


def random_rows(n, weights=(6, 1, 1)):
    return [(R.choice("uuuaaasx"), R.choices((0, 1, 2), weights)[0]) for _ in range(n)]


def test_short_conversations_against_all_scripts():
    for _ in range(250):
        rows = random_rows(R.randrange(0, 4), (3, 1, 1))
        assert d.best_script(codes(rows)) == all_scripts(rows) == plain_best(rows), rows


def test_random_conversations_against_the_table():
    for _ in range(1500):
        rows = random_rows(R.randrange(0, 14), R.choice([(6, 1, 1), (1, 1, 1), (1, 0, 0), (0, 1, 0)]))
        assert d.best_script(codes(rows)) == plain_best(rows), rows


@pytest.mark.parametrize("n", [100, 400, 1500])
@pytest.mark.parametrize("pattern", ["random", "u", "s", "a", "x", "ua", "au", "uua"])
def test_long_conversations_end(n, pattern):
    rows = random_rows(n) if pattern == "random" else [(pattern[i % len(pattern)], R.choices((0, 1, 2), (8, 1, 1))[0]) for i in range(n)]
    assert d.best_script(codes(rows)) == plain_best(rows)


def test_bounds_never_exceed_the_cost():
    for _ in range(300):
        rows = random_rows(R.randrange(0, 9))
        bound = d.rest_bounds(codes(rows), d.ASSISTANT)
        for i in range(len(rows) + 1):
            for entry in range(4):
                assert bound[i] <= d.solve(codes(rows[i:]), entry, d.ASSISTANT)[0]


def plain(convs):
    out = {}
    by: dict = {}
    for conv, turn, role, text in convs:
        rows = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        rows += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, marked = set(), [0, 0, 0], []
        for _, role, text in rows:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            marked.append((role[0] if role[:1] in ("s", "u", "a") else "x", {0: 2, 1: 2, 2: 1, 3: 0}[fault]))
        cost, audit = plain_best(marked)
        lines, i, outputs = [], 0, len(audit) - audit.count("D")
        for e in audit:
            place = len(lines) - outputs % 2
            name = ("user", "assistant")[place % 2]
            if e == "I":
                lines.append(f"{name}:")
            elif e == "R":
                lines.append(f"{name}:{rows[i][2]}")
            elif e == "K":
                lines.append(f"{rows[i][1]}:{rows[i][2]}")
            i += e != "I"
        turns = {r[0] for r in rows if r[0] is not None}
        initials = [m[0] for m in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return sorted(out.values(), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, kind int, idx int, seg string"


def got(spark, rows, **limits):
    df = spark.createDataFrame([(*r, 7, 7, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in d.repair_damaged(df, **limits).collect()), key=str)


def test_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        convs = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
        assert sorted((tuple(r) for r in d.repair_damaged(convs).collect()), key=str) == plain([(r.conv_id, r.turn, r.role, r.text) for r in convs.collect()])


ODD = [(None, 1, "user", "hi."), (None, 2, "assistant", "yes."), (None, None, None, None), (9, None, "user", "a."), (9, 3, "", "b."), (9, 3, "tool", "c!"),
       (9, 3, "tool", "c!"), (9, 4, "system", "late."), (8, 1, "user", "\x85x?\v \r\n"), (8, 2, "assistant", "."), (7, 0, "user", "x" * 100_000 + "."),
       (7, 1, "étude", "ok"), (7, -5, "assistant", "\xa0"), (6, 2**40, "assistant", "z?"), (6, 0, "user", "q!")]


def test_odd_rows_and_clashing_columns(spark):
    assert got(spark, ODD) == plain(ODD)
    assert got(spark, []) == []


def test_segments_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "SEGMENT", 5)
    monkeypatch.setattr(d, "FAN", 2)
    texts = ["one.", "two", "three!", "", " ", "four?", "five"]
    rows = [(None if c == 2 else c, t if t % 11 else None, R.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), R.choice(texts) + str(t // 9) + R.choice([".", "", "?"]))
            for c in range(4) for t in range((3, 60, 47, 100)[c])]
    rows += [(3, 5, "user", "same.")] * 8 + ODD
    assert got(spark, rows, long_rows=20) == plain(rows)
    assert got(spark, rows, long_chars=400) == plain(rows)


def test_sql(spark, tmp_path):
    query, sql = queries.QUERIES["op13_conversation_repair"], queries.SQL["op13_conversation_repair"]
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}"
        assert compare(spark, connect(path), path, query, sql)[0] is None
    df = spark.createDataFrame([(*r, 7, 7, "x") for r in ODD], SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(spark, con, str(tmp_path), query, sql)[0] is None
