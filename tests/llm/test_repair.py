"""Conversation repair against exhaustive and state-by-state searches, and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from surfparc.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def exhaustive(initials, faults, most=16):
    """Tries every string of edits in order of cost, then ASCII."""
    best = []

    def go(i, edits, roles, cost):
        if cost > most:
            return
        if i == len(initials) and GRAMMAR.fullmatch(roles):
            best.append((cost, edits, roles))
        for r in "ua":
            go(i, edits + "I", roles + r, cost + 3)
        if i < len(initials):
            stay = 3 if faults[i] == "t" else 0
            go(i + 1, edits + "D", roles, cost + 4)
            if faults[i] not in "bd":
                go(i + 1, edits + "K", roles + initials[i], cost + stay)
                for r in "ua":
                    go(i + 1, edits + "R", roles + r, cost + stay + 3)

    go(0, "", "", 0)
    return min(best)


def by_state(initials, faults):
    """Cheapest, then ASCII-least, edits into each state of the grammar, row by row."""
    states = {"": (0, "", "")}

    def put(into, state, entry):
        if state not in into or entry < into[state]:
            into[state] = entry

    allowed = lambda state, c: (state, c) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    def inserts(states):
        for _ in range(2):
            for state, (cost, edits, roles) in list(states.items()):
                for c in "ua":
                    if allowed(state, c):
                        put(states, c, (cost + 3, edits + "I", roles + c))

    for c, f in zip(initials, faults, strict=True):
        inserts(states)
        after = {}
        for state, (cost, edits, roles) in states.items():
            put(after, state, (cost + 4, edits + "D", roles))
            if f not in "bd":
                stay = cost + (3 if f == "t" else 0)
                if allowed(state, c):
                    put(after, c, (stay, edits + "K", roles + c))
                for r in "ua":
                    if allowed(state, r):
                        put(after, r, (stay + 3, edits + "R", roles + r))
        states = after
    inserts(states)
    return min(v for k, v in states.items() if k in ("", "a"))


def test_small_conversations_equal_exhaustive_search():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(0, 5)
        initials, faults = "".join(rng.choices("suax", [2, 4, 4, 1], k=n)), "".join(rng.choices("-tbd", [5, 3, 1, 1], k=n))
        assert repair.cheapest(initials, faults) == exhaustive(initials, faults), (initials, faults)


def test_longer_conversations_equal_the_search_by_state():
    rng = random.Random(2)
    for k in range(400):
        n = rng.randrange(0, 60) if k % 10 else 300
        mess = rng.random()
        initials = "".join(rng.choice("suax") if rng.random() < mess else "ua"[i % 2] for i in range(n))
        faults = "".join(rng.choices("-tbd", [6, 3 * mess, mess, mess], k=n))
        want = by_state(initials, faults)
        assert repair.Alignment(initials, faults).audit() == want, (initials, faults)
        # The same with few rows of the table kept.
        assert repair.Alignment(initials, faults, cells=1).audit() == want


def test_long_conversation_is_quick():
    rng = random.Random(3)
    n = 6000
    initials = "".join("ua"[i % 2] if rng.random() > 0.1 else "u" for i in range(n))
    faults = "".join(rng.choices("-tbd", [17, 1, 1, 1], k=n))
    assert repair.Alignment(initials, faults).audit() == by_state(initials, faults)


def python_rows(turns):
    """The contract read row by row: reports and repaired texts by conversation."""
    found = {}
    for conv, turn, role, text in turns:
        rows = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        rows += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = []
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        initials, faults, seen = "", "", set()
        for _, role, text in rows:
            last = text.rstrip(" \t\n\x0b\f\r")[-1:]
            faults += "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "-"
            initials += role[:1] if role[:1] in tuple("sua") else "x"
            seen.add((role, text))
        cost, audit, roles = by_state(initials, faults)
        kept, i, k = [], 0, 0
        for e in audit:
            if e == "I":
                kept.append(({"u": "user", "a": "assistant"}[roles[k]]) + ":")
            elif e == "K":
                kept.append(f"{rows[i][1]}:{rows[i][2]}")
            elif e == "R":
                kept.append({"u": "user", "a": "assistant"}[roles[k]] + f":{rows[i][2]}")
            k += e != "D"
            i += e != "I"
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(initials[j : j + 2] not in ("su", "ua", "au") for j in range(len(initials) - 1))
        out.append((conv, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(7)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", None, "Ünï côdé.", "日本", "so it is. ", "x" * 50_000 + "."]
    out = []
    for conv in [*range(60), None]:
        for t in range(rng.randrange(0, 12)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            out.append((conv, rng.choice([t, t, t, t + 3, None]), rng.choice([role] * 12 + ["system", None, "", "tool", "Über"]), rng.choice(texts)))
    out += [(1000, t, "system" if t == 0 else ("assistant", "user")[t % 2], f"Line {t}.") for t in range(500)]
    out += [(1001 + k, 0, "user", "Alone.") for k in range(30)]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, conv long, place int, digest string, fault int, audit int, sha int"


def test_query_equals_python_and_sql(spark, turns, tmp_path):
    df = spark.createDataFrame([(*t, 1, 2, "d", 3, 4, 5) for t in turns], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == python_rows(turns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(repair.ORACLE).fetchall(), key=str) == rows


def test_repaired_turns(spark):
    rows = [("c", 1, "user", "Hi."), ("c", 2, "user", "Are you there?"), ("c", 3, "assistant", "Yes."), ("c", 4, "assistant", "Yes."), ("d", 1, "tool", "42"), ("e", 1, "user", " ")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "chat string, n int, who string, said string, place int")
    names = {"key": "chat", "turn": "n", "role": "who", "text": "said"}
    reports = repair.audits(df, **names)
    assert {r.chat: (r.cost, r.audit, r.roles) for r in reports.collect()} == {"c": (7, "KIKKD", "uaua"), "d": (4, "D", ""), "e": (4, "D", "")}
    got = [tuple(r) for r in repair.repair(df, reports, **names).collect()]
    assert got == [("c", 0, "user", "Hi.", "K"), ("c", 1, "assistant", "", "I"), ("c", 2, "user", "Are you there?", "K"), ("c", 3, "assistant", "Yes.", "K")]
    assert repair.audits(df.limit(0), **names).collect() == [] and repair.repair(df.limit(0), reports.limit(0), **names).collect() == []
