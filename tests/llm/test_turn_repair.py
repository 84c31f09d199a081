import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from routelens.llm import turn_repair as t

SCHEMA = "conv_id long, turn long, role string, text string, letters string, place long, step int"
WHITE = " \t\n\v\f\r"


def fault_of(rows, i):
    role, text = rows[i]
    if not text.strip(WHITE):
        return "b"
    if (role, text) in rows[:i]:
        return "d"
    return "" if text.rstrip(WHITE)[-1] in ".!?" else "t"


def cheapest(rows):
    """All repairs with as many inserts as can help, one by one."""
    faults = [fault_of(rows, i) for i in range(len(rows))]
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("b", "d") for e, f in zip(edits, faults, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""], strict=True))
            cost = sum({"D": 2, "K": 0, "R": 1, "I": 5}[e] for e in audit) + 5 * sum(e != "D" and f == "t" for e, f in zip(edits, faults, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            free = audit.count("I") + audit.count("R")
            for names in itertools.product(("user", "assistant"), repeat=free):
                given, left, lines = iter(names), iter(rows), []
                for e in audit:
                    role, text = (next(given), "") if e == "I" else next(left)
                    if e != "D":
                        lines.append((next(given) if e == "R" else role, text))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) and all(r for r, _ in lines):
                    best = (cost, audit, "\n".join(f"{r}:{x}" for r, x in lines))
                    break
    return best


def brute(rows, solve):
    out = []
    for conv in {r[0] for r in rows}:
        harmed = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            harmed += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        harmed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        said = [r[1:] for r in harmed]
        faults = [fault_of(said, i) for i in range(len(said))]
        turns = [r[0] for r in harmed if r[0] is not None]
        cost, audit, repaired = solve(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(out, key=str)


def told(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in t.repair(t.damaged(df), df).collect()), key=str)


TEXTS = ["Yes.", "No", "Why?", "", " \t", "\xa0", "A long one.\n", None, "Yes."]


def test_equals_all_repairs_tried(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        rows += [(conv, rng.choice((None, k, k, k, k + 2, 1)), rng.choice(("user", "assistant", "system", "tool", None, "", "user")), rng.choice(TEXTS)) for k in range(rng.randint(1, 4))]
    assert told(spark, rows) == brute(rows, cheapest)


def test_a_conversation_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(t, "LETTERS", 7)
    rng = random.Random(6)
    rows = [(1, k // 2, rng.choice(("user", "assistant")), rng.choice(TEXTS)) for k in range(400)] + [(2, 0, "user", "a."), (2, 0, "user", "a.")]

    def solve(said):
        kinds = {"b": t.BLANK, "d": t.COPY, "t": t.CUT, "": t.SOUND}
        cost, audit = t.solve(bytes((t.KINDS + "?").index(r[:1] if r[:1] in t.KINDS else "?") * 4 + kinds[fault_of(said, i)] for i, (r, _) in enumerate(said)))
        return cost, audit, "\n".join(f"{r}:{x}" for r, x in t.repaired_lines(audit, iter(said)))

    assert told(spark, rows) == brute(rows, solve)


@pytest.mark.parametrize("turns", [b"", b"\x04", b"\x08", b"\x00", b"\x00\x08", b"\x04\x04", b"\x0e\x0c\x05"])
def test_repairs_are_legal(turns):
    rows = [({0: "system", 1: "user", 2: "assistant", 3: "tool"}[x // 4], "x") for x in turns]
    _, audit = t.solve(turns)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in t.repaired_lines(audit, iter(rows))))


def test_no_rows(spark):
    assert told(spark, []) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    assert sorted(tuple(r) for r in t.query(spark, "/root/testdata/sf0.001").collect()) == sorted(con.execute(t.ORACLE).fetchall())
