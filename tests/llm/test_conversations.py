import hashlib
import random
import zlib
from functools import cache

import duckdb
import pandas as pd
import pytest

from tidemark.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def every_repair(rows):
    """(cost, audit, lines) by trying all edits; rows of (role, text, dead, short)."""
    nothing = (10**9, "", ())

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else [nothing]
        add = lambda k, letter, line, rest: found.append((k + rest[0], letter + rest[1], line + rest[2]))
        role = "assistant" if state == "u" else "user"
        if inserts < 4:
            add(3, "I", (f"{role}:",), best(i, role[0], inserts + 1))
        if i < len(rows):
            given, text, dead, short = rows[i]
            add(4, "D", (), best(i + 1, state, 0))
            if not dead:
                if given[:1] in ("s", "u") and state == "" or given[:1] == role[0]:
                    add(3 * short, "K", (f"{given}:{text}",), best(i + 1, given[:1], 0))
                add(3 + 3 * short, "R", (f"{role}:{text}",), best(i + 1, role[0], 0))
        return min(found)

    return best(0, "", 0)


def plain_report(rows):
    """By conversation: the report's columns in plain Python."""
    groups = {}
    for k, turn, role, text in rows:
        groups.setdefault(k, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for k, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, turns, marked, counts = set(), [t for t, _, _ in g if t is not None], [], [0, 0, 0]
        for _, role, text in g:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(g, g[1:], strict=False))
        cost, audit, lines = every_repair(tuple(marked))
        out[k] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def rows_of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def some(n, seed):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["a.", "b!", "c", " \t", "", None, "d? \r\n", "é", "x.\x0b", "a.\xa0"]
    return [(r.choice([1, 2, 3, 4, None]) if k % 3 else 9, r.choice([None, 0, 1, 2, 5, -3]), r.choice(roles), r.choice(texts)) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_audits_are_the_least_of_all(seed):
    r = random.Random(seed)
    role = {c.S: "s", c.USER: "u", c.ASSISTANT: "a", c.OTHER: "x"}
    for _ in range(400):
        code = [r.choice(list(role)) + r.choice([0, 0, c.DEAD, c.SHORT]) for _ in range(r.randint(0, 12))]
        cost, audit, _ = every_repair(tuple((role[k & 3], "", bool(k & c.DEAD), bool(k & c.SHORT)) for k in code))
        assert c.audit(bytes(code)) == (cost, audit)


def test_a_long_conversation_is_linear():
    cost, audit = c.audit(bytes([c.USER, c.USER, c.ASSISTANT]) * 100_000)
    assert cost == 3 * 100_000 and len(audit) >= 300_000
    assert c.audit(bytes([c.OTHER + c.DEAD]) * 50_000) == (200_000, "D" * 50_000)
    assert c.audit(b"") == (0, "")


@pytest.mark.parametrize("seed", [1, 2])
def test_report_and_repair_like_plain_python(spark, seed):
    rows = some(60, seed)
    df = table(spark, rows)
    got = rows_of(c.report(df))
    assert got == plain_report(rows)
    turns = c.repair(df).orderBy("conv_id", "place").collect()
    for k, found in got.items():
        mine = [t for t in turns if t.conv_id == k]
        assert [t.place for t in mine] == list(range(len(mine)))
        assert "".join(t.edit for t in mine) == found[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == found[7]
        assert all((t.turn is None and t.text == "") for t in mine if t.edit == "I")


def test_conversations_cross_batches(spark):
    rows = [(k % 3, k, ("user", "assistant", "system")[k * k % 3], f"text {k % 40}." if k % 7 else "open") for k in range(300)]
    rows = [r for r in rows if r[0] != 2] + [(2, None, None, None)] * 3
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = rows_of(c.report(table(spark, rows)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_report(rows)
    assert got[2][:7] == (0, 3, 0, 0, 2, 12, "DDD")


def damaged(rows):
    out = []
    for k, turn, role, text in rows:
        text = " " if text is None else text
        fate = zlib.crc32(f"{' ' if k is None else k}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(fate, text)
        out += [(k, turn, "user" if fate == 4 else role, text)] * (fate > 0) * (2 if fate == 3 else 1)
    return out


def test_damage_and_conversations_without_rows(spark):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", f"words {t}.") for k in range(200) for t in range(1 + k % 3)] + some(30, 5)
    got, want = rows_of(c.damaged_report(table(spark, rows))), plain_report(damaged(rows))
    gone = {r[0] for r in rows} - set(want)
    assert gone and got == want | {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone}


def test_sql_says_the_same(spark):
    rows = [(k, t, ("user", "assistant", "system", None)[(k * t + t) % 4], f"{'words' * (t % 3)}{'.' * (k % 2)}") for k in range(60) for t in range(k % 7)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = duckdb.sql(c.ORACLE).fetchall()
    assert rows_of(c.damaged_report(table(spark, rows))) == {r[0]: tuple(r[1:]) for r in want}


def test_empty_and_very_long(spark):
    assert c.report(table(spark, []).limit(0)).count() == 0 and c.repair(table(spark, []).limit(0)).count() == 0
    long = "word " * 400_000
    got = rows_of(c.report(table(spark, [(1, 0, "user", long), (1, 1, "assistant", long + ".")])))
    assert got[1][:7] == (0, 0, 0, 1, 0, 3, "KK")
