"""Operator 13 against a search over all edits, on awkward rows and on conversations longer than a block."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import repair

EMPTY = hashlib.sha256().hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def best(rows):
    """The least (cost, audit, texts) by recursion over all edits; three inserts in a row are never of use."""

    @functools.cache
    def least(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in "0a" else []

        def add(cost, letter, made, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], (made, *rest[2]) if made else rest[2]))

        follows = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}
        if inserts < 3:
            for x in follows.replace("s", ""):
                add(3, "I", f"{name[x]}:", least(i, x, inserts + 1))
        if i < len(rows):
            role, text, fault = rows[i]
            add(4, "D", None, least(i + 1, state, 0))
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                if role[:1] and role[0] in follows:
                    add(more, "K", f"{role}:{text}", least(i + 1, role[0], 0))
                for x in follows.replace("s", ""):
                    add(3 + more, "R", f"{name[x]}:{text}", least(i + 1, x, 0))
        return min(found) if found else None

    return least(0, "0", 0)


def expected(given):
    """conv_id -> the report, from all rows in memory."""
    out = {}
    for conv in {r[0] for r in given}:
        rows = []
        for _, turn, role, text in (r for r in given if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            marked.append((role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [m[2] for m in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, texts = best(tuple(marked))
        out[conv] = (conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Fine.", "what now", "Really?", "", None, " \n", "Yes! ", f"Row {turn}.", f"cut {turn}", "Fine."])
            rows += [(conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def test_search_finds_the_least_audit_of_the_least_cost():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), str(i), rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(0, 7))]
        cost, audit, end = repair.cheapest([(r[0][:1], r[2]) for r in rows])
        want = best(tuple(rows))
        assert (cost, audit) == want[:2] and end in (0, 3)
        kept = [(role, None if i is None else rows[i]) for letter, role, i in repair.edits([(r[0][:1], r[2]) for r in rows], audit) if letter != "D"]
        assert tuple(f"{role or row[0]}:{row[1] if row else ''}" for role, row in kept) == want[2]


def test_report_and_blocks(spark, monkeypatch):
    given = some_rows(1, [*range(60), None, -3], 9)
    df = spark.createDataFrame(given, SCHEMA).withColumns({"key": F.lit("x"), "block": F.lit(1), "h": F.lit(None)}).repartition(5)
    want = sorted(expected(given).values(), key=str)
    assert sorted(map(tuple, repair.repair(repair.damaged(df), df).collect()), key=str) == want
    monkeypatch.setattr(repair, "_BITS", 1)  # blocks of two rows: the same result from many small searches
    assert sorted(map(tuple, repair.repair(repair.damaged(df), df).collect()), key=str) == want


def test_one_conversation_longer_than_a_block(spark):
    given = some_rows(2, [7], 2)[:1] + [(7, t, "assistant" if t % 3 else "user", f"Turn {t}." if t % 7 else "again") for t in range(2500)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi!")]
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = {r.conv_id: r for r in repair.repair(df, df).collect()}
    rows = [(r[2] or " ", r[3] or " ") for r in sorted((r for r in given if r[0] == 7), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.md5((r[3] or " ").encode()).hexdigest()))]
    seen, marked = set(), []
    for role, text in rows:
        marked.append((role[0], 1 if not text.strip() else 2 if (role, text) in seen else 3 if text.strip()[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, audit, _ = repair.cheapest(marked)  # the whole conversation as one search
    assert (found[7].cost, found[7].audit) == (cost, audit) and len(audit) >= 2500 and found[8].audit == "KK"


def test_many_equal_rows_and_nothing(spark):
    hot = spark.range(200_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    row = repair.repair(hot, hot).first()
    assert (row.duplicate, row.cost, row.gaps, row.illegal) == (199_999, 4 * 199_999 + 3, 0, 199_999) and sorted(set(row.audit)) == ["D", "I", "K"]
    assert repair.repair(hot.limit(0), hot).first() == (1, 0, 0, 0, 0, 0, 0, "", EMPTY) and repair.repair(hot.limit(0), hot.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3])
def test_sql_gives_the_same(seed):
    given = some_rows(seed, [*range(40), None], 7)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", given)
    assert sorted(db.execute(repair.SQL).fetchall(), key=str) == sorted(expected(given).values(), key=str)
