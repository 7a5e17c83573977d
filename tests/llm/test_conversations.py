"""Repaired conversations against a plain recursion over the edits, row by row."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations

SPACES = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """(cost, audit, lines) of rows (role, text, must go, truncated), by trying every edit."""
    allowed = re.compile(r"(s?(ua)+)?")
    begins = {w[:k] for w in ("", *(s + "ua" * n for s in ("", "s") for n in range(1, 4))) for k in range(len(w) + 1)}

    def state(made):  # what is made so far, shortened by whole pairs
        return made if len(made) < 4 else made[: 1 if made[0] == "s" else 0] + made[-2 - (len(made) - (made[0] == "s")) % 2 :]

    @lru_cache(maxsize=None)
    def rest(i, made, inserted):
        made = state(made)
        if made not in begins:
            return None
        options = [(0, "")] if i == len(rows) and allowed.fullmatch(made) else []

        def go(cost, letter, i, made, inserted):
            after = rest(i, made, inserted)
            if after:
                options.append((cost + after[0], letter + after[1]))

        if inserted < 3:
            for r in "ua":
                go(3, "I", i, made + r, inserted + 1)
        if i < len(rows):
            role, _, must_go, truncated = rows[i]
            go(4, "D", i + 1, made, 0)
            if not must_go:
                for r in "ua":
                    go(3 + 3 * truncated, "R", i + 1, made + r, 0)
                if role[:1] in ("s", "u", "a"):
                    go(3 * truncated, "K", i + 1, made + role[0], 0)
        return min(options, default=None)

    cost, audit = rest(0, "", 0)
    made, lines, i = "", [], 0
    for e in audit:
        turn = {"u": "user", "a": "assistant"}["a" if made[-1:] == "u" else "u"]
        if e == "I":
            lines.append(turn + ":")
            made += turn[0]
        else:
            role, text = rows[i][:2]
            i += 1
            if e != "D":
                role = turn if e == "R" else role
                lines.append(f"{role}:{text}")
                made += role[0]
    assert allowed.fullmatch(made)
    return cost, audit, lines


def brute(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        kept = convs[conv]
        one = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults, rows = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, d, role, text in kept:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if d in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add(d)
            if fault:
                faults[fault] += 1
            rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit, lines = plain_repair(tuple(rows))
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(rows, table, **kw):
    got = [tuple(r) for r in conversations.repaired(rows, **kw).collect()]
    assert len({r[0] for r in got}) == len(got)
    assert {r[0]: r[1:] for r in got} == brute(table)


def test_given_conversations(spark, data):
    rows = spark.read.parquet(f"{data.replace('0.001', '0.01')}/conversations.parquet")
    check(rows, [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("block", [512, 3])
def test_random_conversations_and_blocks(spark, block):
    rng = random.Random(block)
    table = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 26)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            text = rng.choice([f"Text {rng.randrange(30)}.", f"cut {rng.randrange(99)}", "", " \t", None, "same!", "ends? \x0b", "ends \x1c", "é", "??"])
            table.append((conv or None, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    table += rng.choices(table, k=200)
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "copies", "kind", "times", "digest", "again", "audit", "seq")})
    check(rows.repartition(7), table, block=block)


def test_awkward_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    table = [(9, -(1 << 62), "user", "a."), (9, 1 << 62, "assistant", "b."), (10, 0, "user", "x " * 100_000 + "."), (11, None, None, None), (None, None, None, None)]
    table += [(12, k % 3, "user", "the same.") for k in range(2000)] + [(13, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(900)]
    got = {r[0]: tuple(r)[1:] for r in conversations.repaired(spark.createDataFrame(table, schema).repartition(5)).collect()}
    want = brute([t for t in table if t[0] not in (12, 13)])
    assert {k: v for k, v in got.items() if k not in (12, 13)} == want
    assert got[12][2] == sum(0 if (k := zlib.crc32(f"12:{t % 3}".encode()) % 20) == 0 else 2 if k == 3 else 1 for t in range(2000)) - 1 and got[12][6].count("D") >= 1500
    assert len(got[13][6]) >= 800 and got[13][5] > 0
    assert conversations.repaired(spark.createDataFrame([], schema)).count() == 0


def test_both_heaps_find_what_one_finds():
    rng = random.Random(1)
    for _ in range(400):
        pattern = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(9)))
        rows = tuple(({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "t", c == "x", c.isupper()) for c in pattern)
        assert conversations.solve(pattern) == plain_repair(rows)[:2]


def test_parts_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        left, right = ("".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(6))) for _ in range(2))
        ways = []
        for q in range(4):
            a, b = conversations.solve(left, 0, (q,)), conversations.solve(right, q)
            if a and b:
                ways.append((a[0] + b[0], a[1] + b[1]))
        assert min(ways) == conversations.solve(left + right)
