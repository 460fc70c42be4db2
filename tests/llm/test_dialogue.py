"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import dialogue
from catalog_engine.llm.queries import QUERIES, damaged

ROOT = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        words = re.findall(WORD, text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    return faults


def plain_repair(rows):
    """(cost, audit, lines) by keeping the least (cost, audit) for each state; states are the accepted prefixes' ends."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    target = moves.get((state, role[0]))
                    if target is not None:
                        one = (cost + 5, audit + "I", [*lines, f"{role}:"])
                        best[target] = min(best.get(target, one), one)
        return best

    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, plain_faults(rows)):
        after = {}
        extra = 5 if fault == "truncated" else 0
        for state, (cost, audit, lines) in inserted(best).items():
            ways = [(state, cost + 2, "D", lines)]
            if fault not in ("blank", "duplicate"):
                ways += [(moves.get((state, role[:1])), cost + extra, "K", [*lines, f"{role}:{text}"])]
                ways += [(moves.get((state, r[0])), cost + 1 + extra, "R", [*lines, f"{r}:{text}"]) for r in ("user", "assistant")]
            for target, new, edit, out in ways:
                if target is not None:
                    after[target] = min(after.get(target, (new, audit + edit, out)), (new, audit + edit, out))
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def expected(conv, rows):
    """The report of one conversation from its rows, which are in order."""
    faults = plain_faults(rows)
    turns = sorted({r[1] for r in rows if r[1] is not None})
    letters = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    cost, audit, lines = plain_repair(rows)
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def all_expected(rows, convs):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    return {c: expected(c, [r for r in rows if r[0] == c]) for c in convs}


def some_rows(random, count):
    rows = []
    for conv in range(count):
        for _ in range(int(random.integers(0, 14))):
            turn = None if random.random() < 0.1 else int(random.integers(-3, 12))
            role = str(random.choice(["user", "assistant", "system", "tool", "", "student"], p=[0.38, 0.35, 0.1, 0.07, 0.05, 0.05]))
            text = str(random.choice(["Yes.", "No!", "cut", " \t", "", "Why?  ", "a. b"]))
            rows += [(conv, turn, role, text)] * int(random.integers(1, 3))
    return rows


@pytest.mark.parametrize("block_rows", [512, 3])
def test_random_conversations(spark, block_rows):
    rows = some_rows(np.random.default_rng(8), 120)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {r[0]: tuple(r) for r in dialogue.repair(frame, block_rows=block_rows).collect()}
    wanted = all_expected(rows, {r[0] for r in rows})
    assert found == wanted
    lines = dialogue.repaired_rows(frame, block_rows=block_rows).orderBy("conv_id", "place").collect()
    for conv, report in wanted.items():
        text = "\n".join(f"{r['role']}:{r['text']}" for r in lines if r["conv_id"] == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == report[-1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_brute_force(spark, sf):
    root = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/conversations.parquet").collect()]
    found = {r[0]: tuple(r) for r in QUERIES["op13_conversation_repair"](spark, root).collect()}
    assert found == all_expected(plain_damage(rows), {r[0] for r in rows})


def test_nulls_empty_tables_and_other_columns(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (4, None, "assistant", "So."), (5, 1, "user", None)]
    rows += [(6, k, "user", "x" * 300_000 + ".") for k in (1, 5)] + [(k, 1, "user", "Go.") for k in range(10, 60)]
    frame = spark.createDataFrame([(*r, "audit", 7) for r in rows], SCHEMA + ", audit string, place int")
    want = all_expected(plain_damage(rows), {r[0] for r in rows})
    rows_found = dialogue.repair(damaged(frame), frame).collect()
    assert {r[0]: tuple(r) for r in rows_found} == want and len(rows_found) == len(want)
    empty = hashlib.sha256(b"").hexdigest()
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", empty) for r in want.values())
    assert dialogue.repair(frame.limit(0)).count() == 0
    assert dialogue.repaired_rows(frame.limit(0)).count() == 0


def test_a_conversation_with_most_rows(spark):
    roles = F.expr("CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'user' END")
    long = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), "id", roles.alias("role"), F.concat("id", F.lit(".")).alias("text")).withColumnRenamed("id", "turn")
    same = spark.range(5_000).select(F.lit(2).cast("long").alias("conv_id"), F.lit(7).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    found = {r["conv_id"]: r for r in dialogue.repair(long.unionByName(same)).collect()}
    assert found[1]["illegal"] == 9_999 and len(found[1]["audit"]) == 30_000
    # two of six rows change: the cost is half a row
    assert found[1]["cost"] == 15_000 == sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in found[1]["audit"])
    part = long.filter("turn < 2000")
    rows = [tuple(r) for r in part.collect()]
    assert {tuple(r) for r in dialogue.repair(part, block_rows=64).collect()} == {expected(1, sorted(rows))}
    assert (found[2]["cost"], found[2]["duplicate"], found[2]["audit"]) == (2 * 5_000, 4_999, "D" * 5_000)


def test_powers_give_what_single_steps_give():
    moves = dialogue.Transitions()
    for symbol in "suaxSUAXd":
        costs = dialogue.FINAL
        for count in range(40):
            assert moves.before(symbol, count, dialogue.FINAL) == costs
            costs = moves.before(symbol, 1, costs)
