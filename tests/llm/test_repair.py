import hashlib
import zlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import repair

STEP = {("start", "s"): "sys", ("start", "u"): "u", ("sys", "u"): "u", ("u", "a"): "pair", ("pair", "u"): "u"}


def plain_align(turns):
    """(cost, least audit) over the grammar's automaton, by whole strings. turns: (initial, must be deleted, truncated)."""
    after = {"start": (0, ""), "pair": (0, "")}
    for i in range(len(turns), -1, -1):
        here = dict(after) if i == len(turns) else {}
        if i < len(turns):
            initial, gone, short = turns[i]
            for phase in ("start", "sys", "u", "pair"):
                ways = []
                if phase in after:
                    ways.append((after[phase][0] + 4, "D" + after[phase][1]))
                for (p, letter), to in STEP.items():
                    if p == phase and to in after and not gone:
                        if letter == initial:
                            ways.append((after[to][0] + 3 * short, "K" + after[to][1]))
                        if letter != "s":
                            ways.append((after[to][0] + 3 + 3 * short, "R" + after[to][1]))
                if ways:
                    here[phase] = min(ways)
        for _ in range(4):
            for (p, letter), to in STEP.items():
                if letter != "s" and to in here:
                    way = (here[to][0] + 3, "I" + here[to][1])
                    here[p] = min(here.get(p, way), way)
        after = here
    return after["start"]


def symbols(turns):
    return "".join("x" if gone else (i.upper() if short else i) for i, gone, short in turns)


TURN = st.tuples(st.sampled_from("suao"), st.sampled_from([False, False, False, True]), st.sampled_from([False, False, True]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(TURN, max_size=12))
def test_least_audits(turns):
    assert repair.align(symbols(turns)) == plain_align(turns)


@settings(max_examples=600, deadline=None)
@given(st.lists(TURN, max_size=14), st.sampled_from([1, 2, 3, 5]))
def test_least_audits_by_segments(turns, size):
    before, repair.SEGMENT = repair.SEGMENT, size
    try:
        assert repair.align(symbols(turns)) == plain_align(turns)
    finally:
        repair.SEGMENT = before


def test_long_conversations_take_time_by_their_length():
    turns = [("suao"[i * 7919 % 13 % 4], i % 11 == 0, i % 5 == 0) for i in range(3000)]
    assert repair.align(symbols(turns)) == plain_align(turns)


def plain_repair(rows):
    """rows: (conv, turn, role, text) of all conversations. What the query returns, by conversation."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        kept, seen = [], set()
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        for _, turn, role, text in mine:
            name = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
            role, text = name(role), name(text)
            if kind == 1:
                text = ""
            elif kind == 2:
                text = text.translate({ord(c): None for c in ".!?"})
            elif kind == 4:
                role = "user"
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        numbers = {t for t, _, _ in kept if t is not None}
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        turns = []
        for _, role, text in kept:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1] if role[:1] in "sua" and role else "o", fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit = plain_align(turns)
        length = len(audit) - audit.count("D")
        roles = iter((["system"] if length % 2 else []) + ["user", "assistant"] * (length // 2))
        left, lines = iter(kept), []
        for letter in audit:
            given = next(roles) if letter != "D" else None
            role, text = next(left)[1:] if letter != "I" else (given, "")
            if letter != "D":
                lines.append(f"{role if letter == 'K' else given}:{text}")
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df, conv):
    return {r[conv]: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = pd.read_parquet(f"{folder}/conversations.parquet")
    expected = plain_repair(list(rows[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)))
    assert result(repair.op12_repair(spark, folder), "conv_id") == expected


SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def test_edges(spark):
    rows = [
        (None, None, None, None, "x"), (None, 3, "user", "Hi.", "x"), (1, 5, "system", "S.", "x"), (1, None, "tool", "T", "x"),
        (2, 1, "user", "long. " * 200_000, "x"), (2, 2, "", "é", "x"), (3, 7, "assistant", "?", "x"), (3, 9, "assistant", "? ", "x"),
        *[(4, k, "user", "same.", "x") for k in range(100)], *[(5, k, "ua"[k % 2] + "x", f"{k}.", "x") for k in range(200)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(repair.repair(repair.damaged(df)), "conv") == plain_repair([r[:4] for r in rows])
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


def test_nothing_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "x")], SCHEMA)
    assert result(repair.repair(repair.damaged(df)), "conv") == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_turns_of_one_number_and_text_keys(spark):
    df = spark.createDataFrame([("k", 1, "user", "b.", 1), ("k", 1, "assistant", "c.", 1), ("k", 1, "user", "b.", 1)], "conv string, turn long, role string, text string, times int")
    got = repair.repair(df).first()
    assert (got.conv, got.duplicate, got.illegal, got.gaps) == ("k", 1, 1, 0)


def test_repaired_turns(spark):
    rows = [(1, 1, "assistant", "A.", 1), (1, 2, "user", "B.", 1), (2, 1, "system", "S.", 1), (2, 2, "user", "U.", 1), (2, 3, "user", "U.", 1)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, times int")
    got = sorted(map(tuple, repair.repaired_turns(df, repair.audits(df)).collect()))
    assert got == [
        (1, 0, "user", ""), (1, 1, "assistant", "A."), (1, 2, "user", "B."), (1, 3, "assistant", ""),
        (2, 0, "system", "S."), (2, 1, "user", "U."), (2, 2, "assistant", ""),
    ]
