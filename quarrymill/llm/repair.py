"""Repair of conversation structure by aligning turns with the alternating grammar (s?(ua)+)?.

Turns are kept, given another role or deleted and empty turns inserted, so that the roles' initials spell a string of the
grammar at least cost. A Wagner-Fischer table aligns the turns with the strings of every feasible length: strings that end
alike are suffixes of one another, so column r of one table is the string of length r. Ukkonen's bands leave out the cells
that no alignment within the incumbent's cost can pass. The audits of the best lengths are traced back and compared.

Conversations of more than SEGMENT turns are aligned segment by segment: for each phase of the grammar before and after a
segment its best alignment, then the best chain of phases. Work and memory grow with the number of turns, not its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Costs of the edits; a truncated turn that isn't deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns aligned in one table.
SEGMENT = 32
#: Where in the grammar a place between turns is: nothing said yet, after s, after u, after a whole pair.
START, SYSTEM, USER, PAIR = range(4)
NEVER = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"


# Turns as symbols: the role's initial (o: another), in capitals if truncated; x has to be deleted.


def wanted(exit_phase: int, r: int) -> str:
    """The r-th last character of the strings that end in USER or PAIR."""
    return "ua"[(r + (exit_phase == USER)) % 2]


def keep_cost(symbol: str, want: str) -> int:
    if symbol == "x":
        return NEVER
    letter = symbol.lower()
    return (letter != want) * REROLE + (symbol != letter) * TRUNCATED


class Table:
    """Costs of aligning the turns from i on with the last r characters of the strings that end in exit_phase.

    last: nothing follows, so that empty turns may be inserted after the last turn; else they stand before the next turn.
    """

    def __init__(self, turns: str, exit_phase: int, last: bool) -> None:
        self.turns, self.exit = turns, exit_phase
        n = len(turns)
        left = [sum(s != "x" for s in turns[i:]) for i in range(n + 1)]
        short = [sum(s.isupper() for s in turns[i:]) for i in range(n + 1)]
        kept = [s for s in turns if s != "x"]
        # The incumbent: all turns that may stay do, with roles as the string ends, and two turns inserted at most. What it
        # costs beyond the deletions and truncations that nothing avoids is all that an alignment may lose.
        slack = REROLE * sum(s.lower() != wanted(exit_phase, r) for r, s in enumerate(reversed(kept), 1)) + 2 * INSERT
        self.low: list[int] = [0] * (n + 1)
        self.costs: list[list[int]] = [[]] * (n + 1)
        for i in range(n, -1, -1):
            gone = slack if slack <= short[i] else short[i] + (slack - short[i]) // DELETE
            low, high = max(0, left[i] - gone), left[i] + slack // INSERT
            row: list[int] = []
            for r in range(low, high + 1):
                if i == n:
                    best = INSERT * r if last or not r else NEVER
                else:
                    best = self.at(i + 1, r) + DELETE
                    if r:
                        best = min(best, self.at(i + 1, r - 1) + keep_cost(turns[i], wanted(exit_phase, r)))
                        if row:
                            best = min(best, row[-1] + INSERT)
                row.append(min(best, NEVER))
            self.low[i], self.costs[i] = low, row

    def at(self, i: int, r: int) -> int:
        k = r - self.low[i]
        return self.costs[i][k] if 0 <= k < len(self.costs[i]) else NEVER

    def lengths(self, i: int, odd: bool, least: int) -> Iterator[int]:
        """Lengths of one parity in the band of the turns from i on."""
        first = max(self.low[i], least)
        return range(first + (first % 2 != odd), self.low[i] + len(self.costs[i]), 2)

    def audit(self, i: int, r: int) -> str:
        """The least audit of least cost, first letter first: D < I < K < R."""
        out = []
        while i < len(self.turns) or r:
            cost = self.at(i, r)
            if i < len(self.turns) and self.at(i + 1, r) + DELETE == cost:
                out.append("D")
                i += 1
            elif r and self.at(i, r - 1) + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[i].lower() == wanted(self.exit, r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def least(found: list[tuple[int, str]]) -> tuple[int, str] | None:
    found = [x for x in found if x[0] < NEVER]
    return min(found) if found else None


def best_of(table: Table, i: int, odd: bool, shortest: int, before: str, cost: int) -> list[tuple[int, str]]:
    """Of all feasible lengths the best cost, with every audit that reaches it."""
    costs = {r: table.at(i, r) for r in table.lengths(i, odd, shortest)}
    low = min(costs.values(), default=NEVER)
    return [(cost + c, before + table.audit(i, r)) for r, c in costs.items() if c == low < NEVER]


@lru_cache(20_000)
def segment(turns: str, entry: int, last: bool) -> tuple[tuple[int, str] | None, ...]:
    """For each phase after the turns: least cost and audit from the phase entry, None where there is no way."""
    n = len(turns)
    out: list[tuple[int, str] | None] = [None] * 4
    nothing = (DELETE * n, "D" * n)
    if entry in (START, SYSTEM):
        out[entry] = nothing
    for exit_phase in (USER, PAIR):
        table = Table(turns, exit_phase, last)
        # The first character that the rest of the string needs is a after USER, else u.
        odd = (exit_phase == PAIR) == (entry == USER)
        shortest = 1 if entry in (START, SYSTEM) else 0
        found = best_of(table, 0, odd, shortest, "", 0)
        if entry == START:
            for i, symbol in enumerate(turns):
                if symbol in "sS":
                    cost = DELETE * i + (symbol == "S") * TRUNCATED
                    found += best_of(table, i + 1, odd, shortest, "D" * i + "K", cost)
        out[exit_phase] = least(found)
    if entry == START:
        systems = [(DELETE * (n - 1) + (s == "S") * TRUNCATED, "D" * i + "K" + "D" * (n - 1 - i)) for i, s in enumerate(turns) if s in "sS"]
        out[SYSTEM] = least(systems)
    return tuple(out)


def align(turns: str) -> tuple[int, str]:
    """Least cost and audit of a conversation, given as symbols."""
    parts = [turns[i : i + SEGMENT] for i in range(0, len(turns), SEGMENT)] or [""]
    rest = {START: 0, PAIR: 0}
    costs = [rest]
    for k in range(len(parts) - 1, -1, -1):
        before = {}
        for phase in range(4) if k else (START,):
            ways = segment(parts[k], phase, k == len(parts) - 1)
            totals = [way[0] + rest[after] for after, way in enumerate(ways) if way and after in rest]
            if totals:
                before[phase] = min(totals)
        costs.append(rest := before)
    costs.reverse()
    phase, audit = START, []
    for k, part in enumerate(parts):
        ways = segment(part, phase, k == len(parts) - 1)
        good = [
            (way[1], after)
            for after, way in enumerate(ways)
            if way and after in costs[k + 1] and way[0] + costs[k + 1][after] == costs[k][phase]
        ]
        # No audit begins another: each has one letter other than I for every turn and, but at the end, ends with one.
        text, phase = min(good)
        audit.append(text)
    return costs[0][START], "".join(audit)


class Edits:
    """Reads an audit along the turns: how each turn leaves, and which empty turns stand before it."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at = audit, 0
        #: Strings of odd length begin with s.
        self.place = -((len(audit) - audit.count("D")) % 2)

    def role(self) -> str:
        self.place += 1
        return ("user", "assistant")[(self.place - 1) % 2]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.role(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            given = self.role()
            yield (role if letter == "K" else given), text


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv, turn, role, text and times (0: dropped, 2: repeated): one damage by the CRC-32 of conv:turn modulo 20.

    0 drops the turn, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes it the user's. Nulls are one space in
    the key, the role and the text; the columns conv and turn keep them.
    """
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    return turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _digest() -> Column:
    """Equal for equal role and text; also the order of turns of one number."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


AUDITS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    turns: conv, turn, role, text, times (how often the turn stands there; 0 names only the conversation). Turns go by
    number, null first, those of one number by role and a hash of the text. No text moves: only initials, faults and hashes.
    """
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ends == "", "b").when(~F.substring(ends, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    narrow = turns.select("conv", "turn", "times", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), _digest().alias("digest"))
    dealt = narrow.repartition("conv")
    seen = F.row_number().over(W.partitionBy("conv", F.when(F.col("times") > 0, F.col("digest"))).orderBy(F.col("turn").asc_nulls_first()))
    dealt = dealt.withColumn("again", seen > 1)
    dealt = dealt.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "initial", "digest", "again")
    kind = turns.schema["conv"].dataType
    names = ["conv", *[f.split()[0] for f in AUDITS.split(", ")]]
    types = [pa.int64()] * 6 + [pa.string()]

    def align_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        out: list[list] = [[] for _ in names]
        conv_type = None

        def finish() -> None:
            conv, low, high, distinct, blank, duplicate, truncated, illegal, symbols = held[:9]
            cost, audit = align("".join(symbols))
            gaps = high - low + 1 - distinct if distinct else 0
            for column, value in zip(out, (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), strict=True):
                column.append(value)

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(out[0], conv_type), *[pa.array(c, t) for c, t in zip(out[1:], types, strict=True)]]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            conv_type = b.schema.field("conv").type
            for conv, turn, times, initial, fault, again in zip(
                *[b.column(c).to_pylist() for c in ("conv", "turn", "times", "initial", "fault", "again")], strict=True
            ):
                if held is None or conv != held[0]:
                    if held is not None:
                        finish()
                    held = [conv, None, None, 0, 0, 0, 0, 0, [], None]
                for k in range(times):
                    if turn is not None and turn != held[2]:
                        held[1] = turn if held[1] is None else held[1]
                        held[2] = turn
                        held[3] += 1
                    if held[9] is not None and held[9] + initial not in ("su", "ua", "au"):
                        held[7] += 1
                    held[9] = initial
                    letter = initial if initial and initial in "sua" else "o"
                    if fault == "b":
                        held[4] += 1
                        letter = "x"
                    elif again or k:
                        held[5] += 1
                        letter = "x"
                    elif fault == "t":
                        held[6] += 1
                        letter = letter.upper()
                    held[8].append(letter)
            if len(out[0]) >= 1000:
                yield batch()
        if held is not None:
            finish()
            yield batch()

    return dealt.select("conv", "turn", "times", "initial", "fault", "again").mapInArrow(align_all, f"conv {kind.simpleString()}, {AUDITS}")


def _along(turns: DataFrame, found: DataFrame, schema: str, each) -> DataFrame:
    """Reads every conversation's audit and then its turns in order, one at a time: each(conv, edits, turns) yields rows."""
    head = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("times"), F.lit("").alias("digest"))
    body = turns.select("conv", F.lit(1).alias("kind"), "turn", F.lit(None).cast("string").alias("audit"), "role", "text", "times", _digest().alias("digest"))
    order = [F.col("conv").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), F.substring("role", 1, 1), "digest"]
    dealt = head.unionByName(body).repartition("conv").sortWithinPartitions(*order)
    kind = turns.schema["conv"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            out: list[tuple] = []
            columns = [b.column(c).to_pylist() for c in ("conv", "kind", "audit", "role", "text", "times")]
            for conv, part, audit, role, text, times in zip(*columns, strict=True):
                if not part:
                    if state is not None:
                        out += state.end()
                    state = each(conv, Edits(audit))
                else:
                    for _ in range(times):
                        out += state.turns(state.edits.turn(role, text))
            names = ["conv", *[f.split()[0] for f in schema.split(", ")]]
            yield _rows(b.schema.field("conv").type, names, out)
        if state is not None:
            yield _rows(b.schema.field("conv").type, names, state.end())

    return dealt.select("conv", "kind", "audit", "role", "text", "times").mapInArrow(read, f"conv {kind}, {schema}")


def _rows(conv_type: pa.DataType, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = {"place": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], conv_type), *[pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names[1:], columns[1:], strict=True)]], names=names
    )


class _Hash:
    def __init__(self, conv, edits: Edits) -> None:
        self.conv, self.edits, self.hash, self.first = conv, edits, hashlib.sha256(), True

    def turns(self, turns: Iterator[tuple[str, str]]) -> list[tuple]:
        for role, text in turns:
            self.hash.update(("" if self.first else "\n").encode())
            self.hash.update(f"{role}:{text}".encode())
            self.first = False
        return []

    def end(self) -> list[tuple]:
        self.turns(self.edits.inserted())
        return [(self.conv, self.hash.hexdigest())]


class _Turns:
    def __init__(self, conv, edits: Edits) -> None:
        self.conv, self.edits, self.place = conv, edits, -1

    def turns(self, turns: Iterator[tuple[str, str]]) -> list[tuple]:
        out = []
        for role, text in turns:
            self.place += 1
            out.append((self.conv, self.place, role, text))
        return out

    def end(self) -> list[tuple]:
        return self.turns(self.edits.inserted())


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, one row per turn: conv, place (from 0), role, text."""
    return _along(turns, found, "place long, role string, text string", _Turns)


def repaired_hashes(turns: DataFrame, found: DataFrame) -> DataFrame:
    """SHA-256 of every repaired conversation's role:text, joined by newlines: conv, repaired_sha256."""
    return _along(turns, found, "repaired_sha256 string", _Hash)


def repair(turns: DataFrame) -> DataFrame:
    """audits() and repaired_sha256, one row for each conversation that the turns name.

    A conversation of which no turn is left (all have times 0) has zeros, an empty audit and the empty text's hash. A null
    conversation number is a conversation like any other; null turn numbers come first and count for no gap; null roles and
    texts are one space. Roles of other initials than s, u, a are given another role or deleted. Equal turns are duplicates of the first. Other columns are left out. An empty table gives no rows. Each
    conversation is read in order by one task, which holds one symbol for each of its turns and one turn's text at a time.
    """
    blank = F.lit(" ")
    turns = turns.withColumns({"role": F.coalesce("role", blank), "text": F.coalesce("text", blank), "times": F.coalesce("times", F.lit(1))})
    found = common.materialise(audits(turns))
    hashes = repaired_hashes(turns, found)
    return found.join(hashes, found["conv"].eqNullSafe(hashes["conv"])).drop(hashes["conv"])


def op12_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(common.table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")
