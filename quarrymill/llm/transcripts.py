"""Transcript parsing: a hidden Markov model over lines recovers who speaks, then turns are rendered in one form.

States are a role and whether a line begins a turn or goes on with it. A line is observed by its speaker marker (if any) and
by its form. Viterbi is a product of max-plus matrices, and so associative: a transcript of any length is cut into segments,
each segment's matrix is computed by itself, the few matrices of a transcript give the states at the cuts, and each segment
is then decoded between its two known states. Neither a long transcript nor a long turn is whole in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
#: Names that speakers go by, and the role of each.
NAMES = {
    "system": "system", "sys": "system", "instructions": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant",
}
MARKER = rf"(?i)^\s*(?:#{{1,4}}\s*|<\||\[|\*\*)?({'|'.join(sorted(NAMES, key=len, reverse=True))})\s*(?:\|>|\]|\*\*)?\s*(?::|>|\|>|$)\s*"
#: Lines in a segment, and bytes, at most (one longer line is a segment of its own).
SEGMENT, SEGMENT_BYTES = 65_536, 1 << 24
#: Line forms: 3 lengths x ends as a question x begins in upper case.
FORMS = 12
STATES = [(r, begins) for r in range(len(ROLES)) for begins in (True, False)]


def observed(line: Column) -> dict[str, Column]:
    """marker: 0 none, else 1 + role; form: 0 to 11; said: the line without its marker."""
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    marker = F.lit(0)
    for known, role in NAMES.items():
        marker = F.when(name == known, 1 + ROLES.index(role)).otherwise(marker)
    said = F.when(name != "", F.regexp_replace(line, MARKER, "")).otherwise(line)
    size = F.when(F.length(said) < 40, 0).when(F.length(said) < 160, 1).otherwise(2)
    form = size * 4 + said.rlike(r"\?\s*$").cast("int") * 2 + said.rlike(r"^\s*\p{Lu}").cast("int")
    return {"marker": marker.cast("int"), "form": form.cast("int"), "said": said}


@dataclass(frozen=True)
class Model:
    """Log probabilities: first state, state to state, state to marker, state to form."""

    first: np.ndarray
    step: np.ndarray
    marker: np.ndarray
    form: np.ndarray

    def emission(self, marker: np.ndarray, form: np.ndarray) -> np.ndarray:
        return self.marker[:, marker].T + self.form[:, form].T


def train(turns: DataFrame) -> Model:
    """Count a model on turns whose roles are known: columns conv_id, turn, role, lines (array, markers included).

    The counts are tables of a few rows; add-one smoothing. Successors are found by a join on the next turn's number.
    """
    known = turns.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "lines")
    lines = known.select("role", F.posexplode("lines").alias("at", "line"))
    sign = observed(F.col("line"))
    seen = lines.groupBy("role", (F.col("at") == 0).alias("begins"), sign["marker"].alias("marker"), sign["form"].alias("form"))
    marker = np.ones((len(STATES), 1 + len(ROLES)))
    form = np.ones((len(STATES), FORMS))
    lines_of = np.ones((len(ROLES), 2))
    for r in seen.count().collect():
        k = STATES.index((ROLES.index(r.role), r.begins))
        marker[k, r.marker] += r["count"]
        form[k, r.form] += r["count"]
        lines_of[k // 2, k % 2] += r["count"]
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    turn_step = np.ones((len(ROLES), len(ROLES)))
    for r in known.drop("lines").join(after, ["conv_id", "turn"]).groupBy("role", "next").count().collect():
        turn_step[ROLES.index(r.role), ROLES.index(r.next)] += r["count"]
    starts = np.ones(len(ROLES))
    opening = known.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count()
    for r in opening.collect():
        starts[ROLES.index(r.role)] += r["count"]
    first = np.full(len(STATES), -math.inf)
    step = np.full((len(STATES), len(STATES)), -math.inf)
    for k, (role, begins) in enumerate(STATES):
        if begins:
            first[k] = math.log(starts[role] / starts.sum())
        stay = lines_of[role, 1] / lines_of[role].sum()
        step[k, STATES.index((role, False))] = math.log(stay)
        for to in range(len(ROLES)):
            step[k, STATES.index((to, True))] = math.log((1 - stay) * turn_step[role, to] / turn_step[role].sum())
    log = lambda x: np.log(x / x.sum(axis=1, keepdims=True))
    return Model(first, step, log(marker), log(form))


def transfer(model: Model, emission: np.ndarray, opens: bool) -> np.ndarray:
    """Best score from each state before a segment to each state at its end; opens: it is a transcript's first."""
    if opens:
        best = np.tile(model.first + emission[0], (len(STATES), 1))
        emission = emission[1:]
    else:
        best = np.where(np.eye(len(STATES), dtype=bool), 0.0, -math.inf)
    for e in emission:
        best = (best[:, :, None] + model.step[None]).max(axis=1) + e
    return best


def decode(model: Model, emission: np.ndarray, entry: int, exit_: int) -> list[int]:
    """States of a segment's lines, between the state before it (-1: it is the first) and its last state (-1: free)."""
    n = len(emission)
    back = np.zeros((n, len(STATES)), dtype=np.int64)
    best = model.first + emission[0] if entry < 0 else model.step[entry] + emission[0]
    for k in range(1, n):
        paths = best[:, None] + model.step
        back[k] = paths.argmax(axis=0)
        best = paths.max(axis=0) + emission[k]
    state = int(best.argmax()) if exit_ < 0 else exit_
    states = [state]
    for k in range(n - 1, 0, -1):
        state = int(back[k, state])
        states.append(state)
    return states[::-1]


def segmented(lines: DataFrame, order: list[str]) -> DataFrame:
    """Lines with seg (rising along a transcript) and place (in the segment): a new one with each transcript and range."""
    names = ["conv_id", *order]
    ready = lines.repartitionByRange(*names).sortWithinPartitions(*names)
    schema = "conv_id long, seg long, place long, marker int, form int, said string"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        seg, place, held, last = 0, -1, 0, object()
        for batch in batches:
            ids = batch["conv_id"].to_pylist()
            segs, places = [], []
            for c, size in zip(ids, pc.binary_length(batch["said"]).to_pylist(), strict=True):
                place, held = place + 1, held + size
                if c != last or place >= SEGMENT or held > SEGMENT_BYTES:
                    seg, place, held, last = seg + 1, 0, size, c
                segs.append(task + seg)
                places.append(place)
            columns = [batch["conv_id"], pa.array(segs, pa.int64()), pa.array(places, pa.int64()), batch["marker"], batch["form"], batch["said"]]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "seg", "place", "marker", "form", "said"])

    return common.materialise(ready.select(*names, "marker", "form", "said").mapInArrow(number, schema))


def cuts(model: Model, segments: DataFrame) -> DataFrame:
    """(seg, entry, exit) of the segments of transcripts that have several."""
    several = segments.groupBy("conv_id").agg(F.min("seg").alias("a"), F.max("seg").alias("z")).where("a < z")
    parts = segments.join(several.select("conv_id", "a"), "conv_id")
    parts = parts.select("conv_id", "seg", "place", "marker", "form", (F.col("seg") == F.col("a")).alias("opens"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, ["seg"]):
            conv, seg = whole["conv_id"].to_pylist(), whole["seg"].to_pylist()
            marker, form, opens = whole["marker"].to_numpy(), whole["form"].to_numpy(), whole["opens"].to_pylist()
            bounds = common.group_bounds(whole, ["seg"]).tolist()
            rows = [
                (conv[s], seg[s], transfer(model, model.emission(marker[s:e], form[s:e]), opens[s]).tobytes())
                for s, e in zip(bounds, bounds[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                names=["conv_id", "seg", "matrix"],
            )

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        steps = [np.frombuffer(m, dtype=np.float64).reshape(len(STATES), -1) for m in pdf["matrix"]]
        choice: list[np.ndarray | None] = []
        for k, m in enumerate(steps):
            if k == 0:  # computed from the first-state scores: all its rows are equal
                score = m[0]
                choice.append(None)
            else:
                paths = score[:, None] + m
                choice.append(paths.argmax(axis=0))
                score = paths.max(axis=0)
        state, exits = int(score.argmax()), []
        for k in range(len(steps) - 1, -1, -1):
            exits.append(state)
            if k:
                state = int(choice[k][state])
        exits.reverse()
        return pd.DataFrame({"seg": pdf["seg"].to_numpy(), "entry": [-1, *exits[:-1]], "exit": exits})

    dealt = parts.repartition("seg").sortWithinPartitions("seg", "place")
    squares = dealt.mapInArrow(matrices, "conv_id long, seg long, matrix binary")
    return squares.groupBy("conv_id").applyInPandas(states, "seg long, entry int, exit int")


def parsed(lines: DataFrame, model: Model, order: list[str]) -> DataFrame:
    """Turns of transcripts given as lines: columns conv_id, the columns named in order, and line.

    One row per turn (and per segment that a turn spans): conv_id, turn, part, role, n_lines, text, rendered. Ends with the
    last line of each transcript. conv_id is a whole number. Null lines count as empty; a null conv_id is one transcript of its own; lines that tie in
    the order stand by their text; an empty table gives no rows.
    """
    line = F.coalesce("line", F.lit(""))
    own = F.coalesce("conv_id", F.lit(-(1 << 62))).cast("long")
    ready = lines.select(own.alias("conv_id"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], line.alias("line"))
    ready = ready.select("conv_id", *[f"_o{k}" for k in range(len(order))], "line", *[c.alias(n) for n, c in observed(F.col("line")).items()])
    segments = segmented(ready, [*[f"_o{k}" for k in range(len(order))], "line"])
    ends = common.materialise(cuts(model, segments))
    several = not ends.isEmpty()
    bounded = segments.join(ends, "seg", "left") if several else segments.withColumns({"entry": F.lit(None).cast("int"), "exit": F.lit(None).cast("int")})
    dealt = bounded.repartition("seg").sortWithinPartitions("seg", "place")
    schema = "conv_id long, seg long, local long, role string, n_lines long, text string"

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, ["seg"]):
            conv, seg, said = whole["conv_id"].to_pylist(), whole["seg"].to_pylist(), whole["said"].to_pylist()
            marker, form = whole["marker"].to_numpy(), whole["form"].to_numpy()
            entry, exit_ = whole["entry"].to_pylist(), whole["exit"].to_pylist()
            out: list[tuple] = []
            bounds = common.group_bounds(whole, ["seg"]).tolist()
            for s, e in zip(bounds, bounds[1:], strict=False):
                a, z = (-1 if x is None else x for x in (entry[s], exit_[s]))
                states = decode(model, model.emission(marker[s:e], form[s:e]), a, z)
                starts = [k for k, state in enumerate(states) if STATES[state][1]]
                local = 1 if starts[:1] == [0] else 0
                edges = [0, *[k for k in starts if k], e - s]
                for x, y in zip(edges, edges[1:], strict=False):
                    out.append((conv[s], seg[s], local, ROLES[STATES[states[x]][0]], y - x, "\n".join(said[s + x : s + y])))
                    local += 1
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            names = ["conv_id", "seg", "local", "role", "n_lines", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    found = dealt.select("conv_id", "seg", "place", "marker", "form", "said", "entry", "exit").mapInArrow(turns, schema)
    if several:
        from pyspark.sql import Window as W

        found = common.materialise(found)
        last = found.join(ends.select("seg"), "seg", "left_semi").groupBy("conv_id", "seg").agg(F.max("local").alias("n"))
        before = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
        offset = last.select("seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        found = found.join(offset, "seg", "left")
    else:
        found = found.withColumn("offset", F.lit(0))
    opened = F.when(F.col("local") == 0, F.lit("")).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    return found.select(
        F.when(F.col("conv_id") != -(1 << 62), F.col("conv_id")).alias("conv_id"),
        (F.coalesce("offset", F.lit(0)) + F.col("local") - 1).alias("turn"),
        F.when(F.col("local") == 0, F.col("seg")).otherwise(0).alias("part"),
        "role",
        "n_lines",
        "text",
        F.concat(opened, "text", F.lit("\n")).alias("rendered"),
    )


#: Marker styles of the transcripts that the query makes; one turn in four has none. Fixed values.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System: ", "### Human: ", "### AI: "),
    ("[sys] > ", "[me] > ", "[bot] > "),
    ("Instructions: ", "Q: ", "A: "),
)


def transcript_turns(conversations: DataFrame) -> DataFrame:
    """Turns as transcripts have them: conv_id, turn, role, lines. A conversation has one marker style throughout."""
    key = F.crc32(F.concat_ws("|", "conv_id", "turn").cast("binary"))
    style = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STYLES)))
    marker = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names, strict=True):
            marker = F.when((style == k) & (F.col("role") == role), name).otherwise(marker)
    marker = F.when(key % 4 == 0, F.lit("")).otherwise(marker)
    text = F.concat(marker, F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", F.split(text, "\n").alias("lines"))


def op3_transcripts(spark, sf_dir: str) -> DataFrame:
    turns = transcript_turns(common.table(spark, sf_dir, "conversations"))
    model = train(turns.where(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1))
    lines = turns.select("conv_id", "turn", F.xxhash64("lines").alias("h"), F.posexplode("lines").alias("at", "line"))
    return parsed(lines, model, ["turn", "h", "at"])
