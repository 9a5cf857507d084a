import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from quarrymill.llm import transcripts as T


def small_model():
    generator = np.random.default_rng(0)
    n = len(T.STATES)
    step = np.log(generator.dirichlet(np.ones(n), n))
    first = np.log(generator.dirichlet(np.ones(n)))
    return T.Model(first, step, np.log(generator.dirichlet(np.ones(4), n)), np.log(generator.dirichlet(np.ones(T.FORMS), n)))


def score(model, emission, path):
    total = model.first[path[0]] + emission[0][path[0]]
    for k in range(1, len(path)):
        total += model.step[path[k - 1], path[k]] + emission[k][path[k]]
    return total


def test_viterbi_is_the_best_path():
    model = small_model()
    emission = model.emission(np.array([0, 1, 2, 3, 0]), np.array([1, 2, 3, 4, 5]))
    best = max(itertools.product(range(len(T.STATES)), repeat=5), key=lambda p: score(model, emission, p))
    assert T.decode(model, emission, -1, -1) == list(best)


def lines_of(spark, turns):
    from pyspark.sql import functions as F

    return turns.select("conv_id", "turn", F.posexplode("lines").alias("at", "line"))


@pytest.fixture(scope="module")
def turns(spark, small_dir):
    return T.transcript_turns(spark.read.parquet(f"{small_dir}/conversations.parquet"))


def test_segments_change_nothing(spark, turns, monkeypatch):
    model = T.train(turns)
    whole = sorted(map(tuple, T.parsed(lines_of(spark, turns), model, ["turn", "at"]).select("conv_id", "turn", "role", "text").where("part = 0").collect()))
    monkeypatch.setattr(T, "SEGMENT", 3)
    monkeypatch.setattr(T, "SEGMENT_BYTES", 150)
    parts = T.parsed(lines_of(spark, turns), model, ["turn", "at"]).toPandas().sort_values(["conv_id", "turn", "part"])
    joined = parts.groupby(["conv_id", "turn"]).agg(role=("role", "first"), text=("text", "\n".join)).reset_index()
    assert parts.part.max() > 0
    assert sorted(map(tuple, joined[["conv_id", "turn", "role", "text"]].itertuples(index=False))) == whole


def test_held_out_accuracy(spark):
    small_dir = "/root/testdata/sf0.01"
    got = T.op3_transcripts(spark, small_dir).toPandas().sort_values(["conv_id", "turn", "part"])
    known = pd.read_parquet(f"{small_dir}/conversations.parquet").sort_values(["conv_id", "turn"])
    right = total = 0
    for conv, rows in known.groupby("conv_id"):
        if zlib.crc32(str(conv).encode()) % 3 == 1:
            roles = got[got.conv_id == conv].role.tolist()
            right += sum(a == b for a, b in zip(rows.role, roles))
            total += len(rows)
    assert total > 50 and right / total > 0.9


def test_lines_of_turns_without_a_marker(spark):
    """Held-out roles where nothing names the speaker, against taking the last marker seen."""
    sf_dir = "/root/testdata/sf0.01"
    got = T.op3_transcripts(spark, sf_dir).toPandas().sort_values(["conv_id", "turn", "part"])
    turns = T.transcript_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")).toPandas().sort_values(["conv_id", "turn"])
    marker = re.compile(T.MARKER)
    right = looked_up = total = 0
    for conv, rows in turns.groupby("conv_id"):
        if zlib.crc32(str(conv).encode()) % 3 != 1:
            continue
        own = got[got.conv_id == conv]
        found = [role for role, n in zip(own.role, own.n_lines) for _ in range(n)]
        at, last = 0, None
        for role, lines in zip(rows.role, rows.lines):
            m = marker.match(lines[0])
            last = T.NAMES[m[1].lower()] if m else last
            if not m:
                total += len(lines)
                right += sum(x == role for x in found[at : at + len(lines)])
                looked_up += len(lines) * (last == role)
            at += len(lines)
        assert at == len(found)
    assert total > 50 and right > 0.75 * total and right > looked_up


def test_odd_lines(spark, turns):
    model = T.train(turns)
    rows = [(1, 0, None, "x"), (1, 1, "User: hi", "x"), (1, 1, "User: hi", "x"), (1, 2, "Assistant: yes", "x"), (None, 0, "Q: a", "x"), (2, None, "", "x"), (3, 0, "z" * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, line string, role string")
    got = T.parsed(df, model, ["turn"]).collect()
    assert {r.conv_id for r in got} == {None, 1, 2, 3}
    assert sum(r.n_lines for r in got) == len(rows)
    assert next(r for r in got if r.conv_id is None).rendered == "<|user|>\na\n"
    assert [r.role for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)][-2:] == ["user", "assistant"]
    assert T.parsed(df.limit(0), model, ["turn"]).count() == 0


def test_query_s_turns_against_a_plain_version(spark, small_dir):
    """Roles, turns, texts and rendering of the whole query, from the model and the lines' features alone."""
    from pyspark.sql import functions as F

    turns = T.transcript_turns(spark.read.parquet(f"{small_dir}/conversations.parquet"))
    model = T.train(turns.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 != 1))
    seen = lines_of(spark, turns).select("conv_id", "turn", "at", "line", *[c.alias(n) for n, c in T.observed(F.col("line")).items()]).toPandas()
    expected = []
    for conv, part in seen.sort_values(["conv_id", "turn", "at"]).groupby("conv_id"):
        emission = model.emission(part.marker.to_numpy(), part.form.to_numpy())
        states = T.decode(model, emission, -1, -1)
        said, held = part.said.tolist(), []
        for k, state in enumerate(states):
            role, starts = T.STATES[state]
            if starts or not held:
                held.append([T.ROLES[role], []])
            held[-1][1].append(said[k])
        for n, (role, lines) in enumerate(held):
            text = "\n".join(lines)
            expected.append((conv, n, 0, role, len(lines), text, f"<|{role}|>\n{text}\n"))
    got = [tuple(r) for r in T.op3_transcripts(spark, small_dir).collect()]
    names = ["conv_id", "turn", "part", "role", "n_lines", "text", "rendered"]
    assert T.op3_transcripts(spark, small_dir).columns == names
    assert sorted(got) == sorted(expected)
