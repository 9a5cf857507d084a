import random

import numpy as np
import pandas as pd
from brute import simhash, simhash_components
from pyspark.sql import functions as F

from quarrymill.llm import simhash as S

WORDS = [f"w{k}" for k in range(400)]


def test_query_against_brute_force(spark, small_dir):
    got = S.op6_simhash(spark, small_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{small_dir}/documents.parquet")
    prints = [simhash(t) for t in docs.text]
    assert got.loc[docs.doc_id].fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.loc[docs.doc_id].component_id.tolist() == simhash_components(docs.doc_id.tolist(), prints)


def corpus():
    generator = random.Random(3)
    texts = []
    for _ in range(60):
        words = generator.choices(WORDS, k=300)
        for _ in range(generator.choice([1, 1, 3, 8])):
            copy = list(words)
            for _ in range(generator.choice([0, 1, 2, 4])):
                copy[generator.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts + [None, "", " \t\n", "one", "One two", "é É", "x " * 60_000]


def test_classes(spark):
    texts = corpus()
    rows = [(n, t, "x", 1) for n, t in enumerate(texts)] + [(5, texts[5], "x", 1), (None, texts[7], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, id int").repartition(7)
    got = S.simhash_classes(df).collect()
    expected = simhash_components([r[0] for r in rows], [simhash(r[1]) for r in rows])
    assert sorted((r.id, r.component_id) for r in got if r.id is not None) == sorted((r[0], e) for r, e in zip(rows, expected, strict=True) if r[0] is not None)


def jaccard(a, b):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_of_each_group_of_near_copies_stays(spark):
    generator = random.Random(6)
    groups, rows = [], []
    for g in range(80):
        words = [generator.choice(WORDS) + str(generator.randrange(50)) for _ in range(generator.choice([60, 200, 600]))]
        texts = [" ".join(words)]
        for _ in range(g % 5):
            copy = list(words)
            for _ in range(len(words) // 100):  # some 5 per cent of the shingles, similarity about 0.9
                copy[generator.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        groups.append([len(rows) + k for k in range(len(texts))])
        rows += texts
    assert all(jaccard(rows[g[0]], rows[k]) >= 0.8 for g in groups for k in g)
    extra = [None, "", " \t\n", "one", "One two", "x " * 60_000]
    data = [(n, t, "x", 1) for n, t in enumerate(rows + extra)] + [(3, rows[3], "x", 1), (None, rows[7], "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, fp string, id int").repartition(5)
    kept = S.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    first = len(rows)
    assert ids == [g[0] for g in groups] + [first, first + 3, first + 4, first + 5]


def test_pairs_at_the_limit_are_found_and_dense_groups_stay_connected(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    generator = np.random.default_rng(4)
    base = int(generator.integers(1 << 62))
    near = [base ^ int(sum(1 << int(b) for b in generator.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4, 4, 4, 5, 7) for _ in range(20)]
    values = np.unique(np.array(near + generator.integers(1 << 62, size=300).tolist(), dtype=np.uint64))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    from quarrymill.llm.common import connected_components

    signed = values.view(np.int64).tolist()
    expected = simhash_components(signed, values)
    for block in (8, 4096):
        monkeypatch.setattr(S, "BLOCK", block)
        found = S.near_fingerprints(df, S.exact_masks(4, 10**9 if block == 8 else 1), 4)
        linked = {r.node: r.root for r in connected_components(found).collect()}
        assert [linked.get(v, v) for v in signed] == expected


def test_every_pair_within_the_limit_shares_a_key():
    tables = [S.exact_masks(4, n) for n in (1, 10**8, 10**10)]
    assert [len(m) for m in tables] == [15, 35, 70] and min(m.bit_count() for m in tables[2]) == 32
    refs = S.pivots()
    generator = random.Random(1)
    for _ in range(200):
        a = generator.getrandbits(64)
        b = a
        for bit in generator.sample(range(64), 4):
            b ^= 1 << bit
        assert all(any((a & m) == (b & m) for m in masks) for masks in tables)
        x, y = np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64)
        assert max(abs(int(S.distances(x, r)) - int(S.distances(y, r))) for r in refs) <= 4


def test_tables_for_a_similarity():
    for n in (100, 10**6, 10**9):
        masks = S.sampled_masks(n, 0.8)
        size = sum(m.bit_count() for m in masks[0])
        assert 1 - (1 - (1 - S.differing(0.8)) ** size) ** len(masks) >= S.RECALL
    assert 50 <= S.wide_limit(0.8) <= 60


def test_links_are_verified_on_the_shingles(spark, monkeypatch):
    """Classes against exact search: pairs of all similarities, repeated lines, and a block size that cuts groups."""
    generator = random.Random(11)
    rows = []
    for _ in range(120):
        words = [generator.choice(WORDS) + str(generator.randrange(50)) for _ in range(120)]
        rows.append(" ".join(words))
        for _ in range(generator.randrange(4)):
            copy = list(words)
            for at in generator.sample(range(120), generator.randrange(1, 9)):
                copy[at] = "changed"
            rows.append(" ".join(copy))
    line = "the same line again and again " * 40
    rows += [line + " ".join(generator.choices(WORDS, k=60)) for _ in range(12)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in rows]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    from brute import components

    roots = components(len(rows), lambda i: np.flatnonzero(near[i]))
    best = {}
    for n, r in enumerate(roots):
        best.setdefault(r, n)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for block in (1024, 3):
        monkeypatch.setattr(S, "SET_BLOCK", block)
        kept = {r.doc_id for r in S.keep_one_of_each(df).collect()}
        assert set(best.values()) <= kept  # no class loses all its members
        assert len(kept) <= len(best) + 0.1 * (len(rows) - len(best))


def test_many_distinct_near_copies_and_repeated_rows(spark):
    generator = random.Random(2)
    words = [generator.choice(WORDS) for _ in range(400)]
    rows = []
    for n in range(300):
        copy = list(words)
        for at in generator.sample(range(400), 3):
            copy[at] = f"changed{n}"
        rows.append((n // 2, " ".join(copy), "x"))
    rows += [(None, "all the same", "x")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert sorted((r.doc_id is None, r.doc_id) for r in S.keep_one_of_each(df).collect()) == [(False, 0), (True, None)]


def test_empty_and_components_of_paths(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_classes(df).count() == 0 and S.keep_one_of_each(df).count() == 0
    from quarrymill.llm.common import connected_components

    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(1000, 1400).select(F.col("id").alias("a"), F.lit(999).cast("long").alias("b"))
    got = {r.node: r.root for r in connected_components(path.union(hub).union(path)).collect()}
    assert set(got.values()) == {0, 999} and len(got) == 201 + 401


def test_one_of_each_with_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six"), ("0", "others are words of their own"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(str, (r.doc_id for r in S.keep_one_of_each(df).collect()))) == ["0", "None", "a"]
