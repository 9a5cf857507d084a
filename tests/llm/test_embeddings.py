import numpy as np
from brute import components

from quarrymill.llm import embeddings


def check(spark, vectors, ids=None, kind="float"):
    ids = list(range(len(vectors))) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in zip(ids, vectors, strict=True)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, rep string")
    return sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)


def test_recall_and_precision_against_brute_force(spark):
    generator = np.random.default_rng(1)
    centres = generator.standard_normal((300, 32))
    noise = generator.uniform(0.02, 0.33, (300, 1))
    vectors = np.concatenate([centres + noise * generator.standard_normal((300, 32)) for _ in range(6)] + [generator.standard_normal((400, 32))])
    vectors = vectors.astype(np.float32).astype(np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    rows = {r[0]: r for r in check(spark, vectors)}
    links = np.array([rows[i][1] for i in range(len(vectors))])
    assert (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.9 * near.sum() and near.sum() > 1000
    roots = components(len(vectors), lambda i: np.flatnonzero(near[i]))
    low = {}
    for i, r in enumerate(roots):
        low.setdefault(r, i)
    same = sum(rows[i][2] == low[r] for i, r in enumerate(roots))
    assert same >= 0.9 * len(vectors)


def test_copies_and_odd_vectors(spark):
    good = [1.0, 0.5, 0.25, 0.125]
    odd = [None, [], [0.0] * 4, [1.0, None, 0, 0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [1.0, 2.0]]
    rows = check(spark, [good, good, [-x for x in good], *odd, good, good], [5, 3, 7, *range(10, 10 + len(odd)), 3, None])
    got = [r for r in rows if r[0] in (3, 5, None)]
    assert all(r[1] == 3 and r[2] == 3 for r in got) and len(got) == 4
    assert [r[3] for r in got if r[0] == 3] == [True, True] and not any(r[3] for r in got if r[0] != 3)
    alone = [r for r in rows if r[0] in range(7, 20)]
    assert len(alone) == 8 and all(r[1] == 0 and r[2] == r[0] and r[3] for r in alone)


def test_every_length_is_compared_and_numbers_of_any_size(spark):
    rows = check(spark, [[1, 2], [1, 2], [1, 2, 3], [2, 4, 6], [1, 0, 0], [1, 2, 3.1]], kind="double")
    assert [r[1:3] for r in rows] == [(1, 0), (1, 0), (2, 2), (2, 2), (0, 4), (2, 2)]
    huge = [[1e200, 1e200, 0], [2e200, 2e200, 0], [1e-200, 1e-200, 0], [5e-324, 5e-324, 0], [1e308, -1e308, 0], [0, 0, 1e-300]]
    rows = check(spark, huge, kind="double")
    assert [r[1:3] for r in rows] == [(3, 0), (3, 0), (3, 0), (3, 0), (0, 4), (0, 5)]


def test_the_hamming_limit_keeps_pairs_at_the_cosine(spark):
    generator = np.random.default_rng(3)
    sample = embeddings.unit(generator.standard_normal((2000, 24)))
    projections = embeddings.learn(sample, 160)
    limit = embeddings.hamming_limit(sample, projections, 0.9)
    other = embeddings.unit(generator.standard_normal((2000, 24)))
    aside = embeddings.unit(other - (other * sample).sum(axis=1, keepdims=True) * sample)
    partner = 0.9 * sample + np.sqrt(1 - 0.81) * aside
    differing = lambda x, y: ((x @ projections >= 0) != (y @ projections >= 0)).sum(axis=1)
    assert (differing(sample, partner) <= limit).mean() > 0.999 and (differing(sample, other) <= limit).mean() < 0.05


def test_reruns_agree(spark):
    generator = np.random.default_rng(7)
    vectors = np.repeat(generator.standard_normal((40, 8)), 5, axis=0) + 0.1 * generator.standard_normal((200, 8))
    assert check(spark, vectors) == check(spark, vectors)


def test_nothing_usable_and_empty(spark):
    assert check(spark, [None, [0.0, 0.0]]) == [(0, 0, 0, True), (1, 0, 1, True)]
    assert check(spark, []) == []


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings.common, "HELD", 256)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    generator = np.random.default_rng(2)
    vectors = np.ones((120, 16)) + 0.01 * generator.standard_normal((120, 16))
    rows = check(spark, vectors)
    assert all(r[1] == 119 and r[2] == 0 for r in rows)


def test_tables_for_a_recall():
    for n in (100, 50_000, 10**9):
        bits, tables = embeddings.plan_tables(n, 0.9)
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.95


def test_one_id_on_different_vectors(spark):
    rows = check(spark, [[1, 0, 0], [1, 0], [1, 0.01, 0], [1, 0.01]], [1, 1, 2, 3], "double")
    assert [r[:3] for r in rows] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    rows = check(spark, [[1, 0, 0], [0, 1, 0], [1, 0.01, 0], [0, 1, 0.01]], [1, 1, 2, 3], "double")
    assert [r[:3] for r in rows] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert [r[3] for r in rows] == [True, True, False, False]


def test_repeated_ids_against_brute_force(spark):
    generator = np.random.default_rng(4)
    centres = generator.standard_normal((40, 16))
    vectors = np.concatenate([centres + 0.1 * generator.standard_normal((40, 16)) for _ in range(4)])
    ids = generator.integers(0, 50, len(vectors)).tolist()
    near = embeddings.unit(vectors) @ embeddings.unit(vectors).T >= 0.9
    np.fill_diagonal(near, False)
    roots = components(len(vectors), lambda i: np.flatnonzero(near[i]))
    low = {r: min(ids[i] for i in range(len(ids)) if roots[i] == r) for r in roots}
    expected = sorted(((ids[i], int(near[i].sum()), low[roots[i]], ids[i] == low[roots[i]]) for i in range(len(ids))), key=str)
    assert check(spark, vectors.tolist(), ids, "double") == expected


def test_many_lengths_have_bounded_samples(spark, monkeypatch):
    """Lengths beyond the learned ones are compared too; nothing of theirs reaches the driver but counts."""
    monkeypatch.setattr(embeddings, "LEARNED", 2)
    generator = np.random.default_rng(5)
    vectors = []
    for size in range(3, 15):
        base = generator.standard_normal((3, size))
        vectors += [*base.tolist(), *(base + 0.01).tolist()]
    rows = check(spark, vectors, kind="double")
    near = [[len(a) == len(b) and np.dot(a, b) >= 0.9 * np.linalg.norm(a) * np.linalg.norm(b) for b in vectors] for a in vectors]
    assert [r[1] for r in sorted(rows)] == [sum(n) - 1 for n in near]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<double>")
    learned = [size for size, plan in embeddings.plans(df, 0.9).items() if plan.projections is not None]
    assert learned == [3, 4]
