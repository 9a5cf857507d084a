import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.operators import boosting, forest, models, sampling


def points(spark, n=2000):
    """y depends on a (missing in a fifth of the rows) and b."""
    u = lambda s: sampling.uniform("id", s)
    return spark.range(n).select("id", F.when(u(1) >= 0.2, F.round(u(2) * 50)).alias("a"), F.round(u(3) * 10).alias("b"))


SMALL = boosting.Settings(rounds=40, rate=0.2, depth=3, leaves=8, least=5, patience=None)


@pytest.mark.parametrize(("missing", "low"), [(0.0, True), (100.0, False)])
def test_missing_values_learn_their_side(spark, missing, low):
    """Small values of a give 0, large ones 100; what missing ones give decides their side at the root."""
    df = points(spark).withColumn("y", F.when(F.col("a").isNull(), missing).when(F.col("a") <= 25, 0.0).otherwise(100.0))
    nodes = boosting.fit(df, ["a", "b"], "y", "id", SMALL)
    root = nodes.where("tree = 1 AND node = 1").first()
    assert root.feature == 0 and root.missing_low is low
    out = boosting.predicted(df, nodes, ["a", "b"])
    assert out.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.1


def test_missing_values_between_the_others(spark):
    """Neither lowest nor highest: a sentinel's place would be of no help."""
    df = points(spark).withColumn("y", F.when(F.col("a").isNull(), 50.0).otherwise(F.col("a") * 2))
    nodes = boosting.fit(df, ["a", "b"], "y", "id", SMALL._replace(rounds=80, depth=4, leaves=16))
    row = models.regression_metrics(boosting.predicted(df, nodes, ["a", "b"]), "y", "prediction").first()
    assert row.r2 > 0.995
    alone = boosting.predicted(df.where("a IS NULL"), nodes, ["a", "b"])
    assert alone.agg(F.max(F.abs(F.col("prediction") - 50))).first()[0] < 2


def test_models_are_the_same_on_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    df = points(spark, 900).withColumn("y", F.coalesce("a", F.lit(7.0)) * 1.37 + F.col("b"))
    rounds = SMALL._replace(rounds=8)
    one, many = (sorted(map(str, boosting.fit(df.repartition(k), ["a", "b"], "y", "id", rounds).collect())) for k in (1, 7))
    assert one == many


def test_boosting_stops_without_a_gain(spark):
    df = points(spark).withColumn("y", F.when(F.col("a") > 25, 1.0).otherwise(0.0))
    nodes = boosting.fit(df, ["a", "b"], "y", "id", boosting.Settings(rounds=200, rate=0.5, depth=2, least=5, patience=3))
    assert nodes.agg(F.max("tree")).first()[0] < 60


def test_boosting_edges(spark):
    schema = "id long, a double, y double"
    empty = spark.createDataFrame([], schema)
    nodes = boosting.fit(empty, ["a"], "y", "id", SMALL)
    assert [tuple(r) for r in nodes.collect()] == [(0, 1, None, None, None, 0.0)]
    odd = spark.createDataFrame([(1, None, 4.0), (2, float("nan"), 6.0), (3, None, None), (None, 1.0, 5.0), (None, 1.0, 5.0)], schema)
    nodes = boosting.fit(odd, ["a"], "y", "id", SMALL)
    assert boosting.predicted(odd, nodes, ["a"]).agg(F.min("prediction"), F.max("prediction"), F.count("prediction")).first() == (5.0, 5.0, 5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3, 255]), st.sampled_from([0, 7, 255]), st.integers(-50, 50)), min_size=2, max_size=40), st.integers(1, 4))
def test_the_best_split(rows, least):
    bins, target = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows], dtype=np.int64)
    g, n = np.zeros((2, 256), dtype=np.int64), np.zeros((2, 256), dtype=np.int64)
    for k in range(2):
        np.add.at(g[k], bins[:, k], target)
        np.add.at(n[k], bins[:, k], 1)
    square = lambda v: v.sum() ** 2 / len(v)
    best = 0.0
    for k in range(2):
        for cut in range(255):
            for missing_low in (True, False):
                low = (bins[:, k] <= cut) | ((bins[:, k] == 255) & missing_low)
                if min(low.sum(), (~low).sum()) >= least:
                    best = max(best, square(target[low]) + square(target[~low]) - square(target))
    assert boosting.best_split(g, n, least)[0] == pytest.approx(best, abs=1e-9)


def walk(nodes, x):
    """Path length of one row in one tree, by the table alone."""
    at = 1
    while nodes[at].feature is not None:
        at = 2 * at + (x[nodes[at].feature] >= nodes[at].cut)
    return nodes[at].path


def test_scores_follow_the_table_of_nodes(spark):
    names = ["a", "b", "c"]
    df = spark.range(700).select(F.col("id").alias("product_id"), *[(sampling.uniform("id", k) * 10).alias(n) for k, n in enumerate(names)])
    df = df.withColumn("c", F.when(F.col("product_id") % 10 > 0, F.col("c")))
    nodes = forest.forest(df, names, trees=12, subsample=64)
    rows = nodes.collect()
    assert {r["size"] for r in rows} == {64} and {r.tree for r in rows} == set(range(12))
    trees = [{r.node: r for r in rows if r.tree == t} for t in range(12)]
    for tree in trees:  # whole trees: two children for every cut, none for a leaf
        assert all((2 * k in tree and 2 * k + 1 in tree) == (r.feature is not None) for k, r in tree.items())
    got = forest.scored(df, nodes, names).collect()
    assert len(got) == 630
    harmonic = 2.0 * (np.log(63.0) + forest.EULER) - 2.0 * 63 / 64
    for r in got[:100]:
        mean = sum(walk(t, [r.a, r.b, r.c]) for t in trees) / 12e6
        assert r.score == pytest.approx(-(2 ** (-mean / harmonic)), abs=2e-9)


def test_small_and_flat_tables(spark):
    flat = spark.createDataFrame([(str(k), 1.0, 2.0) for k in range(9)], "product_id string, a double, b double")
    nodes = forest.forest(flat, ["a", "b"], trees=3, subsample=4).collect()
    assert sorted((r.tree, r.node, r.feature) for r in nodes) == [(0, 1, None), (1, 1, None), (2, 1, None)]
    same = forest.forest(flat.repartition(5), ["a", "b"], trees=3, subsample=4).collect()
    assert sorted(map(str, same)) == sorted(map(str, nodes))


def test_starts_advance_together_and_end_where_lloyd_does(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("product_id"), *[(F.pmod("id", F.lit(3)) * 4 * (k + 1) + sampling.uniform("id", k)).alias(c) for k, c in enumerate("ab")])
    centres, cost = models.kmeans(df.repartition(5), ["a", "b"], 3, 4, "product_id", 1)
    x = np.array([(r.a, r.b) for r in df.collect()])
    at, away = models.nearest(x, centres)
    assert cost == pytest.approx(away.sum(), abs=1e-3)
    assert np.abs(np.array([x[at == j].mean(0) for j in range(3)]) - centres).max() < 2e-4
    assert sorted(np.bincount(at).tolist()) == [200, 200, 200]  # the groups as made
    again, same = models.kmeans(df.repartition(2), ["a", "b"], 3, 4, "product_id", 1)
    assert same == cost and (again == centres).all()


def test_one_job_a_pass(spark):
    """All starts share a pass: the number of passes is that of the slowest start, not the sum."""
    df = spark.range(300).select(F.col("id").cast("string").alias("product_id"), sampling.uniform("id", 1).alias("a"))
    calls = []
    original = models.lloyd_pass
    models.lloyd_pass = lambda *a: calls.append(a[2]) or original(*a)
    try:
        models.kmeans(df, ["a"], 3, 5, "product_id", 7)
    finally:
        models.lloyd_pass = original
    assert calls[0] == [0, 1, 2, 3, 4] and all(set(b) <= set(a) for a, b in zip(calls, calls[1:], strict=False))


def test_assignment_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, None), (1.0, 0.0), (3.0, 0.0)], "a double, b double")
    got = [r.segment for r in models.assigned(df, ["a", "b"], [(0.0, 0.0), (2.0, 0.0)]).collect()]
    assert got == [0, None, 0, 1]  # the first of equally near ones
    assert models.kmeans(df.limit(0).withColumn("product_id", F.lit("")), ["a", "b"], 2, 2, "product_id", 1)[1] == 0.0
