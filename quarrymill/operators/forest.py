"""Isolation forest as a table of nodes, grown and scored by Spark alone.

Nodes are rows (tree, node, feature, cut, path): node 1 is a tree's root, 2n and 2n + 1 are the children of n; a row with
feature >= cut goes right; a leaf has no feature and its path length in millionths. Every random choice is a hash, so that
another engine grows and walks the same forest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.operators.sampling import draw, fixed_size, uniform

#: Path lengths are whole numbers of 1 / PATH, whose sums don't depend on their order; scores have so many decimals.
PATH, DECIMALS = 1_000_000, 9
EULER = 0.5772156649015329


def average_path(n: Column) -> Column:
    """Mean path length of an unsuccessful search in a tree over n points."""
    x = n.cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2.0 * (F.log(x - 1.0) + EULER) - 2.0 * (x - 1.0) / x)


def forest(df: DataFrame, features: Sequence[str], key: str = "product_id", trees: int = 100, subsample: int = 256, seed: int = 42) -> DataFrame:
    """The forest's nodes: tree, node, feature (its place in features, null for a leaf), cut, path, size (points of a tree).

    A sample of trees * subsample rows at most, by the keys' hash, is dealt to the trees, in a circle if it is smaller. All
    trees grow at once, one level after the other, by windows over (tree, node): one shuffle by tree, no row on the driver.
    Rows with nulls in the features are left out. Without rows there are no nodes.
    """
    values = [F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]
    picked = fixed_size(df.dropna(subset=list(features)).select(key, *values), key, trees * subsample, seed)
    # The sample is bounded: one task numbers it.
    whole = W.partitionBy()
    placed = picked.withColumn("p", F.row_number().over(whole.orderBy(draw(key, seed), key)) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    placed = placed.withColumn("size", F.least(F.lit(subsample), "n"))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.col("p") - t * F.col("size"), F.col("n")) < F.col("size"))
    names = [f"f{k}" for k in range(len(features))]
    points = placed.select(F.explode(mine).alias("tree"), *names, "size").repartition(min(trees, 32), "tree")
    points = points.withColumns({"node": F.lit(1), "steps": F.array().cast("array<struct<node:int,feature:int,cut:double>>")})
    for _ in range(max(1, math.ceil(math.log2(max(2, subsample))))):
        at = W.partitionBy("tree", "node")
        spread = [F.struct(F.lit(k).alias("feature"), F.min(f).over(at).alias("low"), F.max(f).over(at).alias("high")) for k, f in enumerate(names)]
        points = points.withColumn("spread", F.array(*spread))
        points = points.withColumn("spread", F.filter("spread", lambda x: x["high"] > x["low"]))
        place = F.col("tree") * 1024 + F.col("node")
        pick = F.get("spread", F.floor(uniform(place, seed + 1) * F.size("spread")).cast("int"))
        points = points.withColumn("pick", pick).withColumn("cut", F.col("pick.low") + uniform(place, seed + 2) * (F.col("pick.high") - F.col("pick.low")))
        value = F.get(F.array(*names), F.col("pick.feature"))
        step = F.struct("node", F.col("pick.feature").alias("feature"), "cut")
        inner = F.col("pick").isNotNull()
        points = points.withColumns(
            {
                "steps": F.when(inner, F.array_append("steps", step)).otherwise(F.col("steps")),
                "node": F.when(inner, F.col("node") * 2 + (value >= F.col("cut")).cast("int")).otherwise(F.col("node")),
            }
        ).drop("spread", "pick", "cut")
    leaf = points.groupBy("tree", "node", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("steps")).alias("depth"))
    path = F.round((F.col("depth") + average_path(F.col("n"))) * PATH).cast("long")
    none = F.lit(None)
    leaves = leaf.select("tree", "node", none.cast("int").alias("feature"), none.cast("double").alias("cut"), path.alias("path"), "size")
    inner_nodes = points.select("tree", "size", F.inline("steps")).distinct()
    return inner_nodes.select("tree", "node", "feature", "cut", none.cast("long").alias("path"), "size").unionByName(leaves)


def whole_trees(found: pd.DataFrame, features: int) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The forest with every leaf on the lowest level: depth, each feature's distinct cuts, and by (tree, node) feature, cut, path.

    A leaf above the lowest level goes left until it is there. A cut is its place among the feature's cuts: a value is not
    below it if it is not below as many of them.
    """
    trees, most = int(found["tree"].max()) + 1, int(found["node"].max()) + 1
    depth = (most - 1).bit_length() - 1
    inner = found["feature"].notna().to_numpy()
    tree, node = found["tree"].to_numpy(), found["node"].to_numpy()
    which, at = found["feature"].fillna(-1).to_numpy(dtype=np.int64), found["cut"].to_numpy(dtype=np.float64)
    cuts = [np.unique(at[which == k]) for k in range(features)]
    never = 1 + max(len(c) for c in cuts)
    feature, cut, path = np.zeros((trees, 2**depth), np.int64), np.full((trees, 2**depth), never, np.int32), np.zeros((trees, 2**depth), np.int64)
    for k, known in enumerate(cuts):
        mine = which == k
        feature[tree[mine], node[mine]], cut[tree[mine], node[mine]] = k, np.searchsorted(known, at[mine]) + 1
    for t, n, p in zip(tree[~inner], node[~inner], found["path"].to_numpy()[~inner], strict=True):
        path[t, (int(n) << (depth - (int(n).bit_length() - 1))) - 2**depth] = p
    return depth, cuts, feature, cut, path


def scored(df: DataFrame, nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds score = -2^(-mean path / expected path), lower for outliers; rows with nulls in the features are dropped.

    The forest, at most trees * 2 ** (depth + 1) short rows, goes to every task, where whole Arrow batches walk down it: a
    value is looked up among its feature's cuts once, trees then compare places.
    """
    rows = df.dropna(subset=list(features))
    found = nodes.select("tree", "node", "feature", "cut", "path", average_path(F.col("size")).alias("expected")).toPandas()
    if not len(found):
        return rows.withColumn("score", F.lit(None).cast("double"))
    grown = df.sparkSession.sparkContext.broadcast(whole_trees(found, len(features)))
    count, expected = int(found["tree"].nunique()), float(found["expected"][0]) or 1.0

    @F.pandas_udf("long")
    def paths(*points: pd.Series) -> pd.Series:
        depth, cuts, feature, cut, path = grown.value
        size, width = len(points[0]), len(points)
        places = np.column_stack([np.searchsorted(known, x.to_numpy(dtype=np.float64), side="right") for known, x in zip(cuts, points, strict=True)]).astype(np.int32).ravel()
        row, total = np.arange(size) * width, np.zeros(size, dtype=np.int64)
        at, value, bound = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int32), np.empty(size, dtype=np.int32)
        for f, c, p in zip(feature, cut, path, strict=True):
            node = np.ones(size, dtype=np.int64)
            for _ in range(depth):  # every index is in range: clip spares numpy a buffer
                f.take(node, out=at, mode="clip")
                at += row
                places.take(at, out=value, mode="clip")
                c.take(node, out=bound, mode="clip")
                node += node
                node += value >= bound
            total += p.take(node - 2**depth)
        return pd.Series(total)

    mean = paths(*[F.col(f).cast("double") for f in features]).cast("double") / float(count * PATH)
    return rows.withColumn("score", F.round(-F.pow(F.lit(2.0), -(mean / expected)), DECIMALS))


# The same as SQL ------------------------------------------------------------------------------------------------------


def average_path_sql(n: str) -> str:
    x = f"({n})::DOUBLE"
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln({x} - 1.0) + {EULER}::DOUBLE) - 2.0::DOUBLE * ({x} - 1.0) / {x} END"


def forest_sql(table: str, features: Sequence[str], draw_sql, uniform_sql, key: str = "product_id", trees: int = 100, subsample: int = 256, seed: int = 42) -> str:
    """Common table expressions for the forest of a table, its nodes (forest) and the rows' scores (scored: key, score)."""
    names = [f"f{k}" for k in range(len(features))]
    levels = max(1, math.ceil(math.log2(max(2, subsample))))
    present = " AND ".join(f"{f} IS NOT NULL" for f in features)
    given = ", ".join(f"{f}::DOUBLE AS f{k}" for k, f in enumerate(features))
    parts = [
        f"forest_rows AS (SELECT {key}, {given} FROM {table} WHERE {present})",
        f"picked AS (SELECT * FROM forest_rows ORDER BY {draw_sql(key, seed)}, {key} LIMIT {trees * subsample})",
        f"placed AS (SELECT *, row_number() OVER (ORDER BY {draw_sql(key, seed)}, {key}) - 1 AS p, count(*) OVER () AS n, least({subsample}, count(*) OVER ()) AS size FROM picked)",
        f"level0 AS (SELECT tree, 1 AS node, 0 AS depth, size, {', '.join(names)} FROM placed, (SELECT unnest(range({trees})) AS tree) WHERE ((p - tree * size) % n + n) % n < size)",
    ]
    for i in range(levels):
        bounds = ", ".join(f"min({f}) OVER w AS low_{f}, max({f}) OVER w AS high_{f}" for f in names)
        wide = " + ".join(f"(high_{f} > low_{f})::INTEGER" for f in names)
        before = "0"
        which, low, high, value = "", "", "", ""
        for k, f in enumerate(names):
            which += f" WHEN high_{f} > low_{f} AND j = {before} THEN {k}"
            low, high, value = low + f" WHEN {k} THEN low_{f}", high + f" WHEN {k} THEN high_{f}", value + f" WHEN {k} THEN {f}"
            before += f" + (high_{f} > low_{f})::INTEGER"
        place = "tree * 1024 + node"
        parts += [
            f"spread{i} AS (SELECT *, {bounds} FROM level{i} WINDOW w AS (PARTITION BY tree, node))",
            f"place{i} AS (SELECT *, floor({uniform_sql(place, seed + 1)} * ({wide})) AS j FROM spread{i})",
            f"pick{i} AS (SELECT *, CASE{which} END AS feature FROM place{i})",
            f"cut{i} AS (SELECT *, CASE feature{low} END + {uniform_sql(place, seed + 2)} * (CASE feature{high} END - CASE feature{low} END) AS cut FROM pick{i})",
            f"level{i + 1} AS (SELECT tree, CASE WHEN feature IS NULL THEN node ELSE node * 2 + (CASE feature{value} END >= cut)::INTEGER END AS node, depth + (feature IS NOT NULL)::INTEGER AS depth, size, {', '.join(names)} FROM cut{i})",
        ]
    inner = " UNION ".join(f"SELECT tree, node, feature, cut, NULL::BIGINT AS path FROM cut{i} WHERE feature IS NOT NULL" for i in range(levels))
    parts.append(
        f"forest AS ({inner} UNION ALL SELECT tree, node, NULL, NULL, round((max(depth) + ({average_path_sql('count(*)')})) * {PATH})::BIGINT FROM level{levels} GROUP BY tree, node)"
    )
    parts.append(f"walk0 AS (SELECT {key}, {', '.join(names)}, tree, 1 AS node FROM forest_rows, (SELECT unnest(range({trees})) AS tree))")
    value = "".join(f" WHEN {k} THEN {f}" for k, f in enumerate(names))
    for i in range(levels):
        parts.append(
            f"walk{i + 1} AS (SELECT {key}, {', '.join(names)}, tree, CASE WHEN feature IS NULL THEN node ELSE node * 2 + (CASE feature{value} END >= cut)::INTEGER END AS node FROM walk{i} JOIN forest USING (tree, node))"
        )
    expected = f"(SELECT {average_path_sql('any_value(size)')} FROM placed)"
    mean = f"sum(path)::DOUBLE / {float(trees * PATH)}::DOUBLE"
    parts.append(
        f"scored AS (SELECT {key}, round(-pow(2.0::DOUBLE, -(({mean}) / {expected})), {DECIMALS}) AS score FROM walk{levels} JOIN forest USING (tree, node) GROUP BY {key})"
    )
    return ",\n".join(parts)
