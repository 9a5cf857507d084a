"""Gradient boosting over histograms, with a learned direction for missing values.

Feature values are binned once; rows then travel as blocks of bytes that stay in the tasks. A level of a tree is one Spark
aggregate: sums of gradients by node, feature and bin, counted within each task before they are shuffled. From them the
driver picks, for every node, the cut and the side of missing values that lower the squared error most. Gradients are whole
numbers, so that the sums, and the model with them, don't depend on the order of rows or on their partitioning.

A model is a table of nodes (tree, node, feature, cut, missing_low, value): node 1 is a root, 2n and 2n + 1 the children of
n; a row goes low (2n) with feature <= cut, or with a null where missing_low holds; a leaf has no feature and adds its value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.sampling import uniform
from quarrymill.sources import files

#: Most bins of present values; one more bin holds missing ones. Accuracy of the sketch that places the cuts.
BINS, SKETCH = 255, 10_000
#: Whole numbers in a unit of the label, for gradients; sums of a task stay below 2 ** 53 for labels to a million.
UNIT = 1_000
#: Trees after which the blocks are written again with their predictions.
REFRESH = 10
NODES = "tree int, node int, feature int, cut double, missing_low boolean, value double"


class Settings(NamedTuple):
    """Rounds at most, shrinkage, depth and leaves of a tree, rows of a leaf at least; patience: rounds without a gain on
    the held-out share after which boosting stops (None: never)."""

    rounds: int = 200
    rate: float = 0.1
    depth: int = 5
    leaves: int = 31
    least: int = 20
    patience: int | None = 10
    held_out: float = 0.1
    seed: int = 42


class Node(NamedTuple):
    feature: int
    bin: int
    missing_low: bool


class Tree(NamedTuple):
    """Inner nodes and leaf values by heap number."""

    inner: dict[int, Node]
    values: dict[int, float]


def cuts_of(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Ascending cuts of each feature, at quantiles: one aggregate for all features."""
    shares = [k / BINS for k in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, SKETCH).alias(f) for f in features]).first()
    return [np.unique(np.array(row[f] or [], dtype=np.float64)) for f in features]


def reach(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf, or the node still open, of each row."""
    node = np.ones(len(bins), dtype=np.int64)
    for number in sorted(tree.inner):
        at = tree.inner[number]
        here = np.flatnonzero(node == number)
        values = bins[here, at.feature]
        low = (values <= at.bin) | (values == BINS) if at.missing_low else values <= at.bin
        node[here] = 2 * number + ~low
    return node


def added(bins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree in trees:
        if tree.values:
            table = np.zeros(max(tree.values) + 1)
            table[list(tree.values)] = list(tree.values.values())
            total += table[reach(bins, tree)]
    return total


def blocks_of(df: DataFrame, features: Sequence[str], label: str, key: str, cuts: list[np.ndarray], base: float, settings: Settings) -> DataFrame:
    """Rows as blocks: bins, labels, predictions and whether a row is held out, as bytes."""
    hidden = uniform(key, settings.seed + 1) < (settings.held_out if settings.patience else 0.0)
    rows = df.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], F.col(label).cast("double").alias("y"), hidden.alias("hidden"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.empty((batch.num_rows, len(cuts)), dtype=np.uint8)
            for k, at in enumerate(cuts):
                x = batch.column(k).to_numpy(zero_copy_only=False)
                bins[:, k] = np.where(np.isnan(x), BINS, np.searchsorted(at, x, side="left"))
            y = batch.column(len(cuts)).to_numpy(zero_copy_only=False)
            hidden_ = batch.column(len(cuts) + 1).to_numpy(zero_copy_only=False).astype(np.uint8)
            parts = [bins.tobytes(), y.tobytes(), np.full(len(y), base).tobytes(), hidden_.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["bins", "y", "p", "hidden"])

    return rows.mapInArrow(pack, "bins binary, y binary, p binary, hidden binary")


def unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for bins, y, p, hidden in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            yield np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(y), np.frombuffer(p), np.frombuffer(hidden, np.uint8).astype(bool)


def refreshed(blocks: DataFrame, width: int, trees: Sequence[Tree]) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, p, hidden in unpacked(batches, width):
            parts = [bins.tobytes(), y.tobytes(), (p + added(bins, trees)).tobytes(), hidden.astype(np.uint8).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["bins", "y", "p", "hidden"])

    return blocks.mapInArrow(add, blocks.schema)


def histogram(blocks: DataFrame, width: int, trees: Sequence[Tree], tree: Tree, open_: Sequence[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of gradients and counts by open node, feature and bin; and the held-out rows' squared error.

    One aggregate: each task sums its own rows, at most nodes * features * bins numbers, before anything is shuffled.
    """
    place = {n: k for k, n in enumerate(open_)}
    cells = len(open_) * width * (BINS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, error = np.zeros(cells), np.zeros(cells), 0
        slots = np.full(max(open_) + 1, -1, dtype=np.int64)
        slots[list(place)] = list(place.values())
        for bins, y, p, hidden in unpacked(batches, width):
            off = y - p - added(bins, trees)
            error += int(np.rint(off[hidden] ** 2).astype(np.int64).sum())
            node = reach(bins, tree)
            node = np.where(node < len(slots), slots[np.minimum(node, len(slots) - 1)], -1)
            here = np.flatnonzero((node >= 0) & ~hidden)
            gradient = np.rint(off[here] * UNIT)
            for k in range(width):
                cell = (node[here] * width + k) * (BINS + 1) + bins[here, k]
                sums += np.bincount(cell, weights=gradient, minlength=cells)
                counts += np.bincount(cell, minlength=cells)
        used = np.flatnonzero(counts)
        arrays = [np.append(used, -1), np.append(sums[used].astype(np.int64), error), np.append(counts[used].astype(np.int64), 0)]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=["cell", "g", "n"])

    found = blocks.mapInArrow(count, "cell long, g long, n long").groupBy("cell").agg(F.sum("g"), F.sum("n")).collect()
    g, n, error = np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=np.int64), 0
    for cell, a, b in found:
        if cell < 0:
            error = a
        else:
            g[cell], n[cell] = a, b
    shape = (len(open_), width, BINS + 1)
    return g.reshape(shape), n.reshape(shape), error


def best_split(g: np.ndarray, n: np.ndarray, least: int) -> tuple[float, Node | None, tuple[int, int], tuple[int, int]]:
    """Of one node (features x bins): the gain, the cut, and (sum, count) of the low and the high child.

    Missing values are tried on both sides of every cut. Where a node has none, they will go with the larger child.
    """
    total, rows = int(g[0].sum()), int(n[0].sum())
    best: tuple[float, Node | None, tuple[int, int], tuple[int, int]] = (0.0, None, (0, 0), (0, 0))
    if rows < 2 * least:
        return best
    below_g, below_n = np.cumsum(g[:, :BINS], axis=1), np.cumsum(n[:, :BINS], axis=1)
    for missing_low in (True, False):
        low_g = below_g + (g[:, BINS:] if missing_low else 0)
        low_n = below_n + (n[:, BINS:] if missing_low else 0)
        high_g, high_n = total - low_g, rows - low_n
        good = (low_n >= least) & (high_n >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(good, low_g.astype(float) ** 2 / low_n + high_g.astype(float) ** 2 / high_n - float(total) ** 2 / rows, 0.0)
        k = int(gain.argmax())
        feature, at = divmod(k, BINS)
        if gain[feature, at] > best[0]:
            low, high = (int(low_g[feature, at]), int(low_n[feature, at])), (int(high_g[feature, at]), int(high_n[feature, at]))
            side = missing_low if n[feature, BINS] else low[1] >= high[1]
            best = (float(gain[feature, at]), Node(feature, at, side), low, high)
    return best


def grow(blocks: DataFrame, width: int, trees: Sequence[Tree], settings: Settings) -> tuple[Tree, int]:
    """The next tree and the held-out error before it: a level at a time, the best cuts first while there are leaves left."""
    tree, error, open_, leaves = Tree({}, {}), 0, [1], 1
    for level in range(settings.depth):
        g, n, found = histogram(blocks, width, trees, tree, open_)
        error = found if not level else error
        if not level:
            tree.values[1] = settings.rate * g[0, 0].sum() / UNIT / max(1, n[0, 0].sum())
        splits = sorted(((best_split(g[k], n[k], settings.least), node) for k, node in enumerate(open_)), key=lambda x: (-x[0][0], x[1]))
        open_ = []
        for (_, cut, low, high), node in splits:
            if cut is None or leaves >= settings.leaves:
                continue
            leaves += 1
            tree.inner[node] = cut
            del tree.values[node]
            for child, (total, rows) in ((2 * node, low), (2 * node + 1, high)):
                tree.values[child] = settings.rate * total / UNIT / rows
                open_.append(child)
        open_.sort()
        if not open_:
            break
    return tree, error


def fit(df: DataFrame, features: Sequence[str], label: str, key: str, settings: Settings = Settings()) -> DataFrame:
    """The model's nodes, tree 0 being one leaf with the label's mean; rows without a label are left out.

    Nulls and NaN of a feature are missing values. The rows are binned and written once; after every REFRESH trees they are
    written again with their predictions, so that a task never adds up more trees than that.
    """
    spark, width = df.sparkSession, len(features)
    df = df.where(F.col(label).isNotNull())
    df = df.withColumns({f: F.nullif(F.col(f).cast("double"), F.lit(float("nan"))) for f in features})
    cuts = cuts_of(df, features)
    base = df.agg(F.avg(F.col(label).cast("decimal(24,6)")).cast("double")).first()[0] or 0.0

    def written(blocks: DataFrame) -> tuple[str, DataFrame]:
        path = files.scratch(spark, "blocks")
        files.write_parquet(blocks, path)
        return path, spark.read.schema(blocks.schema).parquet(path)

    path, blocks = written(blocks_of(df, features, label, key, cuts, base, settings))
    trees: list[Tree] = []
    pending: list[Tree] = []
    errors: list[int] = []
    for _ in range(settings.rounds):
        tree, error = grow(blocks, width, pending, settings)
        errors.append(error)
        if settings.patience and len(errors) > settings.patience and min(errors[-settings.patience :]) >= errors[-settings.patience - 1]:
            break
        if not tree.inner:
            break
        trees.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH:
            before = path
            path, blocks = written(refreshed(blocks, width, pending))
            files.discard(spark, before)
            pending = []
    files.discard(spark, path)
    rows = [(0, 1, None, None, None, float(base))]
    for t, tree in enumerate(trees, 1):
        # A cut stands behind its bin's values; one behind all cuts parts the missing values from the rest.
        rows += [(t, n, at.feature, float(cuts[at.feature][at.bin]) if at.bin < len(cuts[at.feature]) else float("inf"), at.missing_low, None) for n, at in tree.inner.items()]
        rows += [(t, n, None, None, None, float(v)) for n, v in tree.values.items()]
    return spark.createDataFrame(rows, NODES)


def predicted(df: DataFrame, nodes: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """Adds the model's prediction. The nodes, rounds * 2 ** (depth + 1) at most, go to every task."""
    found = nodes.orderBy("tree", "node").toPandas()
    most = int(found["node"].max()) + 1
    trees = int(found["tree"].max()) + 1
    feature, cut = np.full((trees, most), -1, dtype=np.int64), np.zeros((trees, most))
    low, value = np.zeros((trees, most), dtype=bool), np.zeros((trees, most))
    at = (found["tree"].to_numpy(), found["node"].to_numpy())
    feature[at], cut[at] = found["feature"].fillna(-1).astype("int64"), found["cut"].fillna(0.0)
    low[at], value[at] = found["missing_low"].map(lambda x: x is True or x == 1.0), found["value"].fillna(0.0)
    model = df.sparkSession.sparkContext.broadcast((feature, cut, low, value))

    @F.pandas_udf("double")
    def predict(points: pd.DataFrame) -> pd.Series:
        x = points.to_numpy(dtype=np.float64)
        row, total = np.arange(len(x)), np.zeros(len(x))
        for f, c, m, v in zip(*model.value, strict=True):
            node = np.ones(len(x), dtype=np.int64)
            while (inner := f[node] >= 0).any():
                k = node[inner]
                values = x[row[inner], f[k]]
                node[inner] = 2 * k + ~np.where(np.isnan(values), m[k], values <= c[k])
            total += v[node]
        return pd.Series(total)

    return df.withColumn(name, predict(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))
