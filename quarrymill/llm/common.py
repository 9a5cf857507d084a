"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.sources import files

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The file is removed when the application ends. batch: rows that Python gets at a time while this table is written, where
    rows are long; the session's own setting holds again afterwards.
    """
    spark = df.sparkSession
    path = files.scratch(spark)
    before = spark.conf.get(BATCH)
    try:
        if batch:
            spark.conf.set(BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is hot; so there are at most 1 / HOT of them.
HOT = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of many rows with the one row of their group, no hot group's rows in one task.

    groups: one row per key, size is its number of rows (it is dropped). Groups with more than the share HOT of all rows, at
    most 1 / HOT of them, are broadcast; the rows of all others are joined by a shuffle. Null keys match nothing.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > max(1, int(total * HOT))
    hot = F.broadcast(groups.where(is_hot).drop(size))
    cold = rows.join(F.broadcast(groups.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(groups.where(~is_hot).drop(size), key))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Arrow batches sorted by keys, regrouped so that no group of equal keys is cut.

    Holds one batch and one group at most.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held)
        last = whole.num_rows - 1
        same = np.ones(whole.num_rows, dtype=bool)
        for k in keys:
            column = whole[k].to_numpy()
            same &= column == column[last]
        first = int(np.argmax(same))  # sorted: the last group is a suffix
        if first:
            yield whole.slice(0, first)
            held = whole.slice(first).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups in a sorted table, and its length."""
    new = np.zeros(whole.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        column = whole[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), whole.num_rows)


def blocked_buckets(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Pairs of blocks for a self-join inside buckets, with no bucket whole in one task.

    Buckets of one row go. A bucket of n rows is cut into ceil(n / block) blocks by the member's hash and every pair of
    blocks becomes a group of about 2 * block rows at most: columns bi <= bj name the group, blk the row's own block.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_blocks")).cast("int")
    return (
        rows.join(sizes, keys)
        .withColumn("_blocks", blocks)
        .withColumn("blk", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("bi", F.least("blk", "_other"))
        .withColumn("bj", F.greatest("blk", "_other"))
        .drop("_n", "_blocks", "_other")
    )


#: Bytes of compared codes, or of vectors, that a task holds at a time.
HELD = 1 << 24
#: Groups of so many rows at most are compared many at a time.
SMALL = 64


def pairs_within(bounds: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i < j, of the pairs within groups, so many at a time that rows of width bytes fit HELD.

    Small groups of one size are taken together, larger ones row by row. Each yield is sorted by i.
    """
    most = max(1, HELD // max(1, width))
    sizes = np.diff(bounds)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        i, j = np.triu_indices(n, 1)
        starts = bounds[:-1][sizes == n]
        step = max(1, most // len(i))
        for at in range(0, len(starts), step):
            first = starts[at : at + step, None]
            yield (first + i).ravel(), (first + j).ravel()
    left, right, held = [], [], 0
    for k in np.flatnonzero(sizes > SMALL).tolist():
        s, e = int(bounds[k]), int(bounds[k + 1])
        for i in range(s, e - 1):
            left.append(np.full(e - i - 1, i))
            right.append(np.arange(i + 1, e))
            held += e - i - 1
            if held >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


class Forest:
    """Labels of one group's members; link() keeps the few edges that join separate parts."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        labels = self.label[others]
        mine = self.label[i]
        if (labels == mine).all():
            return
        parts, first = np.unique(labels, return_index=True)
        for part, at in zip(parts.tolist(), first.tolist(), strict=True):
            if part != self.label[i]:
                self.edges.append((i, int(others[at])))
                self.label[self.label == part] = self.label[i]

    def link_all(self, left: np.ndarray, right: np.ndarray) -> None:
        """Link pairs (left, right) that are sorted by left."""
        bounds = [*np.flatnonzero(np.diff(left, prepend=-1)).tolist(), len(left)]
        for s, e in zip(bounds, bounds[1:], strict=False):
            self.link(int(left[s]), right[s:e])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component, for edges (a, b) of longs: columns node, root.

    Alternates large-star and small-star steps, each a grouped minimum and a join (a hub's edges are joined by broadcast of
    the few hubs), until the edges are stars. Nothing but a count and a checksum reaches the driver. Nodes without an edge
    are absent. Null ends are ignored.
    """
    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.union(e.select("b", "a"))
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = join_groups(both.where("b > a"), low, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large)
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_groups(large, low, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.union(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("connected components didn't settle")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
