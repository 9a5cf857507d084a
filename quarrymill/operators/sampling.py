"""Samples that depend on keys and a seed alone: reproducible across partitionings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.sources import files

#: Bits of the hash that orders rows, and bits that one level of its histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def draw(key: str | Column, seed: int) -> Column:
    """60 bits of the MD5 of the key's text and the seed, so that other engines draw the same; a null key counts as empty."""
    text = F.concat_ws(":", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def uniform(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) from the key."""
    return F.pmod(draw(key, seed), F.lit(1 << 40)).cast("double") / float(1 << 40)


def least_by_hash(
    df: DataFrame, key: str, want: Callable[[Column], Column], seed: int, stratum: str | None = None, few: bool = False
) -> DataFrame:
    """The rows with the least hashes, as many of each stratum as want makes of its size; equal hashes by key.

    Two levels of a histogram of the hash find the bucket (a share of 2^-24 of a stratum) in which the wanted number ends.
    Rows below it are taken by a filter; only the bucket's rows are ranked. No stratum is sorted or gathered. The edges, one
    row per stratum, are written: Spark then knows their size, so that no row moves to meet them. few: the wanted rows are
    few, and are written with those of the first level's bucket (a share of 2^-12), so that the rest passes twice only.
    """
    kind = F.col(stratum) if stratum else F.lit(0)
    # The hash is never null; Spark, told so, doesn't take it once more for a test on null.
    rows = df.withColumns({"_stratum": kind, "_h": F.coalesce(draw(key, seed), F.lit(0))})
    same = F.col("_stratum").eqNullSafe(F.col("_s"))
    whole = W.partitionBy("_stratum")
    coarse, fine = (F.shiftright("_h", HASH_BITS - k * LEVEL_BITS) for k in (1, 2))
    first = rows.groupBy("_stratum", coarse.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    first = first.withColumns({"_until": F.sum("_n").over(whole.orderBy("_b")), "_want": want(F.sum("_n").over(whole)).cast("long")})
    edge = first.where("_until >= _want and _until - _n < _want").select(
        F.col("_stratum").alias("_s"), F.col("_b").alias("_edge"), (F.col("_want") - F.col("_until") + F.col("_n")).alias("_rest")
    )
    near = rows.join(files.sized(edge, "edge"), same & (coarse <= F.col("_edge"))).drop("_s")
    if few:
        near = files.sized(near, "near")
    second = near.where(coarse == F.col("_edge")).groupBy("_stratum", "_rest", fine.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    second = second.withColumn("_until", F.sum("_n").over(whole.orderBy("_b")))
    edge = second.where("_until >= _rest and _until - _n < _rest").select(
        F.col("_stratum").alias("_s"), F.col("_b").alias("_edge"), (F.col("_rest") - F.col("_until") + F.col("_n")).alias("_rest")
    )
    near = near.drop("_edge", "_rest").join(files.sized(edge, "edge"), same & (fine <= F.col("_edge")))
    last = fine == F.col("_edge")
    rank = F.row_number().over(whole.orderBy("_h", key))
    edged = near.where(last).withColumn("_rank", rank).where("_rank <= _rest").select(*df.columns)
    return near.where(~last).select(*df.columns).union(edged)


def fixed_size(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows."""
    return least_by_hash(df, key, lambda size: F.least(size, F.lit(n)), seed, few=True)


def stratified(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """round(fraction * size) rows of each stratum; null is a stratum. Raises if the stratum column is missing."""
    if stratum not in df.columns:
        raise ValueError(f"no column {stratum}")
    return least_by_hash(df, key, lambda size: F.round(size * F.lit(float(fraction))), seed, stratum)


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the key's hash: rows of one key are on one side."""
    test = uniform(key, seed) < test_share
    return df.where(~test), df.where(test)


def weighted_choice(df: DataFrame, key: str, choices: Sequence[tuple[str, float]], name: str, seed: int = 42) -> DataFrame:
    """Adds a value drawn by weight from a short list, by the key's hash."""
    total = sum(w for _, w in choices)
    u, reached = uniform(key, seed), 0
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, weight in choices[:-1]:
        reached += weight
        out = out.when(u < reached / total, value)
    return df.withColumn(name, out.otherwise(choices[-1][0]))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in an order that only the keys and the seed decide."""
    return df.orderBy(draw(key, seed), key)
