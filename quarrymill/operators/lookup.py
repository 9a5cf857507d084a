"""Lookups, first and latest rows per key, reconciliation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup_any(df: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
    """Left outer lookup with one match at most per row; rows without a match keep nulls.

    One row per key is ensured first, so df never fans out. Spark broadcasts the table while its size is below
    spark.sql.autoBroadcastJoinThreshold, and joins by a shuffle that splits skewed keys beyond it.
    """
    single = table.where(F.col(table_key).isNotNull()).dropDuplicates([table_key])
    return df.join(single, df[key] == single[table_key], "left")


def latest_per_key(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row of each key with the greatest value of by (nulls first); ties by the other columns, descending.

    Spark keeps one row per key and task before the shuffle (WindowGroupLimit), so hot keys shrink first.
    """
    order = [F.col(by).desc_nulls_first(), *[F.col(t).desc_nulls_last() for t in ties]]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def brand_map(parts: DataFrame, brand: str, category: str, order: str, solutions: Sequence[str], groups: DataFrame) -> DataFrame:
    """Lookup table of brands: key, brand, solution, primary (first) category and its group.

    A brand's solution goes by the number in its name, modulo the number of solutions.
    """
    first = first_per_key(parts.select(brand, category, order), [brand], [order])
    number = F.regexp_extract(F.col(brand), "([0-9]+)", 1).try_cast("int")
    names = F.array(*map(F.lit, solutions))
    return first.join(groups, first[category] == groups["category"], "inner").select(
        F.lower(brand).alias("bm_brand_key"),
        F.col(brand).alias("bm_brand"),
        F.element_at(names, (F.pmod(number, F.lit(len(solutions))) + 1).cast("int")).alias("bm_brand_solution"),
        F.col(category).alias("bm_primary_category"),
        F.col("product_group").alias("bm_product_group"),
    )


def explode_bridge(df: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """One row per element of an array column."""
    return df.select(key, F.explode(values).alias(name))


def map_value(df: DataFrame, key: str, table: dict[str, float], name: str) -> DataFrame:
    """Adds a value looked up in a small literal map; null where the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(key)))


def aggregate_row(keys: DataFrame, aggregate: DataFrame, key: str) -> DataFrame:
    """For every key the aggregate's row of that name, nulls where it has none; the aggregate has one row per key."""
    return keys.join(aggregate, key, "left")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], measure: str, tolerance: float) -> DataFrame:
    """Full outer join of a measure from two sources: expected, actual and ok (within the tolerance; a missing side isn't)."""
    a = left.select(*keys, F.col(measure).alias("expected"))
    b = right.select(*keys, F.col(measure).alias("actual"))
    within: Column = F.abs(F.col("expected") - F.col("actual")) <= tolerance
    return a.join(b, list(keys), "full").withColumn("ok", F.coalesce(within, F.lit(False)))
