"""Reports over the clean table: views, named measures, windows over aggregates, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quarrymill.sources import files


def everything() -> WindowSpec:
    """All rows of an aggregate with one row per group."""
    return W.partitionBy()


def money(x: str | Column) -> Column:
    """Exact sum of a two-decimal double: independent of the order of rows."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x.cast("decimal(18,2)")).cast("decimal(18,2)")


def mean2(x: str | Column, kind: str = "decimal(9,2)") -> Column:
    """Mean of a two-decimal double, rounded to two decimals in integers; a half goes away from zero. Null without values."""
    x = F.col(x) if isinstance(x, str) else x
    total, n = F.sum(F.round(x * 100).cast("bigint")), F.count(x)
    cents = F.call_function("div", F.abs(total) * 2 + n, F.nullif(n * 2, F.lit(0)))
    signed = F.when(total < 0, -cents).otherwise(cents)
    return (signed.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(kind)


def active(flag: str = "is_active") -> Column:
    return F.count_if(F.col(flag))


def distinct_and_marked(df: DataFrame, key: str, flag: str, name: str, marked: str) -> DataFrame:
    """Distinct values of the key, and those of them with a row where the flag holds; each value moves once for both."""
    values = df.groupBy(key).agg(F.max(flag).alias("_marked"))
    return values.agg(F.count(key).alias(name), F.count(F.when(F.col("_marked"), F.col(key))).alias(marked))


def kpis() -> list[Column]:
    """The headline figures as aggregates; rows without an id count for none of them."""
    return [
        F.count("product_id").alias("total_skus"),
        active().alias("active_skus"),
        money("revenue_12m_zar").alias("revenue_12m_zar"),
        mean2("margin_pct").alias("avg_margin_pct"),
        mean2("price_zar").alias("avg_price_zar"),
        mean2("rating", "decimal(4,2)").alias("avg_rating"),
        F.sum(F.col("stock_qty").cast("bigint")).alias("total_stock_units"),
    ]


def kpi_summary(clean: DataFrame) -> DataFrame:
    return clean.agg(*kpis())


def performance(clean: DataFrame, dims: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Named figures by dimensions; null dimensions are a group of their own."""
    every = {
        "sku_count": F.count(F.lit(1)),
        "revenue_12m_zar": money("revenue_12m_zar"),
        "avg_margin_pct": mean2("margin_pct"),
        "avg_price_zar": mean2("price_zar"),
        "avg_rating": mean2("rating", "decimal(4,2)"),
    }
    return clean.groupBy(*dims).agg(*[every[n].alias(n) for n in names])


def category_performance(clean: DataFrame) -> DataFrame:
    names = ["sku_count", "revenue_12m_zar", "avg_margin_pct", "avg_price_zar", "avg_rating"]
    return performance(clean, ["product_group", "category"], names)


def brand_performance(clean: DataFrame) -> DataFrame:
    return performance(clean, ["brand_solution", "brand"], ["sku_count", "revenue_12m_zar", "avg_margin_pct", "avg_rating"])


def dimension_performance(clean: DataFrame, dim: str, keep_nulls: bool = True) -> DataFrame:
    """Rows, revenue and margin by one dimension; without nulls they are missing from the total."""
    rows = clean if keep_nulls else clean.where(F.col(dim).isNotNull())
    return performance(rows, [dim], ["sku_count", "revenue_12m_zar", "avg_margin_pct"])


def reason_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("row_count"))


def month_of(date: str) -> Column:
    return F.date_format(date, "yyyy-MM")


def catalog_growth(clean: DataFrame) -> DataFrame:
    return clean.groupBy(month_of("date_added").alias("month")).agg(F.count(F.lit(1)).alias("products_added")).orderBy("month")


def measures() -> dict[str, Column]:
    """Named measures on the row level."""
    return {
        "revenue": money("revenue_12m_zar"),
        "total_skus": F.count_distinct("product_id"),
        "active_skus": F.count_distinct(F.when(F.col("is_active"), F.col("product_id"))),
        "avg_margin_pct": mean2("margin_pct"),
        "avg_price": mean2("price_zar"),
        "avg_rating": mean2("rating", "decimal(4,2)"),
        "stock_units": F.sum(F.col("stock_qty").cast("bigint")),
        "units_sold": F.sum(F.col("units_sold_12m").cast("bigint")),
        "revenue_per_sku": F.try_divide(F.sum(F.col("revenue_12m_zar").cast("decimal(18,2)")).cast("double"), F.count_distinct("product_id").cast("double")),
    }


def cube_query(df: DataFrame, dims: Sequence[str], names: Sequence[str], selections: dict[str, Sequence] | None = None) -> DataFrame:
    """Named measures by any dimensions under selections: values within a field are alternatives, fields are all required."""
    known = measures()
    rows = select_values(df, selections or {})
    return rows.groupBy(*dims).agg(*[known[n].alias(n) for n in names])


def select_values(df: DataFrame, selections: dict[str, Sequence]) -> DataFrame:
    for field, values in selections.items():
        df = df.where(F.col(field).isin(*values))
    return df


def pane_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct values of each field as text, with their counts: one pass for all fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def without_blank(df: DataFrame, dim: str) -> DataFrame:
    return df.where(F.length(F.trim(dim)) > 0)


def share_of_total(grouped: DataFrame, value: str, name: str) -> DataFrame:
    """Each group's share of the sum over all groups; the input is an aggregate with one row per group."""
    total = F.sum(F.col(value).cast("double")).over(everything())
    return grouped.withColumn(name, F.try_divide(F.col(value).cast("double"), total))


def ratio_to_max(grouped: DataFrame, value: str, name: str) -> DataFrame:
    return grouped.withColumn(name, F.try_divide(F.col(value).cast("double"), F.max(F.col(value).cast("double")).over(everything())))


def minmax_scale(grouped: DataFrame, value: str, name: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Value scaled to low..high; low where all values are equal."""
    x = F.col(value).cast("double")
    least, most = F.min(x).over(everything()), F.max(x).over(everything())
    share = F.coalesce(F.try_divide(x - least, most - least), F.lit(0.0))
    return grouped.withColumn(name, low + (high - low) * share)


def weighted_average(grouped: DataFrame, values: Sequence[str], weight: str) -> DataFrame:
    """Averages of group averages, weighted by the groups' counts."""
    w = F.col(weight).cast("decimal(18,0)")
    return grouped.agg(
        *[
            F.try_divide(F.sum(F.col(v) * w).cast("double"), F.sum(w).cast("double")).alias(f"weighted_{v}")
            for v in values
        ]
    )


#: Accuracy of the sketch that brackets an exact quantile, and the share of ranks on either side of it that is looked at.
SKETCH, BRACKET = 10_000, 0.0005


def quantiles(df: DataFrame, value: str, share: float, group: str | None = None) -> DataFrame:
    """Exact quantile of a column (linear between neighbours) by group: columns _group, quantile; nulls are left out.

    A sketch gives two bounds that the quantile lies between; only values between them, some thousandth of a group, are
    counted one by one. No group's values meet in one buffer. The bounds, one row per group, are written: Spark then knows
    their size and broadcasts them below spark.sql.autoBroadcastJoinThreshold, so that no row moves; beyond it both sides
    are shuffled by group.
    """
    g = F.col(group) if group else F.lit(0)
    rows = df.select(g.alias("_group"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    ends = [max(0.0, share - BRACKET), min(1.0, share + BRACKET)]
    bounds = rows.groupBy("_group").agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, SKETCH).alias("_b")
    )
    bounds = bounds.select(
        F.col("_group").alias("_key"), ((F.col("_n") - 1) * share).alias("_at"), F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high")
    )
    bounds = files.sized(bounds, "groups")
    # The values below the bracket count as one value.
    met = rows.join(bounds, F.col("_group").eqNullSafe(F.col("_key"))).where("_v <= _high")
    counted = met.groupBy("_group", "_at", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    until = F.sum("_c").over(W.partitionBy("_group").orderBy(F.col("_v").asc_nulls_first()))
    ranked = counted.withColumn("_until", until)
    below, above = F.floor("_at"), F.ceil("_at")
    out = ranked.groupBy("_group", "_at").agg(
        F.min(F.when(F.col("_until") > below, F.col("_v"))).alias("_lower"), F.min(F.when(F.col("_until") > above, F.col("_v"))).alias("_upper")
    )
    between = (above - F.col("_at")) * F.col("_lower") + (F.col("_at") - below) * F.col("_upper")
    return out.select("_group", F.when(below == above, F.col("_lower")).otherwise(between).alias("quantile"))


def versus_group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's value against its group's median: the medians are grouped and joined back."""
    medians = files.sized(quantiles(df, value, 0.5, group).withColumnRenamed("quantile", "group_median"), "groups")
    out = df.join(medians, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return out.withColumn("deviation", F.col(value) - F.col("group_median"))


def top(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def window(df: DataFrame, by: str, offset: int, n: int, tie: str) -> DataFrame:
    """Rows offset + 1 to offset + n of the result by a measure, greatest first."""
    return df.orderBy(F.desc(by), tie).offset(offset).limit(n)


def descending(df: DataFrame, by: str, tie: str) -> DataFrame:
    """All rows by a measure, greatest first, nulls last."""
    return df.orderBy(F.col(by).desc_nulls_last(), tie)


def smallest(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.asc(by), tie).limit(n)


def leaders(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """Each dimension's value with the greatest sum: dimension, leader, total. One scan for all dimensions; ties by name."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("leader")) for d in dims])
    rows = df.select(F.col(value), F.inline(pairs)).where("leader IS NOT NULL")
    sums = rows.groupBy("dimension", "leader").agg(money(value).alias("total"))
    # Nulls (no value at all in a group) come last.
    best = F.min(F.struct(F.col("total").isNull(), (-F.col("total")).alias("less"), "leader", "total"))
    return sums.groupBy("dimension").agg(best.alias("best")).select("dimension", "best.leader", "best.total")


def cross_tab(clean: DataFrame) -> DataFrame:
    return performance(clean, ["brand", "category"], ["revenue_12m_zar", "avg_margin_pct", "sku_count", "avg_rating"])


def pivoted(df: DataFrame, row: str, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """Wide form: one column of summed measure per listed value (listing them saves a pass)."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(money(measure))
    return wide.select(row, *[F.col(f"`{v}`").alias(v.lower()) for v in values])


def segment_profile(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Count, means and revenue per segment."""
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("products"),
        mean2("price_zar").alias("avg_price"),
        mean2("margin_pct").alias("avg_margin_pct"),
        mean2("units_sold_12m", "decimal(18,2)").alias("avg_units_12m"),
        mean2("rating").alias("avg_rating"),
        money("revenue_12m_zar").alias("revenue_12m"),
    )


def anomaly_review(anomalies: DataFrame, by_name: bool = False, n: int = 50) -> DataFrame:
    """Sums by product (or by product name, as the review sheet shows them), lowest score first."""
    dims = ["product_name", "category", "brand"] + ([] if by_name else ["product_id"])
    return (
        anomalies.groupBy(*dims)
        .agg(
            money("price_zar").alias("price"),
            money("cost_zar").alias("cost"),
            (F.sum("margin_pct") / 100).alias("margin"),
            F.sum("anomaly_raw").alias("score"),
        )
        .orderBy("score", *dims)
        .limit(n)
    )
