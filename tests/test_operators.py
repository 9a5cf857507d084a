"""Lookups, samples, reports, models, sources."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quarrymill.operators import boosting, lookup, models, quality, reports, sampling
from quarrymill.sources import files


def test_lookup_never_fans_out(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "k string")
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "tk string, v int")
    rows = lookup.lookup_any(df, table, "k", "tk").collect()
    assert len(rows) == 4 and sorted(r.k or "" for r in rows if r.v is not None) == ["a", "a"]


def test_reconcile_reports_missing_sides(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.004), ("z", 2.0)], "k string, v double")
    assert {r.k: r.ok for r in lookup.reconcile(a, b, ["k"], "v", 0.01).collect()} == {"x": True, "y": False, "z": False}


def test_golden(spark):
    got = quality.golden(spark.createDataFrame([(1.0, None)], "a double, b double"), {"a": 1.0, "b": 2.0}, 0.001)
    assert {r.measure: r.ok for r in got.collect()} == {"a": True, "b": False}


def test_samples_are_exact_and_reproducible(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 100, "small").otherwise("large"))
    one = {r.id for r in sampling.fixed_size(df, "id", 50).collect()}
    assert one == {r.id for r in sampling.fixed_size(df.repartition(5), "id", 50).collect()} and len(one) == 50
    assert sampling.fixed_size(df, "id", 5000).count() == 1000
    sizes = {r.s: r["count"] for r in sampling.stratified(df, "s", "id", 0.1).groupBy("s").count().collect()}
    assert sizes == {"small": 10, "large": 90}
    train, test = sampling.split(df, "id")
    assert train.count() + test.count() == 1000 and 150 < test.count() < 250
    with pytest.raises(ValueError):
        sampling.stratified(df, "missing", "id", 0.1)
    drawn = {r.c: r["count"] for r in sampling.weighted_choice(df, "id", [("a", 3), ("b", 1)], "c").groupBy("c").count().collect()}
    assert abs(drawn["a"] - 750) < 60


def test_windows_over_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    assert {r.k: r.s for r in reports.share_of_total(df, "v", "s").collect()} == {"a": 0.25, "b": 0.75}
    assert {r.k: r.s for r in reports.minmax_scale(df, "v", "s", 0.15, 0.95).collect()} == pytest.approx({"a": 0.15, "b": 0.95})
    same = df.withColumn("v", F.lit(2.0))
    assert {r.s for r in reports.minmax_scale(same, "v", "s").collect()} == {0.0}


def test_mean_rounds_half_up_in_integers(spark):
    df = spark.createDataFrame([(1.0,), (1.01,), (None,)], "v double")
    assert str(df.agg(reports.mean2("v")).first()[0]) == "1.01"
    assert df.where("v is null").agg(reports.mean2("v")).first()[0] is None


def test_mean_of_negative_values(spark):
    for values, mean in ([-5.0], "-5.00"), ([-2.0, -1.0, -1.0], "-1.33"), ([-0.01, 0.0], "-0.01"), ([0.01, 0.0], "0.01"), ([-0.01, 0.01], "0.00"):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert str(df.agg(reports.mean2("v")).first()[0]) == mean


def test_quantiles_are_exact(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("k"),
        F.when(F.col("id") % 7 == 0, F.lit(-3.5)).when(F.col("id") % 11 != 0, sampling.uniform("id", 1) * 100).alias("v"),
    )
    for share in (0.0, 0.005, 0.1, 0.5, 0.999, 1.0):
        want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.lit(share)).alias("q")).collect()}
        assert {r["_group"]: r["quantile"] for r in reports.quantiles(df, "v", share, "k").collect()} == pytest.approx(want)
    one = spark.createDataFrame([(4.0,)], "v double")
    assert [r["quantile"] for r in reports.quantiles(one, "v", 0.5).collect()] == [4.0]
    assert reports.quantiles(one.where("v is null"), "v", 0.5).count() == 0


def test_order_and_windows_of_results(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None), ("e", 2.0)], "k string, v double")
    assert [r.k for r in reports.descending(df, "v", "k").collect()] == ["b", "c", "e", "a", "d"]
    assert [r.k for r in reports.window(df, "v", 1, 2, "k").collect()] == ["c", "e"]
    assert reports.window(df, "v", 9, 2, "k").count() == 0
    got = lookup.aggregate_row(spark.createDataFrame([("a",), ("z",)], "k string"), df, "k")
    assert {r.k: r.v for r in got.collect()} == {"a": 1.0, "z": None}


def test_sample_of_a_hot_stratum_and_ties(spark):
    df = spark.range(5000).select((F.col("id") % 50).alias("id"), F.when(F.col("id") > 20, "hot").alias("s"))
    sizes = {r.s: r["count"] for r in sampling.stratified(df, "s", "id", 0.3).groupBy("s").count().collect()}
    assert sizes == {"hot": 1494, None: 6}
    assert sampling.fixed_size(df, "id", 77).count() == 77 and sampling.fixed_size(df.limit(0), "id", 5).count() == 0
    order = [r.id for r in sampling.shuffled(spark.range(100), "id").collect()]
    assert sorted(order) == list(range(100)) and order != sorted(order)
    assert order == [r.id for r in sampling.shuffled(spark.range(100).repartition(3), "id").collect()]


def catalog(spark, n=3000):
    u = lambda s: sampling.uniform("id", s)
    df = spark.range(n).select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("product_id"),
        F.lit("n").alias("product_name"),
        F.lit("c").alias("category"),
        F.lit("b").alias("brand"),
        (50 + 10 * u(1)).alias("price_zar"),
        (30 + 5 * u(2)).alias("cost_zar"),
        (30 + 10 * u(3)).alias("margin_pct"),
        (0.5 + u(4)).alias("weight_kg"),
        F.round(100 * u(5)).cast("int").alias("units_sold_12m"),
        (5 * u(6)).alias("rating"),
    )
    odd = F.col("product_id").isin("P7", "P70", "P700")
    return df.withColumn("price_zar", F.when(odd, 900.0).otherwise(F.col("price_zar"))).withColumn(
        "weight_kg", F.when(odd, 40.0).otherwise(F.col("weight_kg"))
    )


def test_forest_finds_planted_outliers(spark):
    found = models.anomalies(catalog(spark), trees=50)
    rows = found.collect()
    assert {"P7", "P70", "P700"} <= {r.product_id for r in rows}
    assert len(rows) == 15  # the lowest 0.5 per cent
    assert models.isolation_forest(catalog(spark).limit(0), models.ANOMALY).count() == 0


def test_price_model_learns_and_takes_missing_numbers(spark):
    df = catalog(spark, 1500).select("product_id", "weight_kg", "rating", "units_sold_12m").withColumns(
        {k: F.lit("x") for k in models.CATEGORICAL if k != "category"}
    )
    missing = F.col("units_sold_12m") % 5 == 0
    df = df.withColumns({
        "category": F.when(F.col("rating") > 2.5, "dear").otherwise("cheap"),
        "stock_qty": F.when(~missing, F.col("units_sold_12m")),
        "price_zar": F.when(F.col("rating") > 2.5, 90.0).otherwise(30.0) + F.when(missing, 20.0).otherwise(0.0),
    })
    _, predicted = models.price_model(df, settings=boosting.Settings(rounds=30, rate=0.3))
    row = models.regression_metrics(predicted, "price_zar", "prediction").first()
    assert row.r2 > 0.95 and row.n == predicted.count() > 200


def test_segments_and_standardising(spark):
    df = catalog(spark, 400)
    out = models.segments(df, restarts=2)
    assert out.count() == 400 and out.select("segment").distinct().count() == 4
    z = models.standardised(df.withColumn("flat", F.lit(1.0)), ["rating", "flat"])
    mean, sd, flat = z.agg(F.avg("rating_z"), F.stddev_pop("rating_z"), F.max("flat_z")).first()
    assert abs(mean) < 1e-9 and abs(sd - 1) < 1e-9 and flat == 0.0


def test_codes_of_unseen_values(spark):
    train = spark.createDataFrame([("b",), ("a",)], "k string")
    model = models.ordinal(train, ["k"])
    new = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert [r.k_code for r in models.encoded(new, model, ["k"]).collect()] == [0, 1, -1, -1]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', "1"), (None, "2")], "a string, b string")
    files.write_delimited(df, str(tmp_path / "gz"), compression="gzip")
    back = files.scan_delimited(spark, str(tmp_path / "gz/*.csv.gz"), ["a", "b"], partitions=3)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(AnalysisException):
        files.scan_delimited(spark, str(tmp_path / "none/*.csv"), ["a"]).count()
    files.write_delimited(df.select("b", F.lit("x").alias("added")), str(tmp_path / "drift"))
    drift = files.scan_with_drift(spark, [str(tmp_path / "gz"), str(tmp_path / "drift")], ["a", "b", "c"])
    assert drift.columns == ["a", "b", "c", "added"] and drift.count() == 4
    padded = spark.createDataFrame([(" x ", "y")], "a string, b string")
    files.write_delimited(padded, str(tmp_path / "padded"))
    assert [r.a for r in files.scan_delimited(spark, str(tmp_path / "padded"), ["a", "b"]).collect()] == [" x "]
    hot = spark.range(400).select(F.when(F.col("id") < 390, "hot").otherwise("cold").alias("r"), "id")
    files.write_by_recipient(hot, "r", str(tmp_path / "burst"), spread=4)
    assert spark.read.parquet(str(tmp_path / "burst")).groupBy("r").count().count() == 2
    assert 1 <= len(list((tmp_path / "burst" / "r=hot").glob("*.parquet"))) <= 4
