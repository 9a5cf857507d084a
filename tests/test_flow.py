"""The cleaning flow: split before deduplication, ties, determinism, plan shape."""

from pyspark.sql import functions as F

from quarrymill.plans import cleaning as flow
from quarrymill.sources import files
from quarrymill.sources import fixtures as fx
from quarrymill.streaming import ingest

BRANDS = [("salt & co", "Salt & Co", "House", "Dairy", "Perishable products")]


def raw_row(**values):
    base = dict.fromkeys(flow.RAW_COLUMNS, "") | {
        "product_id": "P1", "brand": "Salt and Co", "category": "dairy", "price_zar": "R 10.00", "cost_zar": "6.00",
        "date_added": "2023-01-01", "units_sold_12m": "2.0",
    }
    return tuple((base | values)[c] for c in flow.RAW_COLUMNS)


def frames(spark, rows):
    raw = spark.createDataFrame(rows, files.text_schema(flow.RAW_COLUMNS))
    return raw, spark.createDataFrame(BRANDS, files.text_schema(flow.BRAND_MAP_COLUMNS))


def test_invalid_later_row_evicts_no_valid_older_one(spark):
    raw, brands = frames(spark, [raw_row(), raw_row(date_added="2024-01-01", price_zar="N/A")])
    clean, quarantine = flow.clean_catalog(raw, brands)
    assert [(r.product_id, r.price_zar, r.revenue_12m_zar, r.margin_pct) for r in clean.collect()] == [("P1", 10.0, 20.0, 40.0)]
    assert [(r.product_id, r.price_zar, r.reject_reason) for r in quarantine.collect()] == [("P1", "N/A", "bad_price;")]


def test_latest_row_stays_and_repeats_collapse(spark):
    raw, brands = frames(spark, [raw_row(), raw_row(), raw_row(date_added="02/01/2023", price_zar="11")])
    assert [r.price_zar for r in flow.clean_catalog(raw, brands)[0].collect()] == [11.0]


def test_legacy_category_falls_back_to_the_brand(spark):
    raw, brands = frames(spark, [raw_row(category="Groceries"), raw_row(product_id="P2", category="Groceries", brand="NULL")])
    clean, quarantine = flow.clean_catalog(raw, brands)
    assert [r.category for r in clean.collect()] == ["Dairy"]
    assert [r.reject_reason for r in quarantine.collect()] == ["unknown_brand;unknown_category;"]


def test_empty_input(spark):
    raw, brands = frames(spark, [])
    assert [df.count() for df in flow.clean_catalog(raw, brands)] == [0, 0]


def test_same_result_for_any_partitioning(spark, small_dir):
    raw = fx.dirty_catalog(spark, small_dir)
    brands = fx.brands(spark, small_dir)
    seen = set()
    for n in (1, 7):
        clean, _ = flow.clean_catalog(raw.repartition(n), brands, fx.RULES)
        seen.add(tuple(clean.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*clean.columns).cast("decimal(38,0)"))).first()))
    assert len(seen) == 1


def test_plan_has_one_shuffle_of_the_records_and_no_python(spark, tmp_path):
    raw, brands = frames(spark, [raw_row()])
    files.write_delimited(raw, str(tmp_path / "raw"))
    files.write_delimited(brands, str(tmp_path / "brands"))
    raw = files.scan_delimited(spark, str(tmp_path / "raw"), flow.RAW_COLUMNS)
    brands = files.scan_delimited(spark, str(tmp_path / "brands"), flow.BRAND_MAP_COLUMNS)
    plan = flow.clean_catalog(raw, brands)[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan and "EvalPython" not in plan
    assert plan.count("Exchange hashpartitioning(pid") == 1


def test_shares_match_the_corruption_rates(spark, small_dir):
    flags = flow.flagged(fx.dirty_catalog(spark, small_dir), fx.brands(spark, small_dir), fx.RULES)
    n, good = flags.agg(F.count(F.lit(1)), F.count_if("is_valid")).first()
    assert abs(good / n - 0.95 * 0.93 * 0.97) < 0.02
    reasons = {r.reject_reason for r in flags.select("reject_reason").distinct().collect()}
    assert not any("unknown_category" in r and "unknown_brand" not in r for r in reasons)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    raw, brands = frames(spark, [raw_row(), raw_row(date_added="2024-01-01"), raw_row(product_id="P2", price_zar="NULL")])
    files.write_delimited(raw.repartition(2), str(tmp_path / "in"), compression="gzip")
    stream = ingest.landing(spark, str(tmp_path / "in"), 1)
    ingest.clean_stream(stream, brands, flow.CatalogRules(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = [tuple(r) for r in ingest.latest(spark, str(tmp_path / "out")).collect()]
    landed = files.scan_delimited(spark, str(tmp_path / "in/*.csv.gz"), flow.RAW_COLUMNS)
    assert got == [tuple(r) for r in flow.clean_catalog(landed, brands)[0].collect()] and got
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1
