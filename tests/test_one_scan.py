"""Figures of one flow come from one scan, joins of small tables move no rows, and bounds go by size."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import quality, reports
from quarrymill.plans import cleaning as flow
from quarrymill.plans import registry
from quarrymill.sources import files
from quarrymill.sources import fixtures as fx


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dq_funnel", "argmax_leaders", "kpi_recon", "detail_vs_total", "golden_values", "golden_published"])
def test_one_scan_of_the_raw_table(spark, small_dir, name):
    text = plan(registry.queries()[name](spark, small_dir)).split("== Initial Plan ==")[0]
    raw = registry.raw_path(spark, small_dir)
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "sales_channel" in line or "FileScan" in line and "is_active" in line or "FileScan parquet [product_id" in line]
    assert len(scans) == 1, (raw, scans)


def test_reconciliation_reads_the_flow_once(spark, small_dir):
    text = plan(registry.queries()["reconcile"](spark, small_dir))
    assert "product_id" not in text  # the flow ran before, into the table that is joined with itself


def test_clean_and_rejected_are_the_flow_s_own(spark, small_dir):
    cat = registry.Catalog(spark, small_dir)
    both = flow.clean_and_rejected(cat.flags)
    clean = both.where("product_id IS NOT NULL").drop("rejected")
    assert clean.exceptAll(cat.clean).isEmpty() and cat.clean.exceptAll(clean).isEmpty()
    assert both.agg(F.sum("rejected")).first()[0] == cat.quarantine.count()
    assert flow.with_latest(cat.flags).where("is_latest").count() == cat.clean.count()


def test_leaders(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), (None, "y", 5.0), ("c", None, None)], "p string, q string, v double")
    got = {r.dimension: (r.leader, float(r.total)) for r in reports.leaders(df, ["p", "q"], "v").collect()}
    assert got == {"p": ("a", 1.0), "q": ("y", 5.0)}


def test_bounds_go_by_size(spark, small_dir):
    rows = {r.measure: r for r in registry.queries()["golden_values"](spark, small_dir).collect()}
    assert set(rows) == {"bad_price", "bad_date", "unknown_brand", "rejected_rows"} and all(r.ok for r in rows.values())
    one = spark.createDataFrame([(10_000, 400)], "n long, bad long")
    got = quality.rate_bounds(one, "n", {"bad": 0.05}).first()
    assert (got.expected, got.ok) == (500.0, True) and got.high - 500 == pytest.approx(5 * (10_000 * 0.05 * 0.95) ** 0.5)
    assert not quality.rate_bounds(spark.createDataFrame([(10_000, 380)], "n long, bad long"), "n", {"bad": 0.05}).first().ok
    assert 0.13 < fx.reject_rates()["rejected_rows"] < 0.17


def test_brackets_and_medians_move_no_rows(spark):
    df = spark.range(3000).select(F.pmod("id", F.lit(3)).alias("k"), F.sqrt("id").alias("v"), "id")
    text = plan(reports.versus_group_median(df, "k", "v"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_one_scan_for_each_header(spark, tmp_path):
    """300 files with three headers, some quoted, some compressed."""
    heads = ['a,b', 'b,"c, d"', "a"]
    for k in range(300):
        head = heads[k % 3]
        width = 1 if k % 3 == 2 else 2
        (tmp_path / f"part-{k:03}.csv").write_text(f"{head}\n" + ",".join([f"v{k}"] * width) + "\n")
    files.write_delimited(spark.createDataFrame([("z",)], "b string"), str(tmp_path / "more"), compression="gzip")
    (tmp_path / "empty.csv").write_text("")
    df = files.scan_with_drift(spark, [f"{tmp_path}/*.csv", f"{tmp_path}/more"], ["a", "b", "e"])
    assert df.columns == ["a", "b", "e", "c, d"] and df.count() == 301
    assert df.where("a IS NOT NULL").count() == 200 and df.where("`c, d` IS NOT NULL").count() == 100
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan csv" in line]
    assert len(scans) == 4
    with pytest.raises(FileNotFoundError):
        files.scan_with_drift(spark, [f"{tmp_path}/none*"], ["a"])


RECIPIENTS = [
    ("ann", "b", "1"), ("ann", "b", "2"), ("bob", "b", "2"), ("cy", "b", "2"), ("cy", "p", "x"), ("dan", "b", "1"), ("dan", "p", None),
    ("eve", "none", "1"), ("ann", "b", "1"),
]


def test_extracts_by_recipient(spark):
    df = spark.createDataFrame([(1, "1", "x"), (2, "2", "x"), (3, "2", "y"), (4, None, "x"), (5, "3", "x")], "id long, b string, p string")
    who = spark.createDataFrame(RECIPIENTS, "recipient string, field string, value string")
    got = {}
    for r in files.recipient_extracts(df, who, ["id"]).collect():
        got.setdefault(r.recipient, []).append((r.id, r.b, r.p))
    assert {k: sorted(v) for k, v in got.items()} == {
        "ann": [(1, "1", "x"), (2, "2", "x"), (3, "2", "y")], "bob": [(2, "2", "x"), (3, "2", "y")], "cy": [(2, "2", "x")],
    }
    assert files.recipient_extracts(df, who.limit(0), ["id"]).count() == 0


def test_the_raw_table_follows_all_its_sources(spark, tmp_path):
    import shutil

    for name in fx.RAW_SOURCES:
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    first = registry.raw_path(spark, str(tmp_path))
    assert registry.raw_path(spark, str(tmp_path)) == first
    spark.read.parquet(f"{tmp_path}/nation.parquet").limit(20).coalesce(1).write.parquet(f"{tmp_path}/less")
    shutil.copy(next((tmp_path / "less").glob("part-*.parquet")), tmp_path / "nation.parquet")
    assert registry.raw_path(spark, str(tmp_path)) != first
