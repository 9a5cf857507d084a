"""Registered queries against their SQL on the smallest tables. QUARRYMILL_ALL=1 runs every one of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarrymill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = (
    "clean_columns derive_chain flagship_clean quarantine vw_kpi_summary vw_category_performance measure_cube dq_funnel reconcile "
    "brand_category_pivot price_vs_median argmax_leaders reason_exploded filter_pane_values inject_duplicates corrupt_price "
    "corrupt_date write_raw ml_encode anomaly_threshold sample_stratified burst_by_recipient synth_catalog dims scan_csv_gz scan_drift "
    "sample_fixed split_train_test weighted_choice golden_values fetch_window sort_measure aggregate_by_name shuffle_rows "
    "kpi_recon detail_vs_total golden_published recipient_extracts segment_assign forest_nodes ml_anomaly_score anomaly_review clean_from_files"
).split()
NAMES = list(registry.oracle_sql()) if os.environ.get("QUARRYMILL_ALL") else SOME


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return str(v)


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small_dir, duck, name):
    df = registry.queries()[name](spark, small_dir)
    columns = sorted(df.columns)
    got = sorted(str([shown(r[c]) for c in columns]) for r in df.collect())
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert got == sorted(str([shown(r[p]) for p in places]) for r in relation.fetchall())
    assert got


def test_anomaly_queries_agree(spark, small_dir):
    scored = registry.queries()["ml_anomaly_score"](spark, small_dir)
    flagged = {r.product_id for r in scored.where("is_anomaly").collect()}
    assert 0 < len(flagged) <= 0.0051 * scored.count() + 1
    review = registry.queries()["anomaly_review"](spark, small_dir).collect()
    assert {r.product_id for r in review} <= flagged and len(review) == min(50, len(flagged))
    assert [r.score for r in review] == sorted(r.score for r in review)
    assert registry.queries()["ml_segments"](spark, small_dir).select("segment").distinct().count() == 4


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= 125 and e.oracle_sql()"
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
