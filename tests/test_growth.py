"""What a query moves, and what one task reads, grows no faster than the tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import cleaning as C
from quarrymill.operators import reports, sampling
from quarrymill.plans import cleaning as flow
from quarrymill.plans import registry
from quarrymill.sources import files
from quarrymill.sources import fixtures as fx


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_the_raw_table_s_joins_have_one_shape_at_every_size(spark, small_dir):
    plan = fx.dirty_catalog(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("BroadcastHashJoin") == 1
    assert "hashpartitioning(id" not in plan and plan.count("Generate inline") == 4


def test_joined_rows_move_as_whole_numbers_and_dates(spark, small_dir):
    plans, moved = [fx.clean_base(spark, small_dir)._jdf.queryExecution().optimizedPlan()], []
    while plans:
        plan = plans.pop()
        below = [plan.children().apply(k) for k in range(plan.children().size())]
        if plan.nodeName() == "Join":
            moved += [b.output().apply(k).dataType().simpleString() for b in below for k in range(b.output().size())]
        plans += below
    assert len(moved) > 20 and set(moved) == {"bigint", "int", "date", "string"}


def test_distinct_values_move_once_for_all_figures(spark, small_dir):
    rows = [("a", True), ("a", None), ("b", False), ("b", None), ("c", None), ("", True), (None, True), ("d", False), ("d", True)]
    got = reports.distinct_and_marked(spark.createDataFrame(rows, "k string, f boolean"), "k", "f", "n", "m")
    assert got.collect() == [(5, 3)]
    assert reports.distinct_and_marked(spark.createDataFrame([], "k string, f boolean"), "k", "f", "n", "m").collect() == [(0, 0)]
    plan = registry.queries()["distinct_count"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


@pytest.mark.parametrize("name", ["display_format", "month_added", "derived_margin"])
def test_columns_of_the_flow_move_no_rows(spark, small_dir, name):
    df = registry.queries()[name](spark, small_dir)
    plan = executed(df)
    assert not any(x in plan for x in ("hashpartitioning", "rangepartitioning", "RoundRobin", "SortMergeJoin", "Window"))
    assert df.count() == spark.read.parquet(f"{small_dir}/lineitem.parquet").count()


def moved(spark, run):
    """Bytes that the stages of a run shuffle, spill and write. Spark keeps the last thousand stages: older ones aren't looked at."""
    bus, none = spark._jsc.sc(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        bus.listenerBus().waitUntilEmpty()
        found = bus.statusStore().stageList(None, False, False, none, None)
        return [found.apply(k) for k in range(found.size())]

    last = max([-1, *(s.stageId() for s in stages())])
    run()
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in stages() if s.stageId() > last)


def test_months_move_as_much_where_only_nations_are_small(spark, small_dir, tmp_path, monkeypatch):
    """The whole query, its raw table too: tables that pass Spark's threshold for a broadcast change nothing."""
    usual, got = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {}
    try:
        for name, threshold in (("usual", usual), ("low", "2600b")):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            monkeypatch.setattr(registry, "_RAW", {})
            months = registry.queries()["month_added"]
            got[name] = moved(spark, lambda: months(spark, small_dir).write.parquet(f"{tmp_path}/{name}"))  # noqa: B023
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert 200_000 < got["low"] < 1.05 * got["usual"], got
    one, other = [spark.read.parquet(f"{tmp_path}/{name}") for name in got]
    assert one.exceptAll(other).isEmpty() and one.count() == other.count()


def test_dates_are_parsed_by_the_format_that_they_may_have(spark):
    day = datetime.date(2023, 4, 9)
    texts = {"2023-04-09": day, "09/04/2023": day, "04-09-2023": day, "9/4/2023": None, "2023/04/09": None, "": None, "N/A": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = [F.coalesce(*[F.try_to_date("t", f) for f in C.DATE_FORMATS]).alias("plain"), C.multi_format_date(F.col("t")).alias("d")]
    assert {r.t: (r.plain, r.d) for r in df.select("t", *one).collect()} == {t: (d, d) for t, d in texts.items()}
    tried = df.where("t IS NOT NULL").select(sum(C.may_fit(F.col("t"), f).cast("int") for f in C.DATE_FORMATS).alias("n"))
    assert {r.n for r in tried.collect()} <= {0, 1}


def test_the_brand_map_is_a_table_of_known_size(spark, small_dir):
    plan = executed(registry.Catalog(spark, small_dir).brand_map)
    assert "FileScan parquet" in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["write_raw", "scan_csv_gz"])
def test_gzip_files_grow_in_number(spark, small_dir, monkeypatch, name):
    monkeypatch.setattr(registry, "CHUNK_ROWS", 500)
    df = registry.queries()[name](spark, small_dir)
    rows = spark.read.parquet(f"{small_dir}/lineitem.parquet").count()
    assert len(df.inputFiles()) >= rows / 500 > 4 and df.count() == rows


def test_the_flow_from_text_spreads_no_rows(spark, small_dir, monkeypatch):
    monkeypatch.setattr(registry, "_TEXT", {})
    monkeypatch.setattr(registry, "CHUNK_ROWS", 200)
    df = registry.queries()["clean_from_files"](spark, small_dir)
    assert "RoundRobinPartitioning" not in executed(df)
    assert len(df.inputFiles()) >= spark.read.parquet(f"{small_dir}/lineitem.parquet").count() / 200


def test_medians_and_segments_read_narrow_rows_that_are_written_once(spark, small_dir, monkeypatch):
    df = registry.queries()["price_vs_median"](spark, small_dir)
    assert "Generate" not in executed(df)
    written = []
    plain = files.write_parquet
    monkeypatch.setattr(files, "write_parquet", lambda df, path: (written.append((path.rpartition("/")[2], df.columns)), plain(df, path)))
    registry.queries()["ml_segments"](spark, small_dir)
    assert dict(written)["segment_rows"] == ["product_id", "price_zar", "margin_pct", "units_sold_12m", "rating"]


def test_rejected_rows_move_empty_and_apart(spark, small_dir):
    both = flow.clean_and_rejected(registry.Catalog(spark, small_dir).flags)
    plan = executed(both)
    assert "WindowGroupLimit" in plan and "max_by" not in plan
    apart = both.where("rejected > 0")
    assert apart.count() > 1 and apart.where("product_id IS NOT NULL OR is_active IS NOT NULL OR stock_qty IS NOT NULL").isEmpty()


def test_typed_columns_are_parsed_a_few_at_a_time(spark, small_dir):
    plan = executed(registry.Catalog(spark, small_dir).cleaned)
    assert plan.count("Generate inline") == 4


def test_rows_walk_down_the_trees_once(spark, small_dir, monkeypatch):
    written, plain = {}, files.write_parquet
    monkeypatch.setattr(files, "write_parquet", lambda df, path: (written.update({path.rpartition("/")[2]: df.columns}), plain(df, path)))
    plan = executed(registry.queries()["ml_anomaly_score"](spark, small_dir))
    assert "EvalPython" not in plan and "Generate" not in plan
    assert written["forest_rows"] == ["product_id", "price_zar", "cost_zar", "margin_pct", "weight_kg"] and written["scores"] == ["product_id", "score"]


def test_samples_move_no_rows_to_meet_their_edges(spark):
    df = spark.range(3000).select("id", F.pmod("id", F.lit(3)).alias("k"))
    for sample in (sampling.fixed_size(df, "id", 50), sampling.stratified(df, "k", "id", 0.1)):
        sample.collect()
        assert "SortMergeJoin" not in executed(sample)
    plan = executed(sampling.fixed_size(df, "id", 50))
    assert "md5" not in plan and "FileScan parquet" in plan


@pytest.mark.parametrize("name", ["write_anomalies", "anomaly_review"])
def test_anomalies_are_the_lowest_of_all_rows(spark, small_dir, monkeypatch, name):
    """Whatever number of rows the queries were once held to."""
    monkeypatch.setattr(registry, "SCORED_ROWS", 300, raising=False)
    scored = registry.queries()["ml_anomaly_score"](spark, small_dir).where("is_anomaly").orderBy("anomaly_raw", "product_id")
    most = 2000 if name == "write_anomalies" else 50
    lowest = {r.product_id for r in scored.limit(most).collect()}
    assert len(lowest) > 5 and {r.product_id for r in registry.queries()[name](spark, small_dir).collect()} == lowest


def test_margins_are_made_once(spark, small_dir):
    plan = executed(registry.queries()["anomaly_threshold"](spark, small_dir))
    assert "Generate" not in plan and "is_active" not in plan and "FileScan parquet [product_id" in plan


def test_codes_are_learned_and_given_on_rows_that_are_written_once(spark, small_dir):
    plan = executed(registry.queries()["ml_encode"](spark, small_dir))
    assert "Generate" not in plan and "FileScan parquet [product_id" in plan and "Window" not in plan


def test_extracts_look_at_every_row_once(spark, small_dir, tmp_path):
    """Recipients with one to three fields, against a plain version; rows neither move nor are read twice."""
    spark.range(400).select("id", *[F.when(F.col("id") % (11 + k) > 0, F.concat(F.lit(f), (F.col("id") * 7 + k) % (3 + k))).alias(f) for k, f in enumerate("abc")]).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    who = {"one": {"b": ["b0", "b2"]}, "two": {"c": ["c1"], "a": ["a0", "a1"]}, "three": {"a": ["a2"], "b": ["b1", "b3"], "c": ["c0", "c4"]}, "last": {"b": ["b1"], "c": ["c2", "c3"]}, "lost": {"a": ["a0"], "none": ["x"]}, "bare": {"a": ["a1"], "b": [None]}}
    mapping = spark.createDataFrame([(r, f, v) for r, fields in who.items() for f, values in fields.items() for v in values], "recipient string, field string, value string")
    got = files.recipient_extracts(df, mapping, ["id"])
    rows = [r.asDict() for r in df.collect()]
    want = sorted((r, row["id"]) for r, fields in who.items() for row in rows if all(row.get(f) is not None and row.get(f) in values for f, values in fields.items()))
    assert sorted((r.recipient, r.id) for r in got.collect()) == want and {r for r, _ in want} == {"one", "two", "three", "last"}
    plan = executed(got)
    assert plan.count("FileScan parquet [id") == 1 and not any(x in plan for x in ("hashpartitioning", "SortMergeJoin", "Aggregate"))
    files.write_by_recipient(got, "recipient", f"{tmp_path}/extracts", spread=None)
    assert spark.read.parquet(f"{tmp_path}/extracts").count() == len(want)


def test_golden_values_hold_the_published_figures_too(spark, small_dir):
    rows = registry.queries()["golden_values"](spark, small_dir).collect()
    wanted = {r.measure: (r.expected, r.actual, r.ok) for r in registry.queries()["golden_published"](spark, small_dir).collect()}
    assert len(rows) == 4 and set(wanted) == set(registry.GOLDEN) and wanted["total_skus"][1] > 4000
    for r in rows:
        assert {m: (r[f"{m}_expected"], r[f"{m}_actual"], r[f"{m}_ok"]) for m in wanted} == wanted
    raw = spark.read.parquet(f"{small_dir}/lineitem.parquet").count()
    assert {r.expected for r in rows} == {raw * rate for rate in registry.RATES.values()}
