"""The catalog's queries and their SQL: one entry per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import cleaning as C
from quarrymill.functions import corrupting as G
from quarrymill.functions import display
from quarrymill.operators import forest, lookup, models, quality, reports, sampling
from quarrymill.plans import cleaning as flow
from quarrymill.sources import files
from quarrymill.sources import fixtures as fx


#: Raw tables written by this application, by application, folder and state of the source tables.
_RAW: dict[tuple[str, str, str], str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Application, folder and state of the files of the tables that the raw table is derived from; no table is read."""
    return spark.sparkContext.applicationId, sf_dir, str([files.state_of(spark, f"{sf_dir}/{t}.parquet") for t in fx.RAW_SOURCES])


def raw_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the raw table derived from the source tables: as in use, the flow starts from raw files that exist.

    It is written once per application, folder and state of the files of the tables that it is derived from.
    """
    key = _state(spark, sf_dir)
    if key not in _RAW:
        path = files.scratch(spark, "raw")
        files.write_parquet(fx.dirty_catalog(spark, sf_dir), path)
        _RAW[key] = path
    return _RAW[key]


#: Rows of a gzip file of raw text, and the files at least that the flow from delimited text starts from.
CHUNK_ROWS, RAW_FILES = 500_000, 10
_TEXT: dict[str, str] = {}


def write_raw_text(spark: SparkSession, sf_dir: str, path: str, least: int) -> None:
    """The raw table as gzip delimited files with a header, by ranges of the id, so many that none grows with the input.

    The clean records are dealt, which are narrower than the text that is made of them.
    """
    chunks = max(least, -(-fx.table(spark, sf_dir, "lineitem").count() // CHUNK_ROWS))
    files.write_chunks(fx.clean_base(spark, sf_dir), path, chunks, "id", fx.dirty)


def raw_text_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the raw table as gzip text, written once for each state of its sources; a file for each core at least."""
    source = str(_state(spark, sf_dir))
    if source not in _TEXT:
        path = files.scratch(spark, "raw_text")
        write_raw_text(spark, sf_dir, path, max(RAW_FILES, spark.sparkContext.defaultParallelism))
        _TEXT[source] = path
    return _TEXT[source]


class Catalog:
    """The dirty catalog of one folder of tables, and what the flow makes of it; nothing runs until asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    @cached_property
    def base(self) -> DataFrame:
        return fx.clean_base(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        return files.scan_parquet(self.spark, raw_path(self.spark, self.sf_dir))

    @cached_property
    def brand_map(self) -> DataFrame:
        """Written first: Spark then knows its size and broadcasts it below its threshold, so that lookups move no row."""
        return _written(self, fx.brands(self.spark, self.sf_dir), "brand_map")

    @cached_property
    def cleaned(self) -> DataFrame:
        return flow.clean_columns(self.raw, fx.RULES)

    @cached_property
    def flags(self) -> DataFrame:
        return flow.flagged(self.raw, self.brand_map, fx.RULES)

    @cached_property
    def clean(self) -> DataFrame:
        return flow.clean(self.flags)

    @cached_property
    def quarantine(self) -> DataFrame:
        return flow.to_quarantine(self.flags)

    def scratch(self, name: str) -> str:
        return files.scratch(self.spark, name)


REGISTERED: dict[str, tuple[Callable[[Catalog], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query on the catalog, with its SQL."""

    def add(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        REGISTERED[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir)) for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}


def on(prefix: str, select: str) -> str:
    return f"WITH {prefix.lstrip()}\n{select}"


def on_raw(select: str) -> str:
    return on(fx.RAW_SQL, select)


def on_cleaned(select: str) -> str:
    return on(fx.CLEANED_SQL, select)


def on_flags(select: str) -> str:
    return on(fx.FLAGGED_SQL, select)


def on_clean(select: str) -> str:
    return on(fx.CLEAN_SQL, select)


def money(x: str) -> str:
    return f"sum({x}::DECIMAL(18,2))::DECIMAL(18,2)"


def mean2(x: str, kind: str = "DECIMAL(9,2)") -> str:
    return f"(round(sum(round({x} * 100)::BIGINT)::DOUBLE / nullif(count({x}), 0)) / 100)::{kind}"


def draw(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws(':', ({key})::VARCHAR, '{seed}')), 1, 15))::BIGINT"


def uniform(key: str, seed: int = 42) -> str:
    return f"(({draw(key, seed)}) % {1 << 40})::DOUBLE / {1 << 40}::DOUBLE"


PERFORMANCE = {
    "sku_count": "count(*)",
    "revenue_12m_zar": money("revenue_12m_zar"),
    "avg_margin_pct": mean2("margin_pct"),
    "avg_price_zar": mean2("price_zar"),
    "avg_rating": mean2("rating", "DECIMAL(4,2)"),
}


def by(dims: str, *names: str) -> str:
    return f"SELECT {dims}, " + ", ".join(f"{PERFORMANCE[n]} AS {n}" for n in names) + f" FROM clean GROUP BY {dims}"


# Columns of the raw and cleaned tables ---------------------------------------------------------------------------------


def column_query(name: str, expressions: dict[str, Callable[[], object]], sql: dict[str, str], source: str = "raw") -> None:
    """A query that shows product_id and some expressions over raw (or cleaned, or flags)."""
    wrap = {"raw": on_raw, "cleaned": on_cleaned, "flags": on_flags}[source]
    table = {"raw": "raw", "cleaned": "cleaned", "flags": "flagged"}[source]
    text = wrap("SELECT product_id, " + ", ".join(f"{x} AS {n}" for n, x in sql.items()) + f" FROM {table}")
    columns = dict(expressions)
    query(name, text)(
        lambda cat: getattr(cat, source).select("product_id", *[make().alias(n) for n, make in columns.items()])
    )


c = F.col
column_query("str_trim", {"x": lambda: F.trim("brand")}, {"x": "trim(brand)"})
column_query("str_case", {"u": lambda: F.upper("province"), "l": lambda: F.lower("province")}, {"u": "upper(province)", "l": "lower(province)"})
column_query("str_replace", {"x": lambda: F.replace(F.replace(c("price_zar"), F.lit("ZAR"), F.lit("")), F.lit(","), F.lit(""))}, {"x": "replace(replace(price_zar, 'ZAR', ''), ',', '')"})
column_query("str_regex_ws", {"x": lambda: F.regexp_replace("product_name", r"\s+", " ")}, {"x": r"regexp_replace(product_name, '\s+', ' ', 'g')"})
column_query("num_parse", {"cost": lambda: C.number(c("cost_zar")), "rating": lambda: C.number(c("rating"))}, {"cost": fx.number_sql("cost_zar"), "rating": fx.number_sql("rating")})
column_query("int_parse", {"x": lambda: C.integer(c("stock_qty"))}, {"x": fx.integer_sql("stock_qty")})
column_query("date_multi_format", {"x": lambda: C.multi_format_date(c("date_added"))}, {"x": fx.DATE_SQL})
column_query("case_no_else", {"x": lambda: F.when(c("rating") == "99", "high").when(c("rating") == "-1", "low")}, {"x": "CASE WHEN rating = '99' THEN 'high' WHEN rating = '-1' THEN 'low' END"})
column_query("in_list", {"x": lambda: F.upper("is_active").isin(*C.TRUE_TOKENS), "y": lambda: ~F.lower("brand").isin(*C.JUNK_KEYS)}, {"x": "upper(is_active) IN ('Y', '1', 'TRUE', 'YES', 'ACTIVE')", "y": "lower(brand) NOT IN ('null', 'unknown', '')"})
column_query("clean_blank_null", {"x": lambda: C.blank_to_null(c("sku"))}, {"x": "CASE WHEN trim(sku) <> '' THEN trim(sku) END"})
for _name, _column in {
    "clean_whitespace": "pname", "clean_lookup_key": "brand_key", "clean_currency": "price_c", "clean_unit_gram_kg": "weight_c",
    "clean_clamp": "stock_c", "clean_nonneg": "units_c", "clean_boolean": "active_c", "clean_range": "rating_c",
    "clean_enum": "channel_c", "clean_alias": "province_c", "clean_category": "category_mapped",
}.items():
    column_query(_name, {_column: lambda k=_column: c(k)}, {_column: _column}, "cleaned")
CLEANED = ("pid", "sku_c", "pname", "brand_key", "price_c", "cost_c", "weight_c", "stock_c", "units_c", "date_c", "active_c", "rating_c", "channel_c", "province_c", "category_mapped")
column_query("clean_columns", {k: lambda k=k: c(k) for k in CLEANED}, {k: k for k in CLEANED}, "cleaned")
for _name, _columns in {
    "coalesce_category": ("category_final",), "derived_margin": ("margin_pct",), "derived_revenue": ("revenue_12m_zar",),
    "derived_group": ("product_group",), "reject_reason": ("reject_reason",), "validity_flag": ("is_valid",),
    "derive_chain": ("brand_final", "brand_solution", "category_final", "margin_pct", "revenue_12m_zar", "product_group"),
    "lookup_join": ("brand_key", "bm_brand", "bm_brand_solution", "bm_primary_category", "bm_product_group"),
}.items():
    _sql = {k: k for k in _columns}
    if _name == "lookup_join":
        query(_name, on_cleaned(f"SELECT product_id, {', '.join(_columns)} FROM cleaned LEFT JOIN brand_map ON brand_key = bm_brand_key"))(
            lambda cat: lookup.lookup_any(cat.cleaned, cat.brand_map, "brand_key", "bm_brand_key").select(
                "product_id", "brand_key", "bm_brand", "bm_brand_solution", "bm_primary_category", "bm_product_group"
            )
        )
    else:
        column_query(_name, {k: lambda k=k: c(k) for k in _columns}, _sql, "flags")
column_query("reason_display", {"x": lambda: quality.reason_display(c("reject_reason"))}, {"x": "replace(regexp_replace(reject_reason, ';+$', ''), ';', ' + ')"}, "flags")
column_query("year_added", {"year": lambda: F.year("date_c").cast("int")}, {"year": "year(date_c)::INTEGER"}, "cleaned")
column_query("month_added", {"month_start": lambda: F.trunc("date_c", "MM"), "month": lambda: reports.month_of("date_c")}, {"month_start": "date_trunc('month', date_c)::DATE", "month": "strftime(date_c, '%Y-%m')"}, "cleaned")
column_query("display_format", {"thousands": lambda: display.thousands(c("units_c")), "percent": lambda: display.percent(c("margin_pct"))}, {"thousands": "CASE WHEN units_c IS NOT NULL THEN format('{:,}', units_c) END", "percent": "CASE WHEN margin_pct IS NOT NULL THEN (round(margin_pct * 10)::BIGINT // 10)::VARCHAR || '.' || (round(margin_pct * 10)::BIGINT % 10)::VARCHAR || '%' END"}, "flags")
column_query("label_concat", {"label": lambda: F.concat(F.lit("Channel "), c("sales_channel"))}, {"label": "'Channel ' || sales_channel"})
column_query("map_lookup", {"x": lambda: C.mapped(c("category"), {"ECONOMY": "55", "SMALL": "72", "LARGE": "95"})}, {"x": "CASE category WHEN 'ECONOMY' THEN '55' WHEN 'SMALL' THEN '72' WHEN 'LARGE' THEN '95' END"})

# Corruption ------------------------------------------------------------------------------------------------------------
for _name, _columns in {
    "corrupt_text": ("brand", "category", "sales_channel"), "corrupt_sentinel": ("brand", "sku"), "corrupt_legacy": ("category",),
    "corrupt_price": ("price_zar",), "corrupt_unit": ("weight_kg",), "corrupt_number": ("stock_qty", "units_sold_12m"),
    "corrupt_date": ("date_added",), "corrupt_boolean": ("is_active",), "corrupt_range": ("rating",),
    "corrupt_name": ("product_name",), "corrupt_abbrev": ("province",),
}.items():
    query(_name, on_raw(f"SELECT product_id, {', '.join(_columns)} FROM raw"))(lambda cat, k=_columns: cat.raw.select("product_id", *k))


@query("inject_duplicates", on(fx.BASE_SQL, "SELECT h, id FROM base UNION ALL SELECT h, id FROM base WHERE (h % 163) * 100 // 163 < 2"))
def _inject(cat):
    rows = cat.base.select("h", "id")
    return quality.with_duplicates(rows, G.band(c("h"), 163) < 2)


@query(
    "synth_catalog",
    "WITH priced AS (SELECT p_partkey, p_type, p_brand, p_size, p_size * 0.05::DOUBLE + 0.1::DOUBLE AS kilos, round(greatest(("
    + fx.one_of_sql("p_type", {k: str(40 + 10 * i) for i, k in enumerate(fx.CATEGORIES)})
    + ")::DOUBLE * pow((p_size * 0.05::DOUBLE + 0.1::DOUBLE) / 0.5::DOUBLE, 0.35::DOUBLE) * exp((" + " + ".join(uniform("p_partkey", k) for k in (1, 2, 3)) + " - 1.5::DOUBLE) * 0.3::DOUBLE), 8.99::DOUBLE), 2) AS price FROM part) "
    f"SELECT *, round(price * (0.5::DOUBLE + 0.3::DOUBLE * {uniform('p_partkey', 4)}), 2) AS cost, round(9000 / sqrt(price) * (0.5::DOUBLE + {uniform('p_partkey', 5)}))::INTEGER AS units FROM priced",
)
def _synth(cat):
    base = cat.table("part").select("p_partkey", "p_type", "p_brand", "p_size")
    kilos = (c("p_size") * 0.05 + 0.1).alias("kilos")
    start = F.element_at(F.create_map(*[x for i, k in enumerate(fx.CATEGORIES) for x in (F.lit(k), F.lit(40.0 + 10 * i))]), c("p_type"))
    noise = (sampling.uniform("p_partkey", 1) + sampling.uniform("p_partkey", 2) + sampling.uniform("p_partkey", 3) - 1.5) * 0.3
    out = base.select("*", kilos).withColumn("price", G.synthetic_price(start, F.lit(1.0), c("kilos"), noise))
    out = out.withColumn("cost", F.round(c("price") * (0.5 + 0.3 * sampling.uniform("p_partkey", 4)), 2))
    return out.withColumn("units", F.round(9000 / F.sqrt("price") * (0.5 + sampling.uniform("p_partkey", 5))).cast("int"))


# The flow --------------------------------------------------------------------------------------------------------------
query("flagship_clean", on_clean("SELECT * FROM clean"))(lambda cat: cat.clean)


@query("clean_from_files", on_clean("SELECT * FROM clean"))
def _clean_from_files(cat):
    """The flow from gzip text. Such files can't be split: there is one for each core at least, and none grows with the input."""
    raw = files.scan_delimited(cat.spark, f"{raw_text_path(cat.spark, cat.sf_dir)}/*.csv.gz", flow.RAW_COLUMNS)
    return flow.clean(flow.flagged(raw, cat.brand_map, fx.RULES))


query("vw_products", on_clean("SELECT * FROM clean"))(lambda cat: (files.publish({"vw_products": cat.clean}), cat.spark.table("vw_products"))[1])
query("quarantine", on_clean("SELECT * FROM quarantine"))(lambda cat: cat.quarantine)
query("split_valid", on_flags("SELECT is_valid, count(*) AS n, count(DISTINCT product_id) AS ids FROM flagged GROUP BY is_valid"))(
    lambda cat: cat.flags.groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("product_id").alias("ids"))
)
query("dedupe_latest", on_clean("SELECT product_id, date_added, price_zar FROM clean"))(lambda cat: cat.clean.select("product_id", "date_added", "price_zar"))
query("split_complete", on_flags("SELECT count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS rejected, count(*) AS total FROM flagged"))(
    lambda cat: cat.flags.agg(F.count_if("is_valid").alias("valid"), F.count_if(~c("is_valid")).alias("rejected"), F.count(F.lit(1)).alias("total"))
)
query("dropna_subset", on_flags("SELECT product_id, price_c, weight_c, rating_c FROM flagged WHERE price_c IS NOT NULL AND weight_c IS NOT NULL AND rating_c IS NOT NULL"))(
    lambda cat: cat.flags.dropna(subset=["price_c", "weight_c", "rating_c"]).select("product_id", "price_c", "weight_c", "rating_c")
)
query("suppress_blank_dim", on_raw("SELECT sales_channel, count(*) AS n FROM raw WHERE length(trim(sales_channel)) > 0 GROUP BY sales_channel"))(
    lambda cat: reports.without_blank(cat.raw, "sales_channel").groupBy("sales_channel").agg(F.count(F.lit(1)).alias("n"))
)
PANES = ("product_group", "category", "brand_solution", "province", "year_added")
query(
    "filter_pane_values",
    on_clean("SELECT field, value, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {'year(date_added)' if f == 'year_added' else f}::VARCHAR AS value FROM clean" for f in PANES
    ) + ") GROUP BY field, value"),
)(lambda cat: reports.pane_values(cat.clean.withColumn("year_added", F.year("date_added")), PANES))
query(
    "filter_pane_apply",
    on_clean(f"SELECT province, {money('revenue_12m_zar')} AS revenue, count(DISTINCT product_id) AS total_skus FROM clean WHERE category IN ('ECONOMY', 'LARGE') AND brand_solution IN ('Private Label') GROUP BY province"),
)(lambda cat: reports.cube_query(cat.clean, ["province"], ["revenue", "total_skus"], {"category": ["ECONOMY", "LARGE"], "brand_solution": ["Private Label"]}))
query("prefix_columns", on_clean("SELECT category AS cat_category, count(*) AS cat_n FROM clean GROUP BY category"))(
    lambda cat: files.prefixed(cat.clean.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "cat_")
)

# Joins -----------------------------------------------------------------------------------------------------------------
query("brand_map_build", on_cleaned("SELECT * FROM brand_map"))(lambda cat: cat.brand_map)
query("dim_bridge_join", on_cleaned("SELECT p_brand, category, product_group FROM (SELECT DISTINCT p_brand, p_type FROM part) JOIN category_groups ON category = p_type"))(
    lambda cat: cat.table("part").select("p_brand", "p_type").distinct().join(fx.category_groups(cat.spark), c("p_type") == c("category")).select("p_brand", "category", "product_group")
)
query("explode_bridge", "SELECT DISTINCT p_brand, p_type FROM part")(
    lambda cat: lookup.explode_bridge(cat.table("part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types")), "p_brand", "types", "p_type")
)
query("dims", f"SELECT category, CASE WHEN category IN {fx.PERISHABLE} THEN '{fx.GROUPS[0]}' ELSE '{fx.GROUPS[1]}' END AS product_group FROM (SELECT DISTINCT p_type AS category FROM part) WHERE category IN {fx.CATEGORIES}")(lambda cat: fx.category_groups(cat.spark).join(cat.table("part").select(c("p_type").alias("category")).distinct(), "category"))
RECONCILE_SQL = f"SELECT coalesce(a.category, b.category) AS category, a.v AS expected, b.v AS actual, coalesce(abs(a.v - b.v) <= 0.01, false) AS ok FROM (SELECT category, {money('revenue_12m_zar')} AS v FROM clean GROUP BY category) a FULL JOIN (SELECT category_final AS category, {money('revenue_12m_zar')} AS v FROM flagged WHERE is_valid GROUP BY category_final) b ON a.category = b.category"


@query("reconcile", on_clean(RECONCILE_SQL))
def _reconcile(cat):
    """The latest rows against all valid ones: both measures from one scan, written, then joined."""
    sums = flow.with_latest(cat.flags).groupBy(c("category_final").alias("category")).agg(
        F.count_if("is_latest").alias("latest"),
        reports.money(F.when(c("is_latest"), c("revenue_12m_zar"))).alias("clean"),
        reports.money("revenue_12m_zar").alias("valid"),
    )
    sums = _written(cat, sums, "category_sums")
    sides = sums.where("latest > 0").select("category", c("clean").alias("v")), sums.select("category", c("valid").alias("v"))
    return lookup.reconcile(*sides, ["category"], "v", 0.01)


# Reports ---------------------------------------------------------------------------------------------------------------
KPI = f"SELECT count(*) AS total_skus, count(*) FILTER (is_active) AS active_skus, {money('revenue_12m_zar')} AS revenue_12m_zar, {mean2('margin_pct')} AS avg_margin_pct, {mean2('price_zar')} AS avg_price_zar, {mean2('rating', 'DECIMAL(4,2)')} AS avg_rating, sum(stock_qty::BIGINT)::BIGINT AS total_stock_units FROM clean"
query("vw_kpi_summary", on_clean(KPI))(lambda cat: reports.kpi_summary(cat.clean))
query("vw_category_performance", on_clean(by("product_group, category", *PERFORMANCE)))(lambda cat: reports.category_performance(cat.clean))
query("vw_brand_performance", on_clean(by("brand_solution, brand", "sku_count", "revenue_12m_zar", "avg_margin_pct", "avg_rating")))(lambda cat: reports.brand_performance(cat.clean))
THREE = ("sku_count", "revenue_12m_zar", "avg_margin_pct")
query("vw_province_performance", on_clean(by("province", *THREE)))(lambda cat: reports.dimension_performance(cat.clean, "province"))
query("province_nonnull", on_clean(by("province", *THREE).replace("FROM clean", "FROM clean WHERE province IS NOT NULL")))(lambda cat: reports.dimension_performance(cat.clean, "province", keep_nulls=False))
query("vw_channel_performance", on_clean(by("sales_channel", *THREE)))(lambda cat: reports.dimension_performance(cat.clean, "sales_channel"))
query("vw_data_quality", on_clean("SELECT reject_reason, count(*) AS row_count FROM quarantine GROUP BY reject_reason"))(lambda cat: reports.reason_counts(cat.quarantine))
query("catalog_growth", on_clean("SELECT strftime(date_added, '%Y-%m') AS month, count(*) AS products_added FROM clean GROUP BY 1"))(lambda cat: reports.catalog_growth(cat.clean))
query("cond_count", on_clean("SELECT category, count(*) FILTER (is_active) AS active_skus, count(*) AS skus FROM clean GROUP BY category"))(
    lambda cat: cat.clean.groupBy("category").agg(reports.active().alias("active_skus"), F.count(F.lit(1)).alias("skus"))
)
query("distinct_count", on_flags("SELECT count(DISTINCT pid) AS ids, count(DISTINCT CASE WHEN active_c THEN pid END) AS active_ids FROM flagged"))(
    lambda cat: reports.distinct_and_marked(cat.flags, "pid", "active_c", "ids", "active_ids")
)
PER_SKU = "sum(revenue_12m_zar::DECIMAL(18,2))::DOUBLE / nullif(count(DISTINCT product_id), 0)::DOUBLE"
query("revenue_per_sku", on_clean(f"SELECT category, {PER_SKU} AS revenue_per_sku FROM clean GROUP BY category"))(lambda cat: reports.cube_query(cat.clean, ["category"], ["revenue_per_sku"]))
query(
    "measure_cube",
    on_clean(f"SELECT brand_solution, province, {money('revenue_12m_zar')} AS revenue, count(DISTINCT product_id) AS total_skus, count(DISTINCT CASE WHEN is_active THEN product_id END) AS active_skus, {mean2('margin_pct')} AS avg_margin_pct, {mean2('price_zar')} AS avg_price, {mean2('rating', 'DECIMAL(4,2)')} AS avg_rating, sum(stock_qty::BIGINT)::BIGINT AS stock_units, sum(units_sold_12m::BIGINT)::BIGINT AS units_sold, {PER_SKU} AS revenue_per_sku FROM clean GROUP BY brand_solution, province"),
)(lambda cat: reports.cube_query(cat.clean, ["brand_solution", "province"], list(reports.measures())))
RATES = "count(*) FILTER (is_valid)::DOUBLE / count(*)::DOUBLE AS pass_rate, 1 - count(*) FILTER (NOT is_valid)::DOUBLE / count(*)::DOUBLE AS pass_rate_by_rejects, count(*) FILTER (NOT is_valid)::DOUBLE / count(*)::DOUBLE AS reject_rate"
query("dq_pass_rate", on_flags(f"SELECT pass_rate, pass_rate_by_rejects FROM (SELECT {RATES} FROM flagged)"))(lambda cat: quality.pass_rates(cat.flags).drop("reject_rate"))
query("dq_reject_rate", on_flags(f"SELECT reject_rate FROM (SELECT {RATES} FROM flagged)"))(lambda cat: quality.pass_rates(cat.flags).select("reject_rate"))
CATEGORY = by("product_group, category", *PERFORMANCE)
query(
    "weighted_avg",
    on_clean(f"SELECT sum(avg_margin_pct * sku_count::DECIMAL(18,0))::DOUBLE / sum(sku_count)::DOUBLE AS weighted_avg_margin_pct, sum(avg_price_zar * sku_count::DECIMAL(18,0))::DOUBLE / sum(sku_count)::DOUBLE AS weighted_avg_price_zar FROM ({CATEGORY})"),
)(lambda cat: reports.weighted_average(reports.category_performance(cat.clean), ["avg_margin_pct", "avg_price_zar"], "sku_count"))
BY_GROUP = f"SELECT product_group, {money('revenue_12m_zar')} AS revenue FROM clean GROUP BY product_group"
query("revenue_by_group", on_clean(BY_GROUP))(lambda cat: cat.clean.groupBy("product_group").agg(reports.money("revenue_12m_zar").alias("revenue")))
query("share_of_total", on_clean(f"SELECT product_group, revenue, revenue::DOUBLE / sum(revenue::DOUBLE) OVER () AS share FROM ({BY_GROUP})"))(
    lambda cat: reports.share_of_total(cat.clean.groupBy("product_group").agg(reports.money("revenue_12m_zar").alias("revenue")), "revenue", "share")
)
query(
    "dq_funnel",
    on_clean("SELECT 1 AS step, 'raw' AS stage, count(*) AS row_count FROM raw UNION ALL SELECT 2, 'valid', count(*) FROM flagged WHERE is_valid UNION ALL SELECT 3, 'unique', count(*) FROM clean"),
)(lambda cat: quality.funnel(cat.flags))
PROVINCE = f"SELECT province, {money('revenue_12m_zar')} AS revenue FROM clean WHERE province IS NOT NULL GROUP BY province"
_by_province = lambda cat: cat.clean.where("province is not null").groupBy("province").agg(reports.money("revenue_12m_zar").alias("revenue"))
query("minmax_scale", on_clean(f"SELECT province, revenue, 0.15 + 0.8 * ((revenue::DOUBLE - min(revenue::DOUBLE) OVER ()) / (max(revenue::DOUBLE) OVER () - min(revenue::DOUBLE) OVER ())) AS shade FROM ({PROVINCE})"))(
    lambda cat: reports.minmax_scale(_by_province(cat), "revenue", "shade", 0.15, 0.95)
)
BRAND = f"SELECT brand, {money('revenue_12m_zar')} AS revenue FROM clean GROUP BY brand"
_by_brand = lambda cat: cat.clean.groupBy("brand").agg(reports.money("revenue_12m_zar").alias("revenue"))
query("ratio_to_max", on_clean(f"SELECT brand, revenue, revenue::DOUBLE / max(revenue::DOUBLE) OVER () AS ratio FROM ({BRAND})"))(lambda cat: reports.ratio_to_max(_by_brand(cat), "revenue", "ratio"))
query("topk_brands", on_clean(f"{BRAND} ORDER BY revenue DESC, brand LIMIT 10"))(lambda cat: reports.top(_by_brand(cat), "revenue", 10, "brand"))
query("topk_reasons", on_clean("SELECT reject_reason, count(*) AS row_count FROM quarantine GROUP BY reject_reason ORDER BY row_count DESC, reject_reason LIMIT 8"))(
    lambda cat: reports.top(reports.reason_counts(cat.quarantine), "row_count", 8, "reject_reason")
)
query("n_smallest", on_clean("SELECT product_id, margin_pct FROM clean WHERE margin_pct IS NOT NULL ORDER BY margin_pct, product_id LIMIT 2000"))(
    lambda cat: reports.smallest(cat.clean.where("margin_pct is not null").select("product_id", "margin_pct"), "margin_pct", 2000, "product_id")
)
LEADERS = ("category", "brand", "province", "sales_channel")
query(
    "argmax_leaders",
    on_clean(" UNION ALL ".join(f"(SELECT '{d}' AS dimension, {d} AS leader, {money('revenue_12m_zar')} AS total FROM clean WHERE {d} IS NOT NULL GROUP BY {d} ORDER BY total DESC, leader LIMIT 1)" for d in LEADERS)),
)(lambda cat: reports.leaders(cat.clean, LEADERS, "revenue_12m_zar"))
query("brand_category_xtab", on_clean(by("brand, category", "revenue_12m_zar", "avg_margin_pct", "sku_count", "avg_rating")))(lambda cat: reports.cross_tab(cat.clean))
query(
    "brand_category_pivot",
    on_clean("SELECT brand, " + ", ".join(f"(sum(revenue_12m_zar::DECIMAL(18,2)) FILTER (category = '{k}'))::DECIMAL(18,2) AS {k.lower()}" for k in fx.CATEGORIES) + " FROM clean GROUP BY brand"),
)(lambda cat: reports.pivoted(cat.clean, "brand", "category", fx.CATEGORIES, "revenue_12m_zar"))
query("category_solution", on_clean(f"SELECT category, brand_solution, {money('revenue_12m_zar')} AS revenue FROM clean GROUP BY category, brand_solution"))(
    lambda cat: reports.cube_query(cat.clean, ["category", "brand_solution"], ["revenue"])
)
query("revenue_by_month", on_clean(f"SELECT strftime(date_added, '%Y-%m') AS month, {money('revenue_12m_zar')} AS revenue FROM clean GROUP BY 1"))(
    lambda cat: cat.clean.groupBy(reports.month_of("date_added").alias("month")).agg(reports.money("revenue_12m_zar").alias("revenue"))
)
query(
    "price_vs_median",
    on_clean("SELECT product_id, category, price_zar, m AS group_median, price_zar - m AS deviation FROM clean JOIN (SELECT category AS k, quantile_cont(price_zar, 0.5) AS m FROM clean GROUP BY category) ON category = k"),
)(lambda cat: reports.versus_group_median(_written(cat, cat.clean.select("product_id", "category", "price_zar"), "priced"), "category", "price_zar"))

PAGE = f"{BRAND} ORDER BY revenue DESC, brand"
query("sort_measure", on_clean(PAGE))(lambda cat: reports.descending(_by_brand(cat), "revenue", "brand"))
query("fetch_window", on_clean(f"{PAGE} LIMIT 10 OFFSET 5"))(lambda cat: reports.window(_by_brand(cat), "revenue", 5, 10, "brand"))
query("aggregate_by_name", on_clean(f"SELECT n_name AS province, revenue FROM nation LEFT JOIN ({PROVINCE}) ON province = n_name"))(
    lambda cat: lookup.aggregate_row(cat.table("nation").select(c("n_name").alias("province")), _by_province(cat), "province")
)

# Quality and sets ------------------------------------------------------------------------------------------------------
query("reason_exploded", on_clean("SELECT rule, count(*) AS row_count FROM (SELECT unnest(string_split(regexp_replace(reject_reason, ';+$', ''), ';')) AS rule FROM quarantine) GROUP BY rule"))(lambda cat: quality.reasons_exploded(cat.quarantine))
query("kpi_recon", on_clean(f"SELECT total_skus, active_skus, revenue_12m_zar, avg_margin_pct, avg_price_zar, total_stock_units, (SELECT count(*) FROM quarantine) AS quarantined_rows FROM ({KPI})"))(lambda cat: quality.kpi_reconciliation(flow.clean_and_rejected(cat.flags)))
#: Figures that the published catalog shows, by measure. Fixed values.
GOLDEN = {"total_skus": 4284971, "revenue_12m_zar": 1170282306878.76, "avg_margin_pct": 35.00, "avg_price_zar": 71.68, "active_skus": 2142870, "quarantined_rows": 729438}
query(
    "golden_published",
    on_clean(" UNION ALL ".join(
        f"SELECT '{m}' AS measure, {v}::DOUBLE AS expected, a::DOUBLE AS actual, abs({v}::DOUBLE - a::DOUBLE) <= 0.01 AS ok FROM (SELECT "
        + ("count(*) AS a FROM quarantine" if m == "quarantined_rows" else f"{m} AS a FROM ({KPI})") + ")"
        for m, v in GOLDEN.items()
    )),
)(lambda cat: quality.golden(quality.kpi_reconciliation(flow.clean_and_rejected(cat.flags)), GOLDEN, 0.01))
#: Shares of raw rows that the corruption rates make invalid, by reason, and at all.
RATES = fx.reject_rates()
COUNTED = ", ".join(
    f"count(*) FILTER (contains(';' || reject_reason, ';{m};')) AS {m}" if m != "rejected_rows" else "count(*) FILTER (NOT is_valid) AS rejected_rows" for m in RATES
)
PUBLISHED = ", ".join(
    f"{v}::DOUBLE AS {m}_expected, {m}::DOUBLE AS {m}_actual, coalesce(abs({v}::DOUBLE - {m}::DOUBLE) <= 0.01, false) AS {m}_ok" for m, v in GOLDEN.items()
)


@query(
    "golden_values",
    on(
        fx.CLEAN_SQL + f",\ncounted AS (SELECT count(*) AS n, {COUNTED} FROM flagged)",
        "SELECT b.measure, b.expected, b.low, b.high, b.actual, coalesce(b.actual BETWEEN b.low AND b.high, false) AS ok, p.* FROM (" + " UNION ALL ".join(
            f"SELECT '{m}' AS measure, n::DOUBLE * {p!r}::DOUBLE AS expected, n::DOUBLE * {p!r}::DOUBLE - sqrt(n::DOUBLE * {p * (1 - p)!r}::DOUBLE) * 5.0::DOUBLE AS low, n::DOUBLE * {p!r}::DOUBLE + sqrt(n::DOUBLE * {p * (1 - p)!r}::DOUBLE) * 5.0::DOUBLE AS high, {m}::DOUBLE AS actual FROM counted"
            for m, p in RATES.items()
        ) + f") b, (SELECT {PUBLISHED} FROM ({KPI}), (SELECT count(*) AS quarantined_rows FROM quarantine)) p",
    ),
)
def _golden_values(cat):
    """The published figures of the clean table, beside the bounds that the rates give the rejected rows."""
    rows = flow.clean_and_rejected(cat.flags, "reject_reason")
    figures = quality.kpis_and_reasons(rows, cat.raw, [m for m in RATES if m != "rejected_rows"])
    return quality.rate_bounds(figures, "raw_rows", RATES, beside=quality.published(GOLDEN, 0.01))


query(
    "detail_vs_total",
    on_clean(f"SELECT detail_skus::BIGINT AS detail_skus, detail_revenue, total_skus, revenue_12m_zar, detail_skus = total_skus AND detail_revenue = revenue_12m_zar AS ok FROM (SELECT sum(sku_count) AS detail_skus, sum(revenue_12m_zar)::DECIMAL(18,2) AS detail_revenue FROM ({CATEGORY})), (SELECT total_skus, revenue_12m_zar FROM ({KPI}))"),
)(lambda cat: quality.detail_against_total(cat.clean))
query("union_all", on_clean("SELECT product_id, 'clean' AS origin FROM clean UNION ALL SELECT product_id, 'quarantine' FROM quarantine"))(
    lambda cat: quality.union_all([cat.clean.select("product_id", F.lit("clean").alias("origin")), cat.quarantine.select("product_id", F.lit("quarantine").alias("origin"))])
)

# Sampling --------------------------------------------------------------------------------------------------------------
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_SQL = f"concat_ws('|', {', '.join(LINE)}, round(l_extendedprice * 100)::BIGINT)"
_lines = lambda cat, *columns: cat.table("lineitem").select(F.concat_ws("|", *LINE, F.round(c("l_extendedprice") * 100).cast("bigint")).alias("k"), *columns)
query("sample_fixed", f"SELECT k FROM (SELECT {LINE_SQL} AS k FROM lineitem) ORDER BY {draw('k')}, k LIMIT 1000")(lambda cat: sampling.fixed_size(_lines(cat), "k", 1000))
query(
    "sample_stratified",
    f"SELECT l_returnflag, k FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {draw('k')}, k) AS place, count(*) OVER (PARTITION BY l_returnflag) AS n FROM (SELECT l_returnflag, {LINE_SQL} AS k FROM lineitem)) WHERE place <= round(0.1 * n)",
)(lambda cat: sampling.stratified(_lines(cat, "l_returnflag"), "l_returnflag", "k", 0.1).select("l_returnflag", "k"))
query("shuffle_rows", "SELECT o_orderkey, o_totalprice FROM orders")(lambda cat: sampling.shuffled(cat.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey"))


@query("split_train_test", f"SELECT o_orderkey, CASE WHEN {uniform('o_orderkey')} < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS side FROM orders")
def _split(cat):
    train, test = sampling.split(cat.table("orders"), "o_orderkey")
    sides = [df.select("o_orderkey", F.lit(name).alias("side")) for df, name in ((train, "train"), (test, "test"))]
    return quality.union_all(sides)


CHOICES = [("store", 62), ("food service", 18), ("industry", 12), ("export", 8)]
query(
    "weighted_choice",
    f"SELECT o_orderkey, CASE WHEN u < 0.62::DOUBLE THEN 'store' WHEN u < 0.8::DOUBLE THEN 'food service' WHEN u < 0.92::DOUBLE THEN 'industry' ELSE 'export' END AS channel FROM (SELECT o_orderkey, {uniform('o_orderkey')} AS u FROM orders)",
)(lambda cat: sampling.weighted_choice(cat.table("orders").select("o_orderkey"), "o_orderkey", CHOICES, "channel"))

# Sources and sinks -----------------------------------------------------------------------------------------------------
query("scan_parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")(lambda cat: files.scan_parquet(cat.spark, f"{cat.sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("scan_csv_gz", on_raw("SELECT " + ", ".join(f"coalesce({k}, '') AS {k}" for k in flow.RAW_COLUMNS) + " FROM raw"))
def _scan_gz(cat):
    path = cat.scratch("raw")
    write_raw_text(cat.spark, cat.sf_dir, path, 4)
    scanned = files.scan_delimited(cat.spark, f"{path}/*.csv.gz", flow.RAW_COLUMNS)
    return scanned.select(*[F.coalesce(k, F.lit("")).alias(k) for k in flow.RAW_COLUMNS])


@query("scan_brand_map", on_cleaned("SELECT * FROM brand_map"))
def _scan_map(cat):
    path = cat.scratch("brand_map")
    files.write_delimited(cat.brand_map, path, single=True)
    return files.scan_delimited(cat.spark, path, flow.BRAND_MAP_COLUMNS)


@query("scan_drift", on_raw("SELECT product_id, coalesce(brand, '') AS brand, '' AS category, '' AS sku, '' AS added FROM raw UNION ALL SELECT product_id, '', coalesce(category, ''), '', 'x' FROM raw"))
def _drift(cat):
    a, b = cat.scratch("a"), cat.scratch("b")
    files.write_delimited(cat.raw.select("product_id", "brand"), a)
    files.write_delimited(cat.raw.select("product_id", "category", F.lit("x").alias("added")), b)
    scanned = files.scan_with_drift(cat.spark, [a, b], ["product_id", "brand", "category", "sku"])
    return scanned.select(*[F.coalesce(k, F.lit("")).alias(k) for k in scanned.columns])


def _fan_out(cat) -> tuple[DataFrame, DataFrame]:
    a, b = cat.scratch("clean"), cat.scratch("quarantine")
    files.write_fan_out(cat.flags, cat.clean, cat.quarantine, a, b)
    return files.scan_parquet(cat.spark, a), files.scan_parquet(cat.spark, b)


def _written(cat, df: DataFrame, name: str) -> DataFrame:
    path = cat.scratch(name)
    files.write_parquet(df, path)
    return files.scan_parquet(cat.spark, path)


query("write_clean", on_clean("SELECT * FROM clean"))(lambda cat: _written(cat, cat.clean, "clean"))
query("write_quarantine", on_clean("SELECT * FROM quarantine"))(lambda cat: _written(cat, cat.quarantine, "quarantine"))
query("split_fanout", on_clean("SELECT 'clean' AS sink, count(*) AS n FROM clean UNION ALL SELECT 'quarantine', count(*) FROM quarantine"))(
    lambda cat: quality.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "n") for df, name in zip(_fan_out(cat), ("clean", "quarantine"), strict=True)])
)


@query("write_aggregates", on_clean("SELECT reject_reason, count(*)::VARCHAR AS row_count FROM quarantine GROUP BY reject_reason"))
def _aggregates(cat):
    path = cat.scratch("data_quality")
    files.write_delimited(reports.reason_counts(cat.quarantine), path, single=True)
    return files.scan_delimited(cat.spark, path, ["reject_reason", "row_count"])


@query("write_metrics", on_clean("SELECT count(*) AS total_skus, count(*) FILTER (is_active) AS active_skus FROM clean"))
def _metrics(cat):
    path = cat.scratch("metrics")
    kpi = reports.kpi_summary(cat.clean)
    files.write_json(kpi.select(F.struct("total_skus", "active_skus").alias("catalog")), path)
    return cat.spark.read.schema("catalog struct<total_skus:bigint,active_skus:bigint>").json(path).select("catalog.*")


@query("write_extracts", on_clean("SELECT product_id, reject_reason FROM quarantine"))
def _extracts(cat):
    path = cat.scratch("extract")
    files.write_delimited(cat.quarantine.select("product_id", "reject_reason"), path)
    return files.scan_delimited(cat.spark, path, ["product_id", "reject_reason"])


@query("write_raw", on_raw("SELECT product_id, price_zar FROM raw"))
def _write_raw(cat):
    path = cat.scratch("raw")
    write_raw_text(cat.spark, cat.sf_dir, path, 4)
    scanned = files.scan_delimited(cat.spark, f"{path}/*.csv.gz", flow.RAW_COLUMNS)
    return scanned.select("product_id", F.coalesce("price_zar", F.lit("")).alias("price_zar"))


@query("load_typed_text", on_raw(f"SELECT product_id, {fx.number_sql('cost_zar')} AS cost, {fx.DATE_SQL} AS added FROM raw"))
def _load(cat):
    path = cat.scratch("typed")
    files.write_delimited(cat.raw.select("product_id", "cost_zar", "date_added"), path)
    text = files.scan_delimited(cat.spark, path, ["product_id", "cost_zar", "date_added"])
    return files.load_typed(text, {"product_id": c("product_id"), "cost": C.number(c("cost_zar")), "added": C.multi_format_date(c("date_added"))})


@query("burst_by_recipient", on_clean("SELECT brand, count(*) AS n FROM clean GROUP BY brand"))
def _burst(cat):
    path = cat.scratch("burst")
    files.write_by_recipient(cat.clean.select("product_id", "brand", "province"), "brand", path)
    return files.scan_parquet(cat.spark, path).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


RECIPIENTS_SQL = """, recipients AS (
  SELECT 'region ' || r_name AS recipient, 'province' AS field, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'head office', 'province', n_name FROM nation
  UNION ALL SELECT 'solution ' || bm_brand_solution, 'brand', bm_brand FROM brand_map
  UNION ALL SELECT 'buyer ' || r_name, 'province', n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'buyer ' || r_name, 'brand', bm_brand FROM brand_map, region WHERE ascii(substr(bm_brand, -1)) % 5 = r_regionkey),
extracts AS (
  SELECT recipient, product_id, revenue_12m_zar
  FROM clean JOIN recipients ON (field = 'province' AND value = province) OR (field = 'brand' AND value = brand)
  GROUP BY recipient, product_id, revenue_12m_zar
  HAVING count(DISTINCT field) = (SELECT count(DISTINCT field) FROM recipients r WHERE r.recipient = any_value(recipients.recipient)))"""


def _recipients(cat) -> DataFrame:
    """Who may see what, derived from the tables: regions, head office, solutions, and buyers with two conditions."""
    places = cat.table("nation").join(cat.table("region"), c("n_regionkey") == c("r_regionkey"))
    brands = cat.brand_map
    of_brand = F.ascii(F.substring("bm_brand", -1, 1)) % 5
    row = lambda who, field, value: [who.alias("recipient"), F.lit(field).alias("field"), value.alias("value")]
    return quality.union_all(
        [
            places.select(*row(F.concat(F.lit("region "), "r_name"), "province", c("n_name"))),
            places.select(*row(F.lit("head office"), "province", c("n_name"))),
            brands.select(*row(F.concat(F.lit("solution "), "bm_brand_solution"), "brand", c("bm_brand"))),
            places.select(*row(F.concat(F.lit("buyer "), "r_name"), "province", c("n_name"))),
            brands.join(cat.table("region"), of_brand == c("r_regionkey")).select(*row(F.concat(F.lit("buyer "), "r_name"), "brand", c("bm_brand"))),
        ]
    )


@query("recipient_extracts", on(fx.CLEAN_SQL + RECIPIENTS_SQL, f"SELECT recipient, count(*) AS n, {money('revenue_12m_zar')} AS revenue FROM extracts GROUP BY recipient"))
def _extracts_by_recipient(cat):
    path = cat.scratch("extracts")
    rows = cat.clean.select("product_id", "brand", "province", "revenue_12m_zar")
    files.write_by_recipient(files.recipient_extracts(rows, _recipients(cat), ["product_id"]), "recipient", path, spread=None)
    return files.scan_parquet(cat.spark, path).groupBy("recipient").agg(F.count(F.lit(1)).alias("n"), reports.money("revenue_12m_zar").alias("revenue"))


# Models ----------------------------------------------------------------------------------------------------------------
ENCODED = ("category", "brand_solution", "sales_channel")


@query(
    "ml_encode",
    on_clean("SELECT product_id, " + ", ".join(f"CASE WHEN {k} IS NULL THEN -1 ELSE (dense_rank() OVER (PARTITION BY {k} IS NULL ORDER BY {k}) - 1)::INTEGER END AS {k}_code" for k in ENCODED) + " FROM clean"),
)
def _encode(cat):
    rows = _written(cat, cat.clean.select("product_id", *ENCODED), "encoded_rows")
    return models.encoded(rows, models.ordinal(rows, ENCODED), ENCODED).select("product_id", *[f"{k}_code" for k in ENCODED])


#: Rows that the price model and the segments use at most, by the keys' hash. Fixed values.
PRICE_ROWS, SEGMENT_ROWS = 600_000, 500_000


@query("ml_price_model")
def _price(cat):
    _, predicted = models.price_model(_written(cat, cat.clean, "model_rows"), PRICE_ROWS)
    return models.regression_metrics(predicted, "price_zar", "prediction")


@query(
    "regression_metrics",
    on_clean("SELECT round(1 - sse / (v * n), 4) AS r2, round(mae, 2) AS mae, round(m, 2) AS mean_label, n FROM (SELECT count(y) AS n, avg(y) AS m, avg(abs(y - p)) AS mae, sum((y - p) * (y - p)) AS sse, var_pop(y) AS v FROM (SELECT price_zar AS y, cost_zar * 1.5 AS p FROM clean))"),
)
def _regression(cat):
    rows = cat.clean.select(c("price_zar").alias("y"), (c("cost_zar") * 1.5).alias("p"))
    return models.regression_metrics(rows, "y", "p")


FOREST_SQL = fx.CLEAN_SQL + ",\n" + forest.forest_sql("clean", models.ANOMALY, draw, uniform)
FLAGGED_SCORES = "SELECT product_id, score, score - q AS anomaly_raw, score - q < 0 AS is_anomaly FROM scored, (SELECT quantile_cont(score, 0.005) AS q FROM scored)"
ANOMALIES_SQL = "SELECT " + ", ".join(f"clean.{k}" if k != "anomaly_raw" else "f.anomaly_raw" for k in models.ANOMALY_COLUMNS) + f" FROM ({FLAGGED_SCORES}) f JOIN clean USING (product_id) WHERE f.is_anomaly ORDER BY f.anomaly_raw, product_id LIMIT 2000"


@query("ml_anomaly_score", on(FOREST_SQL, FLAGGED_SCORES))
def _score(cat):
    rows = _written(cat, cat.clean.select("product_id", *models.ANOMALY), "forest_rows")
    return models.flag_lowest(models.scores(rows), "score").select("product_id", "score", "anomaly_raw", "is_anomaly")


@query("forest_nodes", on(FOREST_SQL, "SELECT tree, node, feature, cut, path FROM forest"))
def _forest(cat):
    return forest.forest(_written(cat, cat.clean, "forest_rows"), models.ANOMALY).drop("size")


query(
    "anomaly_threshold",
    on_clean("SELECT product_id, margin_pct - q AS anomaly_raw, margin_pct - q < 0 AS is_anomaly FROM clean, (SELECT quantile_cont(margin_pct, 0.005) AS q FROM clean) WHERE margin_pct IS NOT NULL"),
)(lambda cat: models.flag_lowest(_written(cat, cat.clean.where("margin_pct is not null").select("product_id", "margin_pct"), "margins"), "margin_pct").select("product_id", "anomaly_raw", "is_anomaly"))


def _anomalies(cat) -> DataFrame:
    """The lowest of all scored rows."""
    return models.anomalies(_written(cat, cat.clean.select(*[k for k in models.ANOMALY_COLUMNS if k != "anomaly_raw"]), "forest_rows"))


@query("write_anomalies", on(FOREST_SQL, ANOMALIES_SQL))
def _write_anomalies(cat):
    found = _written(cat, _anomalies(cat), "anomalies")
    files.write_delimited(found, cat.scratch("anomalies_text"), single=True)
    return found


REVIEW = "product_name, category, brand, product_id"
query(
    "anomaly_review",
    on(FOREST_SQL, f"SELECT {REVIEW}, {money('price_zar')} AS price, {money('cost_zar')} AS cost, sum(margin_pct) / 100 AS margin, sum(anomaly_raw) AS score FROM ({ANOMALIES_SQL}) GROUP BY ALL ORDER BY score, {REVIEW} LIMIT 50"),
)(lambda cat: reports.anomaly_review(_anomalies(cat)))
query(
    "standardize",
    on_clean("SELECT product_id, round((price_zar - avg(price_zar) OVER ()) / stddev_pop(price_zar) OVER (), 6) AS price_zar_z, round((margin_pct - avg(margin_pct) OVER ()) / stddev_pop(margin_pct) OVER (), 6) AS margin_pct_z FROM clean"),
)(
    lambda cat: models.standardised(cat.clean.select("product_id", "price_zar", "margin_pct"), ["price_zar", "margin_pct"]).select(
        "product_id", F.round("price_zar_z", 6).alias("price_zar_z"), F.round("margin_pct_z", 6).alias("margin_pct_z")
    )
)
query("ml_segments")(lambda cat: models.segments(_written(cat, cat.clean.select("product_id", *models.SEGMENT), "segment_rows"), cap=SEGMENT_ROWS).select("product_id", "segment"))
#: Centres in standardised price, margin, units and rating. Fixed values.
CENTRES = ((-0.9, -0.5, 0.8, 0.1), (0.9, 0.4, 0.6, 0.5), (0.2, 0.9, -0.9, -0.8), (0.1, -0.8, -0.7, 0.9))
STANDARD = ", ".join(f"coalesce(({k} - avg({k}) OVER ()) / nullif(stddev_pop({k}) OVER (), 0), 0) AS {k}_z" for k in models.SEGMENT)
AWAY = ["(" + " + ".join(f"({k}_z - ({v!r}::DOUBLE)) * ({k}_z - ({v!r}::DOUBLE))" for k, v in zip(models.SEGMENT, centre, strict=True)) + ")" for centre in CENTRES]
query(
    "segment_assign",
    on_clean("SELECT product_id, CASE " + " ".join(f"WHEN {x} <= least({', '.join(AWAY)}) THEN {j}" for j, x in enumerate(AWAY)) + " END AS segment FROM (SELECT product_id, " + STANDARD + " FROM clean WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in models.SEGMENT) + ")"),
)(
    lambda cat: models.assigned(
        models.standardised(cat.clean.dropna(subset=list(models.SEGMENT)), models.SEGMENT), [f"{k}_z" for k in models.SEGMENT], CENTRES
    ).select("product_id", "segment")
)
query(
    "segment_profile",
    on_clean(f"SELECT brand_solution AS segment, count(*) AS products, {mean2('price_zar')} AS avg_price, {mean2('margin_pct')} AS avg_margin_pct, {mean2('units_sold_12m', 'DECIMAL(18,2)')} AS avg_units_12m, {mean2('rating')} AS avg_rating, {money('revenue_12m_zar')} AS revenue_12m FROM clean GROUP BY brand_solution"),
)(lambda cat: reports.segment_profile(cat.clean.withColumnRenamed("brand_solution", "segment")))
