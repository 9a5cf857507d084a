"""A dirty catalog derived from an order schema: the same definition as Spark columns and as DuckDB SQL.

lineitem joined to part, orders, customer and nation gives one raw product record per line; a hash of the keys chooses how
each value is spoiled (quarrymill.functions.corrupting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import corrupting as G
from quarrymill.operators.lookup import brand_map
from quarrymill.plans.cleaning import CatalogRules

CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PERISHABLE = ("ECONOMY", "SMALL")
GROUPS = ("Perishable products", "Ambient products")
CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SOLUTIONS = ("House Brands", "Principal Brands", "Private Label")
REGIONS = 25

RULES = CatalogRules(
    channels=CHANNELS,
    regions={f"nation_{k}": f"NATION_{k}" for k in range(REGIONS)} | {f"n{k}": f"NATION_{k}" for k in range(REGIONS)},
    categories=CATEGORIES,
    perishable=PERISHABLE,
    groups=GROUPS,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean values of every record, as typed columns, and the record's hash h.

    Tables that grow with the input are joined by shuffles at every size, so that what moves grows as the input does. Orders
    take their customer's nation first, the lines then move once for their order and once for their part, with what is
    needed of them alone, as whole numbers and dates, which take fewer bytes on the way; names of nations are met last.
    """
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    placed = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(
        t("customer").select("c_custkey", "c_nationkey").hint("merge"), c("o_custkey") == c("c_custkey")
    ).select("o_orderkey", "o_orderpriority", "c_nationkey")
    parts = t("part").select("p_partkey", "p_name", "p_brand", "p_type")
    lines = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(c("l_extendedprice") * 100).cast("bigint").alias("cents"),
        (F.round(c("l_quantity")).cast("bigint") * 50 + 50).alias("grams"),
        c("l_shipdate").cast("date").alias("added"),
    )
    rows = (
        lines.join(placed.hint("merge"), c("l_orderkey") == c("o_orderkey"))
        .join(parts.hint("merge"), c("l_partkey") == c("p_partkey"))
        .join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    )
    h = c("l_orderkey") * 1000003 + c("l_partkey") * 7919 + c("l_suppkey") * 613 + c("l_linenumber") * 31
    return rows.select(
        h.alias("h"),
        (c("l_orderkey") * 8 + c("l_linenumber")).cast("bigint").alias("id"),
        c("p_name").alias("name"),
        c("p_brand").alias("brand"),
        c("p_type").alias("category"),
        c("o_orderpriority").alias("channel"),
        c("n_name").alias("region"),
        F.concat(F.lit("N"), c("n_nationkey").cast("string")).alias("region_code"),
        "cents",
        "grams",
        "added",
    ).withColumn("cost_cents", F.expr("(cents * (5045 + 3 * (h % 1009))) div 10090"))


#: Columns that are spoiled by one piece of generated code: beyond some eight it is too long to be compiled by the JVM.
TOGETHER = 4


def dirty(base: DataFrame) -> DataFrame:
    """The fifteen raw text columns of the clean base.

    A few columns at a time are fields of a struct that a generator takes apart: Spark keeps their code in methods that are
    short enough to be compiled, where one projection of all of them is interpreted.
    """
    c, h = F.col, F.col("h")
    b = lambda prime: G.band(h, prime)
    brand = G.sentinels(G.text_variants(c("brand"), b(107), 4, 8, 12), b(107), 12)
    category = F.when(b(109) < 6, F.upper("category")).when(b(109) < 12, G.padded(F.lower("category"))).otherwise(
        G.legacy(c("category"), h, b(109), 12, 18)
    )
    channel = F.when(b(113) < 5, F.upper("channel")).when(b(113) < 10, G.padded(F.lower("channel"))).when(b(113) < 12, "").otherwise(c("channel"))
    region = G.abbreviate(
        F.when(b(127) < 12, F.lower("region")).when(b(127) < 16, G.padded(c("region"))).when(b(127) < 18, "").otherwise(c("region")),
        c("region_code"), b(127), 8,
    )
    raw = {
        "product_id": F.concat(F.lit("PRD-"), F.lpad(c("id").cast("string"), 10, "0")),
        "sku": F.when(b(131) < 2, "").otherwise(F.concat(F.lit("SKU"), (h % 1000000000).cast("string"))),
        "product_name": G.name_noise(c("name"), b(137)),
        "category": category,
        "brand": brand,
        "sales_channel": channel,
        "province": region,
        "price_zar": G.price_text(c("cents"), b(101)),
        "cost_zar": G.spell(c("cost_cents")),
        "weight_kg": G.weight_text(c("grams"), b(139)),
        "stock_qty": G.stock_text(h % 500, h, b(149)),
        "units_sold_12m": G.units_text(h % 9001, h, b(151)),
        "date_added": G.date_text(c("added"), h, b(103)),
        "is_active": G.boolean_text(h),
        "rating": G.rating_text(h % 41 + 10, h, b(157)),
    }
    names, out = list(raw), base
    for k in range(0, len(names), TOGETHER):
        out = out.select("*", F.inline(F.array(F.struct(*[raw[n].alias(f"raw_{n}") for n in names[k : k + TOGETHER]]))))
    return out.select(*[c(f"raw_{n}").alias(n) for n in names])


def dirty_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table. The joins' shuffles have dealt the records by then, so that spoiling them runs on all cores."""
    return dirty(clean_base(spark, sf_dir))


def category_groups(spark: SparkSession) -> DataFrame:
    """Dimension: category and its product group."""
    rows = [(c, GROUPS[0] if c in PERISHABLE else GROUPS[1]) for c in CATEGORIES]
    return spark.createDataFrame(rows, "category string, product_group string")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = category_groups(spark).withColumnRenamed("category", "category")
    parts = table(spark, sf_dir, "part")
    return brand_map(parts, "p_brand", "p_type", "p_partkey", SOLUTIONS, groups)


#: The tables that the dirty catalog is derived from.
RAW_SOURCES = ("lineitem", "part", "orders", "customer", "nation")
#: Bands (prime, first, last) whose rows are invalid, by the reason that they get: see the corrupting columns above.
INVALID_BANDS = {"bad_price": (101, 18, 22), "bad_date": (103, 93, 99), "unknown_brand": (107, 12, 14)}


def reject_rates() -> dict[str, float]:
    """Expected share of raw rows with each reason, and of rejected rows: bands of different primes are independent."""
    share = {m: sum(first <= r * 100 // p <= last for r in range(p)) / p for m, (p, first, last) in INVALID_BANDS.items()}
    good = 1.0
    for rate in share.values():
        good *= 1 - rate
    return share | {"rejected_rows": 1 - good}


# The same as SQL ------------------------------------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _pick(values) -> str:
    return f"({_list(values)})[1 + h % {len(values)}]"


def _band(prime: int) -> str:
    return f"((h % {prime}) * 100 // {prime})"


def _doubled(x: str) -> str:
    return f"regexp_replace({x}, '^([^ ]*) ', '\\1  ')"


def _spell(cents: str) -> str:
    return f"(({cents}) // 100)::VARCHAR || '.' || lpad((({cents}) % 100)::VARCHAR, 2, '0')"


_KILOS = "(grams // 1000)::VARCHAR || '.' || lpad((grams % 1000)::VARCHAR, 3, '0')"

BASE_SQL = """
base0 AS (
  SELECT l_orderkey * 1000003 + l_partkey * 7919 + l_suppkey * 613 + l_linenumber * 31 AS h,
         l_orderkey * 8 + l_linenumber AS id, p_name AS name, p_brand AS brand, p_type AS category,
         o_orderpriority AS channel, n_name AS region, 'N' || n_nationkey AS region_code,
         round(l_extendedprice * 100)::BIGINT AS cents, round(l_quantity)::BIGINT * 50 + 50 AS grams,
         l_shipdate::DATE AS added
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
base AS (SELECT *, (cents * (5045 + 3 * (h % 1009))) // 10090 AS cost_cents FROM base0)"""

RAW_SQL = f"""{BASE_SQL},
raw AS (
  SELECT 'PRD-' || lpad(id::VARCHAR, 10, '0') AS product_id,
    CASE WHEN {_band(131)} < 2 THEN '' ELSE 'SKU' || (h % 1000000000) END AS sku,
    CASE WHEN {_band(137)} < 4 THEN {_doubled("upper(name)")} WHEN {_band(137)} < 8 THEN {_doubled("lower(name)")}
         ELSE name END AS product_name,
    CASE WHEN {_band(109)} < 6 THEN upper(category) WHEN {_band(109)} < 12 THEN ' ' || lower(category) || ' '
         WHEN {_band(109)} < 18 THEN {_pick(G.LEGACY_NAMES)} ELSE category END AS category,
    CASE {_band(107)} WHEN 12 THEN 'NULL' WHEN 13 THEN 'unknown' WHEN 14 THEN '' ELSE
      CASE WHEN {_band(107)} < 4 THEN upper(brand) WHEN {_band(107)} < 8 THEN lower(brand)
           WHEN {_band(107)} < 12 THEN ' ' || brand || ' ' ELSE brand END END AS brand,
    CASE WHEN {_band(113)} < 5 THEN upper(channel) WHEN {_band(113)} < 10 THEN ' ' || lower(channel) || ' '
         WHEN {_band(113)} < 12 THEN '' ELSE channel END AS sales_channel,
    CASE WHEN {_band(127)} < 8 THEN region_code WHEN {_band(127)} < 12 THEN lower(region)
         WHEN {_band(127)} < 16 THEN ' ' || region || ' ' WHEN {_band(127)} < 18 THEN '' ELSE region END AS province,
    CASE WHEN {_band(101)} < 12 THEN 'R ' || format('{{:,}}', cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0')
         WHEN {_band(101)} < 18 THEN 'ZAR' || {_spell("cents")} WHEN {_band(101)} < 20 THEN '-' || {_spell("cents")}
         WHEN {_band(101)} = 20 THEN 'N/A' WHEN {_band(101)} = 21 THEN '' WHEN {_band(101)} = 22 THEN 'NULL'
         ELSE {_spell("cents")} END AS price_zar,
    {_spell("cost_cents")} AS cost_zar,
    CASE WHEN {_band(139)} < 7 THEN grams::VARCHAR WHEN {_band(139)} < 9 THEN '-' || {_KILOS}
         WHEN {_band(139)} < 12 THEN '' ELSE {_KILOS} END AS weight_kg,
    CASE WHEN {_band(149)} < 3 THEN {_pick(G.WORD_NUMBERS)} WHEN {_band(149)} < 5 THEN '-' || (h % 500)
         ELSE (h % 500)::VARCHAR END AS stock_qty,
    CASE WHEN {_band(151)} < 2 THEN {_pick(G.WORD_NUMBERS)} WHEN {_band(151)} = 2 THEN ''
         ELSE (h % 9001) || '.0' END AS units_sold_12m,
    CASE WHEN {_band(103)} < 60 THEN strftime(added, '%Y-%m-%d') WHEN {_band(103)} < 80 THEN strftime(added, '%d/%m/%Y')
         WHEN {_band(103)} < 93 THEN strftime(added, '%m-%d-%Y') WHEN {_band(103)} < 96 THEN {_pick(G.INVALID_DATES)}
         ELSE '' END AS date_added,
    {_pick(G.BOOLEAN_TOKENS)} AS is_active,
    CASE WHEN {_band(157)} < 2 THEN {_pick(G.OFF_RATINGS)} WHEN {_band(157)} < 5 THEN ''
         ELSE ((h % 41 + 10) // 10) || '.' || ((h % 41 + 10) % 10) END AS rating
  FROM base)"""

_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$'"


def number_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), {_NUMBER}) THEN try_cast(trim({x}) AS DOUBLE) END"


def integer_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+$') THEN try_cast(trim({x}) AS INTEGER) END"


def folded_sql(x: str) -> str:
    return f"lower(replace(trim({x}), ' and ', ' & '))"


def one_of_sql(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


PRICE_SQL = number_sql("replace(replace(replace(upper(trim(price_zar)), 'ZAR', ''), 'R', ''), ',', '')")
DATE_SQL = "coalesce(" + ", ".join(f"try_strptime(trim(date_added), '{f}')" for f in ("%Y-%m-%d", "%d/%m/%Y", "%m-%d-%Y")) + ")::DATE"

CLEANED_SQL = f"""{RAW_SQL},
brand_first AS (
  SELECT p_brand, arg_min(p_type, p_partkey) AS category FROM part GROUP BY p_brand),
groups AS (SELECT unnest({_list(CATEGORIES)}) AS category),
category_groups AS (
  SELECT category, CASE WHEN category IN ('ECONOMY', 'SMALL') THEN '{GROUPS[0]}' ELSE '{GROUPS[1]}' END AS product_group
  FROM groups),
brand_map AS (
  SELECT lower(p_brand) AS bm_brand_key, p_brand AS bm_brand,
         ({_list(SOLUTIONS)})[1 + regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER % {len(SOLUTIONS)}] AS bm_brand_solution,
         category AS bm_primary_category, product_group AS bm_product_group
  FROM brand_first JOIN category_groups USING (category)),
cleaned AS (
  SELECT *, trim(product_id) AS pid,
    CASE WHEN trim(sku) <> '' THEN trim(sku) END AS sku_c,
    regexp_replace(trim(product_name), '\\s+', ' ', 'g') AS pname,
    CASE WHEN {folded_sql("brand")} NOT IN ('null', 'unknown', '') THEN {folded_sql("brand")} END AS brand_key,
    {PRICE_SQL} AS price_c,
    {number_sql("cost_zar")} AS cost_c,
    CASE WHEN ({number_sql("weight_kg")}) > 50 THEN ({number_sql("weight_kg")}) / 1000
         WHEN ({number_sql("weight_kg")}) > 0 THEN {number_sql("weight_kg")} END AS weight_c,
    CASE WHEN ({integer_sql("stock_qty")}) >= 0 THEN {integer_sql("stock_qty")}
         WHEN ({integer_sql("stock_qty")}) < 0 THEN 0 END AS stock_c,
    CASE WHEN ({number_sql("units_sold_12m")}) >= 0 THEN trunc({number_sql("units_sold_12m")})::INTEGER END AS units_c,
    {DATE_SQL} AS date_c,
    CASE WHEN upper(trim(is_active)) IN ('Y', '1', 'TRUE', 'YES', 'ACTIVE') THEN true
         WHEN upper(trim(is_active)) IN ('N', '0', 'FALSE', 'NO') THEN false END AS active_c,
    CASE WHEN ({number_sql("rating")}) BETWEEN 0 AND 5 THEN {number_sql("rating")} END AS rating_c,
    {one_of_sql("lower(trim(sales_channel))", {c.lower(): c for c in CHANNELS})} AS channel_c,
    {one_of_sql("lower(trim(province))", RULES.regions)} AS province_c,
    {one_of_sql(folded_sql("category"), {c.lower(): c for c in CATEGORIES})} AS category_mapped
  FROM raw)"""

FLAGGED_SQL = f"""{CLEANED_SQL},
derived AS (
  SELECT c.*, bm_brand AS brand_final, bm_brand_solution AS brand_solution,
    coalesce(category_mapped, bm_primary_category) AS category_final,
    CASE WHEN price_c > 0 AND cost_c IS NOT NULL THEN round((price_c - cost_c) / price_c * 100, 2) END AS margin_pct,
    CASE WHEN price_c > 0 AND units_c IS NOT NULL THEN round(price_c * units_c, 2) END AS revenue_12m_zar
  FROM cleaned c LEFT JOIN brand_map ON brand_key = bm_brand_key),
flagged AS (
  SELECT *,
    CASE WHEN category_final IN ('ECONOMY', 'SMALL') THEN '{GROUPS[0]}'
         WHEN category_final IS NOT NULL THEN '{GROUPS[1]}' END AS product_group,
    CASE WHEN pid IS NULL OR pid = '' THEN 'missing_id;' ELSE '' END
    || CASE WHEN price_c IS NULL OR price_c <= 0 THEN 'bad_price;' ELSE '' END
    || CASE WHEN date_c IS NULL THEN 'bad_date;' ELSE '' END
    || CASE WHEN brand_final IS NULL THEN 'unknown_brand;' ELSE '' END
    || CASE WHEN category_final IS NULL THEN 'unknown_category;' ELSE '' END AS reject_reason,
    NOT (pid IS NULL OR pid = '' OR price_c IS NULL OR price_c <= 0 OR date_c IS NULL OR brand_final IS NULL
         OR category_final IS NULL) AS is_valid
  FROM derived)"""

CLEAN_SQL = f"""{FLAGGED_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY date_c DESC, price_c DESC NULLS LAST, cost_c DESC NULLS LAST,
    sku_c DESC NULLS LAST, pname DESC NULLS LAST, units_c DESC NULLS LAST, stock_c DESC NULLS LAST,
    weight_c DESC NULLS LAST, rating_c DESC NULLS LAST, province_c DESC NULLS LAST, channel_c DESC NULLS LAST,
    active_c DESC NULLS LAST, brand_final DESC NULLS LAST, category_final DESC NULLS LAST) AS rn
  FROM flagged WHERE is_valid),
clean AS (
  SELECT pid AS product_id, sku_c AS sku, pname AS product_name, product_group, category_final AS category,
    brand_final AS brand, brand_solution, channel_c AS sales_channel, province_c AS province, price_c AS price_zar,
    cost_c AS cost_zar, margin_pct, weight_c AS weight_kg, stock_c AS stock_qty, units_c AS units_sold_12m,
    revenue_12m_zar, date_c AS date_added, active_c AS is_active, rating_c AS rating
  FROM ranked WHERE rn = 1),
quarantine AS (
  SELECT product_id, sku, product_name, category, brand, sales_channel, province, price_zar, cost_zar, weight_kg,
    stock_qty, units_sold_12m, date_added, is_active, rating, reject_reason
  FROM flagged WHERE NOT is_valid)"""
