"""The cleaning flow: raw text -> typed columns -> brand lookup -> valid and quarantined rows -> latest row per id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import cleaning as C
from quarrymill.operators.lookup import latest_per_key, lookup_any

RAW_COLUMNS = (
    "product_id", "sku", "product_name", "category", "brand", "sales_channel", "province", "price_zar", "cost_zar",
    "weight_kg", "stock_qty", "units_sold_12m", "date_added", "is_active", "rating",
)
BRAND_MAP_COLUMNS = ("bm_brand_key", "bm_brand", "bm_brand_solution", "bm_primary_category", "bm_product_group")
CLEAN_COLUMNS = (
    "product_id", "sku", "product_name", "product_group", "category", "brand", "brand_solution", "sales_channel", "province",
    "price_zar", "cost_zar", "margin_pct", "weight_kg", "stock_qty", "units_sold_12m", "revenue_12m_zar", "date_added",
    "is_active", "rating",
)
TIES = ("price_c", "cost_c", "sku_c", "pname", "units_c", "stock_c", "weight_c", "rating_c", "province_c", "channel_c", "active_c", "brand_final", "category_final")


@dataclass(frozen=True)
class CatalogRules:
    """Canonical values of a catalog. The defaults are fixed values."""

    channels: tuple[str, ...] = ("Retail and wholesale", "Food service", "Industrial and contract manufacturing", "Export")
    regions: dict[str, str] = field(
        default_factory=lambda: {
            "western cape": "Western Cape", "wc": "Western Cape",
            "gauteng": "Gauteng", "gp": "Gauteng",
            "kwazulu-natal": "KwaZulu-Natal", "kzn": "KwaZulu-Natal",
            "eastern cape": "Eastern Cape", "ec": "Eastern Cape",
            "mpumalanga": "Mpumalanga", "mp": "Mpumalanga",
            "limpopo": "Limpopo", "lp": "Limpopo",
            "north west": "North West", "nw": "North West",
            "free state": "Free State", "fs": "Free State",
            "northern cape": "Northern Cape", "nc": "Northern Cape",
        }
    )
    categories: tuple[str, ...] = (
        "Dairy", "Convenience Meals", "Value-added Meats", "Baby", "Fresh Mushrooms", "Dry condiments", "Wet condiments",
        "Meal ingredients", "Baking", "Snacking", "Spreads", "Beverages",
    )
    perishable: tuple[str, ...] = ("Dairy", "Convenience Meals", "Value-added Meats", "Baby", "Fresh Mushrooms")
    groups: tuple[str, str] = ("Perishable products", "Ambient products")


#: Typed columns that are parsed by one piece of generated code: of all fifteen it is too long to be compiled by the JVM.
TOGETHER = 4


def clean_columns(raw: DataFrame, rules: CatalogRules) -> DataFrame:
    """The raw columns and fifteen typed ones, each from raw columns only.

    A few typed columns at a time are fields of a struct that is taken apart by a generator: filters and projections that
    follow are not moved into it, so that each column is parsed once, however often the flow refers to it, and the code
    stays in methods that are short enough to be compiled, where what follows one generator of all of them is interpreted.
    """
    c = F.col
    typed = {
        "pid": F.trim(c("product_id")),
        "sku_c": C.blank_to_null(c("sku")),
        "pname": C.collapse_whitespace(c("product_name")),
        "brand_key": C.lookup_key(c("brand")),
        "price_c": C.currency(c("price_zar")),
        "cost_c": C.number(c("cost_zar")),
        "weight_c": C.kilograms(c("weight_kg")),
        "stock_c": C.clamp_negative(c("stock_qty")),
        "units_c": C.non_negative(c("units_sold_12m")),
        "date_c": C.multi_format_date(c("date_added")),
        "active_c": C.token_boolean(c("is_active")),
        "rating_c": C.in_range(c("rating")),
        "channel_c": C.canonical(c("sales_channel"), rules.channels),
        "province_c": C.alias(c("province"), rules.regions),
        "category_mapped": C.canonical_folded(c("category"), rules.categories),
    }
    names, out = list(typed), raw
    for k in range(0, len(names), TOGETHER):
        out = out.select("*", F.inline(F.array(F.struct(*[typed[n].alias(n) for n in names[k : k + TOGETHER]]))))
    return out


def derive(looked_up: DataFrame, rules: CatalogRules) -> DataFrame:
    """Columns from the lookup's result, then those that use them."""
    c = F.col
    return looked_up.withColumns(
        {
            "brand_final": c("bm_brand"),
            "brand_solution": c("bm_brand_solution"),
            "category_final": F.coalesce("category_mapped", "bm_primary_category"),
            "margin_pct": C.margin_pct(c("price_c"), c("cost_c")),
            "revenue_12m_zar": C.revenue(c("price_c"), c("units_c")),
        }
    ).withColumn("product_group", C.product_group(c("category_final"), rules.perishable, rules.groups))


CHECKED = ("pid", "price_c", "date_c", "brand_final", "category_final")


def flagged(raw: DataFrame, brand_map: DataFrame, rules: CatalogRules | None = None) -> DataFrame:
    """Every raw row with its cleaned columns, reject_reason and is_valid (never null)."""
    rules = rules or CatalogRules()
    cleaned = clean_columns(raw, rules)
    found = derive(lookup_any(cleaned, brand_map, "brand_key", "bm_brand_key"), rules)
    fields = [F.col(c) for c in CHECKED]
    return found.withColumns({"reject_reason": C.reject_reason(*fields), "is_valid": C.is_valid(*fields)})


def valid_rows(flags: DataFrame) -> DataFrame:
    return flags.where("is_valid")


def to_clean(rows: DataFrame, *more: str) -> DataFrame:
    """The clean table's nineteen columns, and more ones as they are."""
    source = {
        "product_id": "pid", "sku": "sku_c", "product_name": "pname", "category": "category_final", "brand": "brand_final",
        "sales_channel": "channel_c", "province": "province_c", "price_zar": "price_c", "cost_zar": "cost_c",
        "weight_kg": "weight_c", "stock_qty": "stock_c", "units_sold_12m": "units_c", "date_added": "date_c",
        "is_active": "active_c", "rating": "rating_c",
    }
    return rows.select(*[F.col(source.get(c, c)).alias(c) for c in CLEAN_COLUMNS], *more)


def to_quarantine(flags: DataFrame) -> DataFrame:
    """Rejected rows: the raw columns as they came, and the reason. Not deduplicated."""
    return flags.where("not is_valid").select(*RAW_COLUMNS, "reject_reason")


def clean(flags: DataFrame) -> DataFrame:
    """The latest valid row of each id. Only valid rows compete: an invalid later row evicts no older valid one."""
    return to_clean(latest_per_key(valid_rows(flags), ["pid"], "date_c", TIES))


def clean_and_rejected(flags: DataFrame, *more: str) -> DataFrame:
    """The clean rows (rejected 0), and a row without values (rejected 1) for each rejected one, for figures of both from one scan.

    Valid rows compete as in clean(). Every rejected row stands in a group of its own, so that none is hot, and moves empty
    but for more columns, which clean rows don't have.
    """
    c = F.col
    needed = ["pid", "date_c", *TIES, "product_group", "brand_solution", "margin_pct", "revenue_12m_zar"]
    rows = flags.select(
        *[F.when(c("is_valid"), c(x)).alias(x) for x in needed],
        *[F.when(~c("is_valid"), c(x)).alias(x) for x in more],
        F.when(~c("is_valid"), F.monotonically_increasing_id()).alias("_own"),
    )
    found = latest_per_key(rows, ["pid", "_own"], "date_c", TIES)
    return to_clean(found.withColumn("rejected", c("_own").isNotNull().cast("long")), "rejected", *more)


def with_latest(flags: DataFrame) -> DataFrame:
    """The valid rows, all of them, with is_latest on those that clean() keeps."""
    order = [F.col("date_c").desc_nulls_first(), *[F.col(t).desc_nulls_last() for t in TIES]]
    return valid_rows(flags).withColumn("is_latest", F.row_number().over(W.partitionBy("pid").orderBy(*order)) == 1)


def clean_catalog(raw: DataFrame, brand_map: DataFrame, rules: CatalogRules | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine); one shuffle by id, the lookup is broadcast while it is small."""
    flags = flagged(raw, brand_map, rules)
    return clean(flags), to_quarantine(flags)
