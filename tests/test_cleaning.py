"""Value tables of the cleaning columns."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import cleaning as C
from quarrymill.functions import display
from quarrymill.operators.quality import reason_display
from quarrymill.plans.cleaning import CatalogRules

DAY = date(2023, 4, 9)
RULES = CatalogRules()
CASES = {
    "currency": (C.currency, {"1234.56": 1234.56, "R 1,234.56": 1234.56, "ZAR1234.50": 1234.5, " r 12 ": 12.0, "-45.10": -45.1, "N/A": None, "NULL": None, "": None, None: None, "NaN": None, "12d": None, "1e3": None, "Infinity": None}),
    "unit": (C.kilograms, {"0.75": 0.75, "750": 0.75, "50": 50.0, "50.001": 0.050001, "0": None, "-0.4": None, "": None, "abc": None, None: None}),
    "clamp": (C.clamp_negative, {"12": 12, "-7": 0, "0": 0, "twelve": None, "out of stock": None, "": None, "12.0": None, "99999999999": None}),
    "non_negative": (C.non_negative, {"123.0": 123, "0.0": 0, "-3": None, "five": None, "": None, None: None}),
    "date": (C.multi_format_date, {"2023-04-09": DAY, "09/04/2023": DAY, "04-09-2023": DAY, " 2023-04-09 ": DAY, "2023/13/45": None, "31-02-2022": None, "not_a_date": None, "0000-00-00": None, "2023-02-29": None, "": None, None: None}),
    "boolean": (C.token_boolean, {"Y": True, "yes": True, "1": True, "Active": True, "false": False, "0": False, "no": False, "": None, "maybe": None, None: None}),
    "range": (C.in_range, {"0": 0.0, "5": 5.0, "4.3": 4.3, "5.1": None, "99": None, "-1": None, "10.5": None, "": None}),
    "key": (C.lookup_key, {"Salt and Spice": "salt & spice", " SALT & SPICE ": "salt & spice", "SALT AND SPICE": "salt and spice", "NULL": None, "unknown": None, "": None, None: None}),
    "blank": (C.blank_to_null, {" A1 ": "A1", "  ": None, "": None, None: None}),
    "whitespace": (C.collapse_whitespace, {"a  b   c": "a b c", " a\t\tb ": "a b", None: None}),
    "alias": (lambda x: C.alias(x, RULES.regions), {"wc": "Western Cape", "WC": "Western Cape", " western cape ": "Western Cape", "KZN": "KwaZulu-Natal", "xx": None, "": None, None: None}),
    "enum": (lambda x: C.canonical(x, RULES.channels), {"EXPORT": "Export", " food service": "Food service", "shop": None, None: None}),
    "category": (lambda x: C.canonical_folded(x, RULES.categories), {"DAIRY": "Dairy", " baby ": "Baby", "Groceries": None, None: None}),
    "reason": (reason_display, {"a;b;": "a + b", "a;": "a", "": "", None: None}),
}


@pytest.mark.parametrize("name", CASES)
def test_values(spark, name):
    column, table = CASES[name]
    df = spark.createDataFrame([(k,) for k in table], "x string")
    got = {r.x: r.y for r in df.select("x", column(F.col("x")).alias("y")).collect()}
    assert got == table


def test_derived(spark):
    df = spark.createDataFrame([(100.0, 65.0, 3), (0.0, 1.0, 3), (None, 1.0, 3), (10.0, None, None)], "p double, c double, u int")
    rows = df.select(C.margin_pct(F.col("p"), F.col("c")), C.revenue(F.col("p"), F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [(35.0, 300.0), (None, None), (None, None), (None, None)]


def test_reasons_and_validity_agree(spark):
    rows = [("a", 1.0, DAY, "b", "c"), ("", 1.0, DAY, "b", "c"), (None, -1.0, None, None, None), ("a", None, DAY, "b", None)]
    df = spark.createDataFrame(rows, "pid string, p double, d date, b string, c string")
    fields = [F.col(x) for x in ("pid", "p", "d", "b", "c")]
    got = [tuple(r) for r in df.select(C.reject_reason(*fields), C.is_valid(*fields)).collect()]
    assert got == [
        ("", True),
        ("missing_id;", False),
        ("missing_id;bad_price;bad_date;unknown_brand;unknown_category;", False),
        ("bad_price;unknown_category;", False),
    ]


def test_display(spark):
    row = spark.range(1).select(
        display.thousands(F.lit(1234567)), display.percent(F.lit(35.25)), display.billions(F.lit(1.17e12))
    ).first()
    assert tuple(row) == ("1,234,567", "35.3%", "1,170.00 bn")
