"""Deterministic corruption of clean columns, for tests of cleaning flows.

A row's hash and a prime give a band from 0 to 99 that depends on no partitioning; bands choose what happens to a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WORD_NUMBERS = ("twelve", "five", "twenty", "none", "out of stock")
BOOLEAN_TOKENS = ("Y", "N", "1", "0", "TRUE", "false", "yes", "no", "Active", "")
INVALID_DATES = ("2023/13/45", "31-02-2022", "not_a_date", "0000-00-00", "2023-02-29")
LEGACY_NAMES = (
    "Groceries",
    "Baking and baking aids",
    "Snacks and confectionery",
    "Perishables",
    "Household and personal care",
)
OFF_RATINGS = ("99", "-1", "10.5")
JUNK_BRANDS = ("NULL", "unknown", "")


def band(h: Column, prime: int) -> Column:
    return F.floor((h % prime) * 100 / prime).cast("int")


def pick(h: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def padded(x: Column) -> Column:
    return F.concat(F.lit(" "), x, F.lit(" "))


def spell(cents: Column) -> Column:
    """Whole cents as plain text with two decimals."""
    whole = F.floor(cents / 100).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def text_variants(x: Column, b: Column, upper: int, lower: int, pad: int) -> Column:
    """Upper case below the first bound, lower below the second, padded below the third, else clean."""
    return F.when(b < upper, F.upper(x)).when(b < lower, F.lower(x)).when(b < pad, padded(x)).otherwise(x)


def ampersand_words(x: Column) -> Column:
    """'&' spelled out where there is one, else trailing spaces."""
    return F.when(x.contains("&"), F.replace(x, F.lit("&"), F.lit("and"))).otherwise(F.concat(x, F.lit("  ")))


def sentinels(x: Column, b: Column, start: int, values: tuple[str, ...] = JUNK_BRANDS) -> Column:
    """One junk value per band from start on."""
    out = F.when(F.lit(False), "")
    for k, v in enumerate(values):
        out = out.when(b == start + k, v)
    return out.otherwise(x)


def legacy(x: Column, h: Column, b: Column, start: int, end: int, names: tuple[str, ...] = LEGACY_NAMES) -> Column:
    return F.when(b.between(start, end - 1), pick(h, names)).otherwise(x)


def price_text(cents: Column, b: Column) -> Column:
    """Mostly plain; some with R and commas, ZAR, negative, or junk."""
    whole = F.floor(cents / 100).cast("bigint")
    grouped = F.concat(F.format_number(whole, 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return (
        F.when(b < 12, F.concat(F.lit("R "), grouped))
        .when(b < 18, F.concat(F.lit("ZAR"), spell(cents)))
        .when(b < 20, F.concat(F.lit("-"), spell(cents)))
        .when(b == 20, "N/A")
        .when(b == 21, "")
        .when(b == 22, "NULL")
        .otherwise(spell(cents))
    )


def weight_text(grams: Column, b: Column) -> Column:
    """Kilograms with three decimals; some in grams, negative or blank."""
    kilos = F.concat(F.floor(grams / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((grams % 1000).cast("string"), 3, "0"))
    return F.when(b < 7, grams.cast("string")).when(b < 9, F.concat(F.lit("-"), kilos)).when(b < 12, "").otherwise(kilos)


def stock_text(n: Column, h: Column, b: Column) -> Column:
    return F.when(b < 3, pick(h, WORD_NUMBERS)).when(b < 5, F.concat(F.lit("-"), n.cast("string"))).otherwise(n.cast("string"))


def units_text(n: Column, h: Column, b: Column) -> Column:
    return F.when(b < 2, pick(h, WORD_NUMBERS)).when(b == 2, "").otherwise(F.concat(n.cast("string"), F.lit(".0")))


def date_text(d: Column, h: Column, b: Column) -> Column:
    return (
        F.when(b < 60, F.date_format(d, "yyyy-MM-dd"))
        .when(b < 80, F.date_format(d, "dd/MM/yyyy"))
        .when(b < 93, F.date_format(d, "MM-dd-yyyy"))
        .when(b < 96, pick(h, INVALID_DATES))
        .otherwise("")
    )


def boolean_text(h: Column) -> Column:
    return pick(h, BOOLEAN_TOKENS)


def rating_text(tenths: Column, h: Column, b: Column) -> Column:
    plain = F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(b < 2, pick(h, OFF_RATINGS)).when(b < 5, "").otherwise(plain)


def name_noise(x: Column, b: Column) -> Column:
    """Upper or lower case with the first space doubled."""
    doubled = lambda c: F.regexp_replace(c, "^([^ ]*) ", "$1  ")
    return F.when(b < 4, doubled(F.upper(x))).when(b < 8, doubled(F.lower(x))).otherwise(x)


def abbreviate(x: Column, code: Column, b: Column, below: int) -> Column:
    return F.when(b < below, code).otherwise(x)


def synthetic_price(base: Column, multiplier: Column, kilos: Column, noise: Column, floor: float = 8.99) -> Column:
    """Base by multiplier by (weight / 0.5)^0.35 by exp(noise), not below the floor, two decimals."""
    return F.round(F.greatest(base * multiplier * F.pow(kilos / 0.5, F.lit(0.35)) * F.exp(noise), F.lit(floor)), 2)
