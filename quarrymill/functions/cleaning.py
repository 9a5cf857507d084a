"""Cleaning of loosely formatted text columns: every function maps Columns to a Column and yields null where nothing fits.

A parse never raises: casts are try_cast behind a numeric pattern, so ANSI mode changes nothing. trim() removes spaces only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers as text: no exponents, suffixes, NaN or infinities.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
INTEGER = r"^[+-]?[0-9]+$"
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM-dd-yyyy")
#: Fixed values.
TRUE_TOKENS = ("Y", "1", "TRUE", "YES", "ACTIVE")
FALSE_TOKENS = ("N", "0", "FALSE", "NO")
JUNK_KEYS = ("null", "unknown", "")
GRAMS_ABOVE = 50


def blank_to_null(x: Column) -> Column:
    """The trimmed text; null when blank."""
    return F.when(F.trim(x) != "", F.trim(x))


def collapse_whitespace(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def folded(x: Column) -> Column:
    """Key form: trimmed, ' and ' read as ' & ', lower case. The replacement comes before lower-casing: ' AND ' stays."""
    return F.lower(F.replace(F.trim(x), F.lit(" and "), F.lit(" & ")))


def lookup_key(x: Column, junk: tuple[str, ...] = JUNK_KEYS) -> Column:
    """folded(), null for junk sentinels."""
    return F.when(~folded(x).isin(*junk), folded(x))


def number(x: Column) -> Column:
    """Text to double; null unless it is a plain number."""
    t = F.trim(x)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def integer(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t.rlike(INTEGER), t.try_cast("int"))


def currency(x: Column) -> Column:
    """Upper case, without ZAR, R and thousands commas, to double. Negatives survive."""
    bare = F.upper(F.trim(x))
    for mark in ("ZAR", "R", ","):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return number(bare)


def kilograms(x: Column, grams_above: float = GRAMS_ABOVE) -> Column:
    """Over the bound: grams, divided by 1000; over zero: as it is; else null. The bound itself counts as kilograms."""
    n = number(x)
    return F.when(n > grams_above, n / 1000).when(n > 0, n)


def clamp_negative(x: Column) -> Column:
    """Integers, negatives as 0; words null."""
    n = integer(x)
    return F.when(n >= 0, n).when(n < 0, F.lit(0))


def non_negative(x: Column) -> Column:
    """Numbers from zero, as integers; negatives and words null."""
    n = number(x)
    return F.when(n >= 0, n.try_cast("int"))


def may_fit(x: Column, format_: str) -> Column:
    """Whether the third character lets a text have the date format: a test without the exception that each failed parse costs.

    A first field of two letters has two digits and its separator behind; one of four letters has four digits or more.
    """
    width = len(format_) - len(format_.lstrip(format_[0]))
    third = F.substring(x, 3, 1)
    return third == format_[width] if width == 2 else third.between("0", "9") if width > 3 else F.lit(True)


def multi_format_date(x: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that parses."""
    t = F.trim(x)
    return F.coalesce(*[F.when(may_fit(t, f), F.try_to_date(t, f)) for f in formats])


def token_boolean(x: Column) -> Column:
    t = F.upper(F.trim(x))
    return F.when(t.isin(*TRUE_TOKENS), True).when(t.isin(*FALSE_TOKENS), False)


def in_range(x: Column, low: float = 0, high: float = 5) -> Column:
    n = number(x)
    return F.when((n >= low) & (n <= high), n)


def mapped(key: Column, table: dict[str, str]) -> Column:
    """Canonical value of a key by a small map; null where it has none. One map access whatever the table's size."""
    pairs = [F.lit(s) for pair in table.items() for s in pair]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def canonical(x: Column, values: tuple[str, ...]) -> Column:
    """The canonical spelling of an enumeration's value, by trimmed lower-case equality."""
    return mapped(F.lower(F.trim(x)), {v.lower(): v for v in values})


def alias(x: Column, aliases: dict[str, str]) -> Column:
    """Canonical name of an alias (full name or short code), by trimmed lower-case equality."""
    return mapped(F.lower(F.trim(x)), {k.lower(): v for k, v in aliases.items()})


def canonical_folded(x: Column, values: tuple[str, ...]) -> Column:
    """As canonical(), after folded()."""
    return mapped(folded(x), {v.lower(): v for v in values})


def margin_pct(price: Column, cost: Column) -> Column:
    """Per cent of the price, two decimals; null unless the price is positive and the cost known."""
    return F.when((price > 0) & cost.isNotNull(), F.round((price - cost) / F.when(price != 0, price) * 100, 2))


def revenue(price: Column, units: Column) -> Column:
    return F.when((price > 0) & units.isNotNull(), F.round(price * units, 2))


def product_group(category: Column, first: tuple[str, ...], names: tuple[str, str]) -> Column:
    return F.when(category.isin(*first), names[0]).when(category.isNotNull(), names[1])


#: Reject reasons in their order. Fixed values.
REASONS = ("missing_id", "bad_price", "bad_date", "unknown_brand", "unknown_category")


def failures(pid: Column, price: Column, date: Column, brand: Column, category: Column) -> list[Column]:
    """One boolean per reason, never null."""
    return [
        pid.isNull() | F.coalesce(pid == "", F.lit(False)),
        price.isNull() | F.coalesce(price <= 0, F.lit(False)),
        date.isNull(),
        brand.isNull(),
        category.isNull(),
    ]


def reject_reason(*fields: Column) -> Column:
    """The failing rules' names in order, each followed by a semicolon; empty when all hold."""
    return F.concat(*[F.when(f, f"{r};").otherwise("") for f, r in zip(failures(*fields), REASONS, strict=True)])


def is_valid(*fields: Column) -> Column:
    return ~reduce(lambda a, b: a | b, failures(*fields))
