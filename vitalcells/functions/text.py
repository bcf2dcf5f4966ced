"""Number and list formatting for report tables (decimal comma, dot for thousands)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_text(value: Column, digits: int = 3) -> Column:
    """1234.5 as '1.234,500'; null is blank."""
    return blank(F.translate(F.format_number(value, digits), ",.", ".,"))


def count_text(value: Column) -> Column:
    return decimal_text(F.round(value), 0)


def interval_text(low: Column, high: Column, digits: int = 3) -> Column:
    return F.concat(decimal_text(low, digits), F.lit("–"), decimal_text(high, digits))


def blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def keyed_list(key: Column, value: Column, separator: str = " · ") -> Column:
    """Aggregate 'key: value' entries in key order. Meant for report-sized groups."""
    entries = F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["k"].cast("string"), F.lit(": "), e["v"])),
        separator)
