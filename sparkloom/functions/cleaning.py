"""Coercions that turn bad values into nulls, and parsers of printed dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    out = c.try_cast("double")
    return F.when(~F.isnan(out), out)


def day(c: Column) -> Column:
    return F.to_date(c.try_cast("timestamp"))


def banded(c: Column, low: float, high: float) -> Column:
    """c, or null out of the band."""
    return F.when(c.between(low, high), c)


def grouped_number(c: Column) -> Column:
    """'1,234.5' as a double."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def percentage(c: Column) -> Column:
    return F.regexp_replace(c, "%", "").try_cast("double")


def volume(c: Column) -> Column:
    """'12.5K' and '1.2M' as numbers; '-', null and other text as 0."""
    plain = F.regexp_replace(c, "[,KM]", "").try_cast("double")
    scale = F.when(c.endswith("K"), 1e3).when(c.endswith("M"), 1e6).otherwise(1.0)
    return F.coalesce(plain * scale, F.lit(0.0))


def rescaled(c: Column, rate: float) -> Column:
    return c * F.lit(rate)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def printed_date(c: Column, as_of: Column) -> Column:
    """Dates as search results print them, relative ones against as_of; null if unknown.

    Days ago, in Vietnamese or English; hours or minutes (today); '5 thg 3, 2024'; 'Mar 05, 2024'.
    """
    raw = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    ago = F.regexp_extract(raw, r"(?U)(\d+)\s*(?:ngay truoc|ngày trước|days ago)", 1)
    printed = r"(?U)(\d+)\s*thg\s*(\d+)[,\s]*(\d{4})"
    y, m, d = (F.regexp_extract(raw, printed, k).try_cast("int") for k in (3, 2, 1))
    return (
        F.when(ago != "", F.date_sub(as_of, ago.try_cast("int")))
        .when(raw.rlike("gio|giờ|phut|phút|hours|mins"), as_of)
        .when(raw.rlike(printed), F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date"))
        .otherwise(F.try_to_timestamp(F.initcap(raw), F.lit("MMM d, yyyy")).cast("date"))
    )
