"""Normalizers of vendor values and small rating functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (good up to, poor above) by field metric; times in milliseconds.
VITALS = {"LCP": (2500.0, 4000.0), "INP": (200.0, 500.0), "CLS": (0.1, 0.25), "FCP": (1800.0, 3000.0), "TTFB": (800.0, 1800.0)}


def price(raw: Column) -> Column:
    """A price string without $, commas and spaces, to two decimals; null if it is no number."""
    return F.round(F.translate(raw.cast("string"), "$, ", "").try_cast("double"), 2)


def currency(raw: Column) -> Column:
    """The first three characters in upper case, USD where there are fewer."""
    code = F.upper(F.trim(raw))
    return F.when(F.length(code) >= 3, F.left(code, F.lit(3))).otherwise(F.lit("USD"))


def availability(raw: Column) -> Column:
    """in_stock, out_of_stock, preorder or unknown, by the first that the text names."""
    said = F.lower(F.coalesce(raw, F.lit("")))
    has = lambda *words: F.greatest(*[said.contains(w).cast("int") for w in (*words, "\0")]) == 1
    return (
        F.when(has("out of stock", "out_of_stock", "outofstock", "unavailable"), "out_of_stock")
        .when(has("in stock", "in_stock", "instock", "available"), "in_stock")
        .when(has("preorder", "pre-order", "pre_order"), "preorder")
        .otherwise("unknown")
    )


def number(raw: Column, default: float = 0.0) -> Column:
    """A double, or the default where the cast fails."""
    return F.coalesce(raw.try_cast("double"), F.lit(float(default)))


def whole(raw: Column, default: int = 0) -> Column:
    """A long, or the default where the cast fails."""
    return F.coalesce(raw.try_cast("bigint"), F.lit(default).cast("bigint"))


def bounded(raw: Column) -> Column:
    """A count that is never below zero."""
    return F.greatest(F.lit(0).cast("bigint"), whole(raw))


def micros(raw: Column) -> Column:
    return raw / F.lit(1_000_000)


def rating(metric: Column, value: Column) -> Column:
    """good, needs-improvement or poor by the metric's limits; unknown for other metrics and nulls."""
    out = F.lit("unknown")
    for name, (good, poor) in VITALS.items():
        mine = F.when(value.isNull(), "unknown").when(value <= good, "good").when(value <= poor, "needs-improvement").otherwise("poor")
        out = F.when(metric == name, mine).otherwise(out)
    return out


def lab_layout_shift(p75: Column) -> Column:
    """A layout shift that a lab API gives in hundredths above 1."""
    return F.when(p75 > 1, p75 / 100).otherwise(p75)


def parsed_date(raw: Column) -> Column:
    """A date in any of the registry formats, else null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "yyyy.MM.dd")
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in formats])


def age_years(created: Column, as_of: Column) -> Column:
    """Years of registration, to two decimals."""
    return F.round(F.date_diff(as_of, created) / 365.25, 2)


def overlaps(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """Whether two date ranges share a day, ends included; false where a date is missing."""
    return F.coalesce((start <= window_end) & (end >= window_start), F.lit(False))


def truncated(text: Column, most: int) -> Column:
    """A text cut to ``most`` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
