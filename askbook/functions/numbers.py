"""Medians, quantiles and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_median(values: Column) -> Column:
    """Interpolated median of an array; null if it is empty."""
    s, n = F.sort_array(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(s, low).cast("double") + F.try_element_at(s, high)) / 2)


#: Moves a share up to the next rank where it falls on one exactly, so that percentile_disc gives element floor(n * share).
NUDGE = 1e-12


def rank_of(column: str, share: float, where: str | None = None, kind: str = "int") -> Column:
    """The aggregate that gives element floor(n * share) (from 0) of the sorted values: counts by value, no list of them."""
    kept = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_disc({share + NUDGE!r}D) WITHIN GROUP (ORDER BY {column}){kept}").cast(kind)


def distribution_of(column: str, kind: str = "int") -> list[Column]:
    """The aggregates n, median, p25 and p75 by nearest rank."""
    return [F.count(column).alias("n"), *[rank_of(column, share, kind=kind).alias(name) for name, share in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))]]


def floor_days(start: Column, end: Column) -> Column:
    """Whole days between two instants, rounded down; null if either is."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("int")


def calendar_days(start: Column, end: Column) -> Column:
    """Days between two dates written as text, zero if either can't be read."""
    return F.coalesce(F.date_diff(F.try_to_timestamp(end, F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(start, F.lit("yyyy-MM-dd")).cast("date")), F.lit(0))


def view_count(text: Column, compat: bool = False) -> Column:
    """"1.2K" as 1200 and "3M" as 3000000; compat: K as three zeros put behind with the point dropped, M not read."""
    bare = F.trim(text)
    if compat:
        put = F.replace(F.replace(F.regexp_replace(bare, "(?i)k", "000"), F.lit("."), F.lit("")), F.lit(","), F.lit(""))
        return F.when(put.rlike(r"^\d+$"), put.cast("bigint"))
    number = F.regexp_extract(F.replace(bare, F.lit(","), F.lit("")), r"(?i)^(\d+(?:\.\d+)?)\s*[km]?$", 1)
    factor = F.when(bare.rlike("(?i)k$"), 1_000).when(bare.rlike("(?i)m$"), 1_000_000).otherwise(1)
    return F.when(number != "", F.round(number.try_cast("double") * factor).cast("bigint"))
