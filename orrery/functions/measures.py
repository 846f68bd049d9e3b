"""Scalar expressions of money, dates and rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a thousand tokens; a null price is zero; six places, halves away from zero."""
    amount = lambda n, p: n.cast("decimal(18,0)") * F.coalesce(p.cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    return F.round((amount(tokens_in, price_in) + amount(tokens_out, price_out)) / F.lit(1000), 6).cast("decimal(18,6)")


def business_date(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """The date in zone of an instant stored as UTC wall clock."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def to_utc(ts: Column, zone: str | None = None) -> Column:
    """The UTC wall clock of a time; one without a zone is UTC already."""
    plain = ts.cast("timestamp_ntz")
    return plain if zone is None else F.to_utc_timestamp(plain.cast("timestamp"), zone).cast("timestamp_ntz")


def percent_change(now: Column, before: Column, places: int = 2) -> Column:
    """Null where there was nothing before."""
    return F.when(before > 0, F.round((now - before).cast("decimal(28,8)") / before.cast("decimal(28,8)") * 100, places))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))
