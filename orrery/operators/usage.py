"""Usage analytics over append-only facts.

Every builder takes a scope: the user that may see only own rows, or None for those that see all.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from orrery.config import MAX_RANGE_DAYS
from orrery.functions.measures import percent_change


def resolve_range(start: datetime | None, end: datetime | None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The half-open range asked for; the last seven days by default."""
    end = end or now or datetime.utcnow()
    start = start or end - timedelta(days=7)
    if start >= end or end - start > timedelta(days=MAX_RANGE_DAYS):
        raise ValueError(f"the range from {start} to {end} is empty or longer than {MAX_RANGE_DAYS} days")
    return start, end


def scoped(facts: DataFrame, scope: int | None, start: datetime | None = None, end: datetime | None = None, at: str = "create_time", **equal: object) -> DataFrame:
    """Facts in [start, end) that the scope may see; equalities whose value is None don't filter."""
    out = facts if scope is None else facts.where(F.col("user_id") == scope)
    if start is not None:
        out = out.where(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col(at) < F.lit(end).cast("timestamp_ntz"))
    for k, v in equal.items():
        out = out if v is None else out.where(F.col(k) == v)
    return out


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def totals() -> list[Column]:
    """Aggregates of a group, or of all rows: zeros where there are none."""
    return [
        F.count("*").alias("calls"),
        _sum("total_tokens").cast("long").alias("total_tokens"),
        _sum("total_cost").cast("double").alias("total_cost"),
        F.coalesce(F.count_if(F.col("status") == 0), F.lit(0)).alias("errors"),
    ]


def summary(facts: DataFrame, keys: list[str], top: int = 20) -> DataFrame:
    """The groups with the most tokens. A renamed member of a dimension is a group of its own."""
    if not 1 <= top <= 100:
        raise ValueError("top lies between 1 and 100")
    return facts.groupBy(*keys).agg(*totals()).orderBy(F.desc("total_tokens"), *keys).limit(top)


def summary_sets(facts: DataFrame, dimensions: list[str], sets: list[list[str]] | None = None, distinct: str = "user_id") -> DataFrame:
    """(dimensions, set_id, calls, total_tokens, total_cost, errors, users): groups by each of several sets of dimensions, in one scan of the facts.

    By default each dimension alone, and all rows. ``set_id`` has a bit for each dimension, the first highest, which is set
    where the dimension is not part of the group's set; it tells a null of the data from one that stands for all. Distinct
    counts take a second exchange, by group, after one by group and counted value that leaves no value twice.
    """
    sets = [[d] for d in dimensions] + [[]] if sets is None else sets
    chosen = [[F.col(d) for d in s] for s in sets]
    grouped = facts.groupingSets(chosen, *dimensions)
    users = F.count_distinct(distinct).alias("users")
    return grouped.agg(F.grouping_id(*dimensions).alias("set_id"), *totals(), users)


def daily_trend(facts: DataFrame, granularity: str = "day") -> DataFrame:
    """Totals by business day; days without facts don't appear."""
    if granularity != "day":
        raise ValueError("only days are supported")
    return facts.groupBy("usage_date").agg(*totals()).orderBy("usage_date")


def overview(facts: DataFrame, latency: str) -> DataFrame:
    """One row, whatever the input: totals and the mean latency, halves to even, null without any."""
    mean = F.bround(F.avg(latency).cast("decimal(20,4)"), 0).cast("long").alias("avg_latency")
    return facts.agg(*totals(), mean)


def period_over_period(facts: DataFrame, start: datetime, end: datetime, at: str = "create_time") -> DataFrame:
    """Totals of a period and of the equally long one before it, in one scan."""
    before = start - (end - start)
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = facts.where((F.col(at) >= lit(before)) & (F.col(at) < lit(end)))
    now = F.col(at) >= lit(start)
    out = rows.agg(*(F.coalesce(F.sum(F.when(w, v)), F.lit(0)).cast("long").alias(f"{n}_{p}") for n, v in (("calls", F.lit(1)), ("tokens", F.col("total_tokens"))) for p, w in (("now", now), ("before", ~now))))
    return out.select("*", *(percent_change(F.col(f"{n}_now"), F.col(f"{n}_before")).cast("double").alias(f"{n}_change") for n in ("calls", "tokens")))
