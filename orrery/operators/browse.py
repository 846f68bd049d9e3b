"""Lists, look-ups and resolutions over a platform's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.config import AGENT_TRANSITIONS
from orrery.functions.text import like_escaped


def page(df: DataFrame, number: int, size: int, *order: Column, key: str) -> DataFrame:
    """One page of df in a total order: the key settles ties."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at one")
    return df.orderBy(*order, F.desc(key)).offset((number - 1) * size).limit(size)


def listed(df: DataFrame, keyword: str | None = None, within: tuple[str, ...] = (), **equal: object) -> DataFrame:
    """Rows that hold the keyword literally in one of the columns and meet the equalities; None filters nothing."""
    if keyword:
        hit = F.lit(False)
        for c in within:
            hit = hit | F.coalesce(F.col(c).like(like_escaped(keyword)), F.lit(False))
        df = df.where(hit)
    for k, v in equal.items():
        df = df if v is None else df.where(F.col(k) == v)
    return df


def masked(df: DataFrame, secret: str, out: str) -> DataFrame:
    """df with whether there is a secret in its place."""
    return df.withColumn(out, F.length(F.coalesce(F.col(secret).cast("string"), F.lit(""))) > 0).drop(secret)


def oldest(df: DataFrame, by: list[str], *order: str, enabled: Column | None = None) -> DataFrame:
    """The first row of each ``by`` in order, of the enabled ones if asked."""
    rows = df if enabled is None else df.where(enabled)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("n = 1").drop("n")


def published(agents: DataFrame, versions: DataFrame) -> DataFrame:
    """(agent_id, config, problem): the config of the current version's snapshot, or why the agent can't run."""
    v = versions.select("agent_id", F.col("version").alias("current_version"), "config", F.lit(True).alias("there"))
    rows = agents.join(v, ["agent_id", "current_version"], "left")
    problem = F.when(F.col("status").isin("paused", "stopped", "pending"), "not running").when(F.coalesce("current_version", F.lit("")) == "", "not published").when(F.col("there").isNull(), "no snapshot")
    return rows.select("agent_id", F.when(problem.isNull(), F.col("config")).alias("config"), problem.alias("problem"))


def illegal_transitions(history: DataFrame, by: str, *order: str, status: str = "status") -> DataFrame:
    """(before, status, n): changes of status that the life cycle doesn't know; staying the same is no change."""
    moves = history.withColumn("before", F.lag(status).over(Window.partitionBy(by).orderBy(*order))).where(F.col("before") != F.col(status))
    counted = moves.groupBy("before", F.col(status).alias("status")).agg(F.count("*").alias("n"))
    known = F.array(*(F.lit(f"{a}>{b}") for a, b in AGENT_TRANSITIONS))
    return counted.where(~F.array_contains(known, F.concat_ws(">", "before", "status")))


def resolved_conversations(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """requests (request_id, conv_id, user_id, agent_id) with ``reused`` and ``resolved``: the conversation asked for if user and agent match, else a new one named by the request."""
    own = conversations.select("conv_id", "user_id", "agent_id", F.lit(True).alias("there"))
    rows = requests.join(own, ["conv_id", "user_id", "agent_id"], "left")
    reused = F.coalesce("there", F.lit(False))
    return rows.select("request_id", reused.alias("reused"), F.when(reused, F.col("conv_id").cast("string")).otherwise(F.concat(F.lit("new-"), F.col("request_id").cast("string"))).alias("resolved"))


def seeded(existing: DataFrame, wanted: DataFrame, key: str = "code", kept: tuple[str, ...] = ("status",)) -> DataFrame:
    """The dimension after seeding: new codes come in, known ones take the seed's values but keep ``kept``, others stay."""
    columns = [c for c in wanted.columns if c != key]
    w = wanted.select(key, *(F.col(c).alias(f"{c} wanted") for c in columns), F.lit(True).alias("is wanted"))
    rows = existing.join(w, key, "full_outer")
    value = lambda c: F.coalesce(c, f"{c} wanted") if c in kept else F.when(F.col("is wanted"), F.col(f"{c} wanted")).otherwise(F.col(c))
    return rows.select(key, *(value(c).alias(c) for c in columns))


def grants(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Grants merged: none is ever taken away."""
    return existing.unionByName(wanted).distinct()


def audit_rows(events: DataFrame, detail: list[str]) -> DataFrame:
    """events with their details as one JSON text, for the audit log."""
    return events.withColumn("detail", F.to_json(F.struct(*detail))).drop(*detail)
