"""The registry of queries over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.functions.measures import business_date

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast("decimal(18,6)")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage facts as the events table holds them."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("agent"), F.col("ts").alias("create_time"),
        F.get_json_object("props", "$.k").cast("long").alias("total_tokens"), money(F.col("value")).alias("total_cost"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("status"), business_date(F.col("ts")).alias("usage_date"),
    )


#: The same facts in DuckDB's SQL.
FACTS = """(select event_id as id, user_id, event_type as agent, ts as create_time, cast(json_extract_string(props, '$.k') as bigint) as total_tokens,
    cast(value as decimal(18,6)) as total_cost, case when event_type = 'error' then 0 else 1 end as status, cast(ts + interval 8 hour as date) as usage_date from events)"""
TOTALS = """count(*) as calls, cast(coalesce(sum(total_tokens), 0) as bigint) as total_tokens, cast(coalesce(sum(total_cost), 0) as double) as total_cost,
    count(*) filter (where status = 0) as errors"""
