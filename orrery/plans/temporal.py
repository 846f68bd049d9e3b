"""Joins by time: sign-ups publish a user's version; parts, suppliers and their keys give validity periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import temporal
from orrery.plans.base import query, table
from orrery.streaming import sessions

PART_PERIODS = """(select p_partkey, timestamp '1995-01-01' + to_days(cast(p_partkey * 37 % 2400 as int)) as valid_from,
    timestamp '1995-01-01' + to_days(cast(p_partkey * 37 % 2400 + case when p_partkey % 50 = 0 then 1000 else 1 + p_partkey * 13 % 40 end as int)) as valid_to from part)"""
SUPPLIER_PERIODS = """(select s_suppkey, timestamp '1995-01-01' + to_days(cast(s_suppkey * 29 % 2000 as int)) as term_from,
    timestamp '1995-01-01' + to_days(cast(s_suppkey * 29 % 2000 + 10 + s_suppkey * 7 % 90 as int)) as term_to from supplier)"""


def _day(n):
    return F.expr(f"timestamp_ntz'1995-01-01' + make_dt_interval(cast({n} as int))")


def part_periods(spark, sf):
    start = "p_partkey * 37 % 2400"
    length = "if(p_partkey % 50 = 0, 1000, 1 + p_partkey * 13 % 40)"
    return table(spark, sf, "part").select("p_partkey", _day(start).alias("valid_from"), _day(f"{start} + {length}").alias("valid_to"))


def supplier_periods(spark, sf):
    start = "s_suppkey * 29 % 2000"
    return table(spark, sf, "supplier").select("s_suppkey", _day(start).alias("term_from"), _day(f"{start} + 10 + s_suppkey * 7 % 90").alias("term_to"))


@query("""with v as (select user_id, ts as since, event_id as version, value as price from events where event_type = 'signup')
    select u.event_id, u.user_id, v.version, v.price from (select event_id, user_id, ts from events where event_type <> 'signup') u asof left join v on u.user_id = v.user_id and u.ts >= v.since""")
def j15_version_in_force(spark, sf):
    e = table(spark, sf, "events")
    versions = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("version"), F.col("value").alias("price"))
    used = e.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    return temporal.asof_join(used, versions, ["user_id"], "ts", "since", ["version", "price"]).drop("ts")


@query("""with v as (select event_type, ts as since, event_id as version from events where event_id % 10 = 0)
    select u.event_id, v.version from events u asof join v on u.event_type = v.event_type and u.ts >= v.since where u.ts - v.since <= interval 1 hour""")
def j15_recent_version(spark, sf):
    e = table(spark, sf, "events")
    versions = e.where("event_id % 10 = 0").select("event_type", F.col("ts").alias("since"), F.col("event_id").alias("version"))
    out = temporal.asof_join(e.select("event_id", "event_type", "ts"), versions, ["event_type"], "ts", "since", ["version"], how="inner", tolerance=3_600_000_000)
    return out.select("event_id", "version")


@query(f"""select p_partkey, count(*) as lines, sum(l_quantity) as quantity, min(l_shipdate) as first_shipped from lineitem join {PART_PERIODS}
    on l_partkey = p_partkey and l_shipdate >= valid_from and l_shipdate < valid_to group by p_partkey""")
def j16_usage_in_periods(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_quantity")
    met = temporal.period_join(lines, part_periods(spark, sf), "l_shipdate", "valid_from", "valid_to", on=["p_partkey"])
    return met.groupBy("p_partkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.min("l_shipdate").alias("first_shipped"))


@query(f"""select s_suppkey, count(*) as orders, sum(cast(o_totalprice as decimal(18,2))) as total from orders join {SUPPLIER_PERIODS} on o_orderdate >= term_from and o_orderdate < term_to group by s_suppkey""")
def j16_orders_in_terms(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    out = temporal.totals(orders, supplier_periods(spark, sf), "o_orderdate", "term_from", "term_to", ["s_suppkey"], {"orders": ("sum", F.lit(1)), "total": ("sum", F.col("price"))})
    return out.select("s_suppkey", "orders", F.col("total").cast("decimal(28,2)").alias("total"))


@query(f"""select s_suppkey, count(*) as parts, min(p_partkey) as first_part from {SUPPLIER_PERIODS} join {PART_PERIODS} on valid_from < term_to and term_from < valid_to group by s_suppkey""")
def j17_overlapping_periods(spark, sf):
    values = {"parts": ("sum", F.lit(1)), "first_part": ("min", F.col("p_partkey"))}
    return temporal.overlap_totals(supplier_periods(spark, sf), part_periods(spark, sf), ("term_from", "term_to"), ("valid_from", "valid_to"), ["s_suppkey"], values)


@query("""select cast(conv_id as varchar) as session, coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '') as message, count(*) as n_events, max(turn) + 1 - count(*) as n_missing,
    1000 * (min(turn) filter (where role = 'assistant') - min(turn)) as ttft_ms, cast(null as bigint) as thinking_ms, 'cancelled' as outcome from conversations group by conv_id""")
def t1_session_messages(spark, sf):
    kind = F.when(F.col("role") == "assistant", "delta").otherwise("meta")
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(turn as int))")
    c = table(spark, sf, "conversations")
    return sessions.sessions_batch(c.select(F.col("conv_id").cast("string").alias("session"), (F.col("turn") + 1).alias("seq"), kind.alias("type"), F.col("text").alias("payload"), at.alias("ts")))


@query("""with e as (select user_id, ts, cast(json_extract_string(props, '$.k') as bigint) as tokens, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as opens from events),
    s as (select *, sum(opens) over (partition by user_id order by ts) as n from e) select user_id, min(ts) as started, count(*) as n_events, cast(sum(tokens) as bigint) as total_tokens from s group by user_id, n""")
def t2_user_visits(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return sessions.visits(e, "12 hours")
