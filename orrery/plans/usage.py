"""Usage analytics over events; customers, nations and regions stand for organizations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from orrery.functions import measures, text
from orrery.operators import browse, sketches, steps, usage
from orrery.plans.base import FACTS, TOTALS, facts, money, query, table

START, END = datetime(2024, 1, 10), datetime(2024, 1, 20)
RANGE = "create_time >= timestamp '2024-01-10' and create_time < timestamp '2024-01-20'"


def _shown(df):
    """Dates as text."""
    return df.withColumn("usage_date", F.col("usage_date").cast("string"))


@query(f"select agent, {TOTALS} from {FACTS} group by agent")
def g1_usage_by_agent(spark, sf):
    return usage.summary(usage.scoped(facts(spark, sf), None), ["agent"])


@query(f"select user_id, {TOTALS} from {FACTS} where {RANGE} group by user_id order by total_tokens desc, user_id limit 20")
def g1_usage_by_user(spark, sf):
    return usage.summary(usage.scoped(facts(spark, sf), None, START, END), ["user_id"])


@query(f"select agent, count(*) filter (where status = 0) as errors, count(*) as calls from {FACTS} group by agent")
def g2_conditional_count(spark, sf):
    return facts(spark, sf).groupBy("agent").agg(F.count_if(F.col("status") == 0).alias("errors"), F.count("*").alias("calls"))


@query(f"select {TOTALS} from {FACTS} where user_id = -1")
def g3_grand_total_empty(spark, sf):
    return usage.scoped(facts(spark, sf), -1).agg(*usage.totals())


@query(f"select {TOTALS} from {FACTS}")
def g3_grand_total(spark, sf):
    return facts(spark, sf).agg(*usage.totals())


@query(f"select cast(usage_date as varchar) as usage_date, {TOTALS} from {FACTS} where {RANGE} group by usage_date")
def g4_daily_trend(spark, sf):
    return _shown(usage.daily_trend(usage.scoped(facts(spark, sf), None, START, END)))


@query(f"select {TOTALS}, cast(round_even(cast(avg(total_tokens) as decimal(20,4)), 0) as bigint) as avg_latency from {FACTS} where {RANGE}")
def g5_overview(spark, sf):
    return usage.overview(usage.scoped(facts(spark, sf), None, START, END), "total_tokens")


@query("""select (select count(distinct conv_id) from conversations) as conversations, (select count(*) from conversations) as messages,
    (select count(distinct source) from documents) as knowledge_bases, (select count(*) from documents) as documents""")
def g6_business_counts(spark, sf):
    c, d = table(spark, sf, "conversations"), table(spark, sf, "documents")
    left = c.agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("messages"))
    return left.crossJoin(d.agg(F.count_distinct("source").alias("knowledge_bases"), F.count("*").alias("documents")))  # one row each


@query("select count(*) as total from orders where o_orderstatus = 'O'")
def g7_page_total(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderkey").agg(F.count("*").alias("total"))


@query(f"select id, user_id from {FACTS} where {RANGE}")
def f1_time_range(spark, sf):
    return usage.scoped(facts(spark, sf), None, START, END).select("id", "user_id")


@query(f"select id from {FACTS} where agent = 'click' and status = 1 and user_id = 7")
def f2_optional_filters(spark, sf):
    return usage.scoped(facts(spark, sf), None, agent="click", status=1, user_id=7, usage_date=None).select("id")


@query("select p_partkey, p_name from part where p_name like '%a_e%' or p_brand like '%a_e%'")
def f3_like_live_wildcards(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").like("%a_e%") | F.col("p_brand").like("%a_e%")).select("p_partkey", "p_name")


@query("select doc_id from documents where contains(text, '_') or contains(text, '2.0.')")
def f4_like_escaped(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.col("text").like(text.like_escaped("_")) | F.col("text").like(text.like_escaped("2.0."))).select("doc_id")


@query("select o_orderkey from orders where o_orderstatus = 'F'")
def f5_status_filter(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")


@query(f"select cast(usage_date as varchar) as usage_date, {TOTALS} from {FACTS} where user_id = 3 group by usage_date")
def f6_row_scope(spark, sf):
    return _shown(usage.daily_trend(usage.scoped(facts(spark, sf), 3)))


@query("""select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate < (select max(o_orderdate) from orders) - interval 15 minute""")
def f9_stale_jobs(spark, sf):
    o = table(spark, sf, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    return o.where("o_orderstatus = 'O'").join(F.broadcast(now), F.expr("o_orderdate is null or o_orderdate < now - interval 15 minutes")).select("o_orderkey")  # now is one row


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as create_time, printf('%.6f', value) as total_cost, lower(hex(event_type)) as type_hex from events""")
def f15_formatting(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", text.iso_utc(F.col("ts")).alias("create_time"), F.format_string("%.6f", "value").alias("total_cost"), F.lower(F.hex("event_type")).alias("type_hex"))


@query(f"""with c as (select count(*) filter (where create_time >= timestamp '2024-01-20') as calls_now, count(*) filter (where create_time < timestamp '2024-01-20') as calls_before,
    cast(coalesce(sum(total_tokens) filter (where create_time >= timestamp '2024-01-20'), 0) as bigint) as tokens_now,
    cast(coalesce(sum(total_tokens) filter (where create_time < timestamp '2024-01-20'), 0) as bigint) as tokens_before
    from {FACTS} where create_time >= timestamp '2024-01-15' and create_time < timestamp '2024-01-25')
    select *, case when calls_before > 0 then round((calls_now - calls_before) * 100.0 / calls_before, 2) end as calls_change,
    case when tokens_before > 0 then round((tokens_now - tokens_before) * 100.0 / tokens_before, 2) end as tokens_change from c""")
def w8_period_over_period(spark, sf):
    return usage.period_over_period(facts(spark, sf), datetime(2024, 1, 20), datetime(2024, 1, 25))


@query("select l_orderkey, l_linenumber, round((cast(l_quantity as bigint) * l_discount + l_linenumber * l_tax) / 1000.0, 6) as cost from lineitem")
def x1_cost(spark, sf):
    # prices of two places: every engine's quotient is exact at six
    x = table(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", measures.cost(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount"), F.col("l_tax")).cast("double").alias("cost"))


@query("select event_id, cast(cast(ts + interval 8 hour as date) as varchar) as usage_date from events")
def x2_business_date(spark, sf):
    return _shown(table(spark, sf, "events").select("event_id", measures.business_date(F.col("ts")).alias("usage_date")))


@query("""with d as (select agent, count(*) filter (where usage_date < date '2024-01-15') as p, count(*) filter (where usage_date >= date '2024-01-15') as c from """ + FACTS + """ group by agent)
    select agent, case when p > 0 then cast(round((c - p) * 100.0 / p, 2) as double) end as change from d""")
def x4_percent_change(spark, sf):
    late = F.col("usage_date") >= F.lit("2024-01-15").cast("date")
    d = facts(spark, sf).groupBy("agent").agg(F.count_if(~late).alias("p"), F.count_if(late).alias("c"))
    return d.select("agent", measures.percent_change(F.col("c"), F.col("p")).cast("double").alias("change"))


@query(f"""select u.user_id, any_value(c_name) as organization, any_value(n_name) as nation, count(*) as calls, cast(sum(total_cost) as double) as total_cost
    from {FACTS} u left join customer c on u.user_id = c.c_custkey and c_nationkey <> 3 left join nation n on c.c_nationkey = n.n_nationkey group by u.user_id""")
def j2_left_outer_organization(spark, sf):
    # facts are summed before the join: one row a user meets the dimension
    by = facts(spark, sf).groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("total_cost").cast("double").alias("total_cost"))
    org = table(spark, sf, "customer").where("c_nationkey <> 3").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return by.join(org, F.col("user_id") == F.col("c_custkey"), "left").select("user_id", F.col("c_name").alias("organization"), F.col("n_name").alias("nation"), "calls", "total_cost")


@query(f"""select id, user_id, agent, total_tokens, cast(total_cost as double) as total_cost, cast(usage_date as varchar) as usage_date, status from {FACTS} where {RANGE}""")
def s11_fact_rows(spark, sf):
    out = usage.scoped(facts(spark, sf), None, START, END)
    return _shown(out.select("id", "user_id", "agent", "total_tokens", F.col("total_cost").cast("double").alias("total_cost"), "usage_date", "status"))


@query(f"""with s as (select agent, {TOTALS} from {FACTS} group by agent order by total_tokens desc, agent limit 3)
    select agent, calls, total_tokens, total_cost, errors, (select count(*) from {FACTS}) as all_calls from s""")
def k14_summary_and_total(spark, sf):
    f = facts(spark, sf)
    return usage.summary(f, ["agent"], 3).crossJoin(f.agg(F.count("*").alias("all_calls")))  # the total is one row


STATUS = "case event_type when 'view' then 'draft' when 'click' then 'running' when 'purchase' then 'paused' when 'signup' then 'pending' else 'stopped' end"


@query(f"""with s as (select user_id, {STATUS} as status, lag({STATUS}) over (partition by user_id order by ts, event_id) as before from events)
    select before, status, count(*) as n from s where before <> status and before || '>' || status not in ('draft>running', 'running>paused', 'paused>running', 'paused>stopped', 'pending>stopped') group by before, status""")
def f13_illegal_transitions(spark, sf):
    return browse.illegal_transitions(table(spark, sf, "events").withColumn("status", F.expr(STATUS)), "user_id", "ts", "event_id")


@query("select event_id, strftime(ts - interval 8 hour, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def x3_utc(spark, sf):
    return table(spark, sf, "events").select("event_id", text.iso_utc(measures.to_utc(F.col("ts"), "Asia/Shanghai")).alias("at"))


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def w10_event_numbers(spark, sf):
    return steps.numbered(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "seq")


@query("""with s as (select user_id, min((epoch_us(ts) // 1000)) filter (where event_type = 'click') as started from events group by user_id)
    select s.user_id, started, min((epoch_us(ts) // 1000)) filter (where event_type = 'purchase' and (epoch_us(ts) // 1000) >= started) as finished, min((epoch_us(ts) // 1000)) filter (where event_type = 'purchase' and (epoch_us(ts) // 1000) >= started) - started as cost_ms
    from s join events e on s.user_id = e.user_id where started is not null group by s.user_id, started""")
def c8_step_collection(spark, sf):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "finish")
    e = table(spark, sf, "events").select("user_id", F.lit("s").alias("step_id"), kind.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return steps.collected(e, "user_id").select("user_id", "started", "finished", "cost_ms")


@query("select event_id, json_object('type', event_type, 'value', value) as detail from (select event_id, event_type, cast(floor(value) as bigint) as value from events)")
def s12_audit_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("type"), F.col("value").cast("long").alias("value"))
    return browse.audit_rows(e.withColumn("value", F.floor("value")), ["type", "value"])


@query(f"select agent, user_id, cast(usage_date as varchar) as usage_date, grouping(agent, user_id, usage_date) as set_id, {TOTALS}, count(distinct user_id) as users from {FACTS} group by grouping sets ((agent), (user_id), (usage_date), (agent, usage_date), ())")
def g17_usage_sets(spark, sf):
    dims = ["agent", "user_id", "usage_date"]
    return _shown(usage.summary_sets(facts(spark, sf), dims, [["agent"], ["user_id"], ["usage_date"], ["agent", "usage_date"], []]))


@query()
def g18_period_sketches(spark, sf):
    """Distinct users and median and 95th percentile of cost by week and agent, from daily sketches; tests hold them to exact values."""
    daily = sketches.sketched(facts(spark, sf), ["usage_date", "agent"])
    weekly = sketches.rolled_up(daily.withColumn("week", F.date_trunc("week", "usage_date").cast("date").cast("string")), ["week", "agent"])
    return sketches.estimates(weekly, ["week", "agent"], {"p50": 0.5, "p95": 0.95})
