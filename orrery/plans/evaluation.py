"""Evaluation and grounding: benchmark items are questions, their text is the evidence, documents by source are the hits; conversations are answers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from orrery.functions import text
from orrery.operators import answers, contracts, conversations, evaluation, grounding, reports, retrieval, steps
from orrery.operators.lineage import cut
from orrery.plans.base import query, table

#: Hits of a question: documents that hold its text come with others of the same source, longest first.
HITS = """(with o as (select b.item_id as question_id, b.text as evidence, d.source from benchmark b join documents d on contains(d.text, b.text) group by all),
    h as (select question_id, evidence, doc_id, text as content, row_number() over (partition by question_id order by length(text) desc, doc_id) as rank from o join documents d using (source))
    select * from h where rank <= 10)"""
FOUND = f"(select question_id, min(case when contains(content, evidence) then rank end) as first from {HITS} group by question_id)"
SCORES = f"""(select b.item_id as question_id, coalesce(1.0e0 / first, 0) as mrr, case when first <= 1 then 1.0e0 else 0 end as hit_1, case when first <= 5 then 1.0e0 else 0 end as hit_5,
    case when b.item_id % 3 = 0 then 'a' when b.item_id % 3 = 1 then 'b' else 'unknown' end as category from benchmark b left join {FOUND} f on f.question_id = b.item_id)"""
LONG = f"(select question_id, category, unnest(['mrr', 'hit@1', 'hit@5']) as metric, unnest([mrr, hit_1, hit_5]) as value from {SCORES})"


def _questions(spark, sf):
    b = table(spark, sf, "benchmark")
    category = F.when(F.col("item_id") % 3 == 0, "a").when(F.col("item_id") % 3 == 1, "b")
    return b.select(F.col("item_id").alias("question_id"), category.alias("category"), F.array("text").alias("evidence"))


def _hits(spark, sf):
    docs = table(spark, sf, "documents")
    q = _questions(spark, sf).select("question_id", F.col("evidence")[0].alias("evidence"))
    held = retrieval.containment(docs, q.toDF("item_id", "text")).withColumnRenamed("item_id", "question_id")
    own = held.join(docs.select("doc_id", "source"), "doc_id").select("question_id", "source").distinct()
    # ten documents of a source serve all questions about it
    slim = retrieval.ranked(docs.select("source", "doc_id", F.length("text").alias("n")), 10, F.desc("n"), F.col("doc_id"), by="source").drop("rank")
    top = retrieval.ranked(own.join(slim, "source"), 10, F.desc("n"), F.col("doc_id"), by="question_id")
    return top.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").select("question_id", "doc_id", "rank", "content")


def _scores(spark, sf):
    # kept as a small table, since averages, differences and gates read it more than once
    return cut(evaluation.retrieval_scores(_questions(spark, sf), _hits(spark, sf), [1, 5]))


def _long(spark, sf):
    wide = _scores(spark, sf).select("question_id", "mrr", "`hit@1`", "`hit@5`")
    return evaluation.long_form(wide, ["question_id"]).join(_questions(spark, sf).select("question_id", "category"), "question_id")


@query(f"select question_id, hit_1, hit_5 from {SCORES}")
def e1_hit_at_k(spark, sf):
    return _scores(spark, sf).select("question_id", F.col("`hit@1`").alias("hit_1"), F.col("`hit@5`").alias("hit_5"))


@query(f"select question_id, hit_5 as recall_5 from {SCORES}")
def e2_evidence_recall(spark, sf):
    return _scores(spark, sf).select("question_id", F.col("`evidence_recall@5`").alias("recall_5"))


@query("""with s as (select doc_id % 50 as q, list(distinct source) filter (where n_chars > 1500) as found, list(distinct source) filter (where n_chars > 500) as wanted from documents group by 1)
    select q, case when wanted is null then 1.0e0 else len(list_intersect(coalesce(found, []), wanted)) / len(wanted)::double end as recall from s""")
def e3_source_recall(spark, sf):
    by = table(spark, sf, "documents").groupBy((F.col("doc_id") % 50).alias("q")).agg(F.collect_set(F.when(F.col("n_chars") > 1500, F.col("source"))).alias("found"), F.collect_set(F.when(F.col("n_chars") > 500, F.col("source"))).alias("wanted"))
    return by.select("q", evaluation.source_recall(F.col("found"), F.col("wanted")).alias("recall"))


@query(f"select question_id, mrr from {SCORES}")
def e4_mrr(spark, sf):
    return _scores(spark, sf).select("question_id", "mrr")


@query(f"select question_id, first from {FOUND}")
def w7_first_evidence_rank(spark, sf):
    q, hits = _questions(spark, sf), _hits(spark, sf)
    first = evaluation.evidence_hits(q, hits).groupBy("question_id").agg(F.min("rank").alias("first"))
    return hits.select("question_id").distinct().join(first, "question_id", "left")


POINTS = "['the', 'und', 'que']"


@query(f"""select conv_id, turn, len(list_filter({POINTS}, lambda p: contains(text, p)))::double / 3 as correctness,
    case when len(list_filter({POINTS}, lambda p: contains(text, p))) > 0 then len(list_filter({POINTS}, lambda p: contains(text, p) and contains(reverse(text), p)))::double / len(list_filter({POINTS}, lambda p: contains(text, p))) end as supported
    from conversations where role = 'assistant'""")
def e5_e6_answer_points(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    points, answer = F.array(*map(F.lit, ("the", "und", "que"))), F.col("text")
    return c.select("conv_id", "turn", evaluation.points_matched(answer, points).alias("correctness"), evaluation.points_supported(answer, F.reverse("text"), points).alias("supported"))


@query(f"select metric, avg(value) as value from {LONG} group by metric")
def g8_macro_average(spark, sf):
    return evaluation.macro(_long(spark, sf))


@query(f"select category, metric, avg(value) as value from {LONG} group by category, metric union all select category, '_count', cast(count(distinct question_id) as double) from {LONG} group by category")
def g9_category_average(spark, sf):
    return evaluation.by_category(_long(spark, sf))


ANSWERED = f"""(select conv_id, turn, role as category, regexp_extract_all(t, '\\[([0-9]{{1,3}})\\]', 1) as c, conv_id % 5 = 0 as abstain_expected, turn % 4 = 0 as abstained, length(text) as latency_ms,
    len(list_filter(regexp_split_to_array(t, '[。！？!?\\n]+'), lambda x: length(trim(x)) >= 12 and not regexp_matches(x, '\\[[0-9]{{1,3}}\\]'))) as uncited, contains(t, 'the')::int::double as correctness from (select *, text || ' [' || (turn % 4) || ']' as t from conversations))"""
ROLLED = """avg(correctness) as answer_correctness, avg(case when len(list_filter(c, lambda x: x not in ('1', '2', '3'))) > 0 then 0.0e0 else 1 end) as citation_valid_rate,
    avg(case when abstain_expected then abstained::int::double end) as abstain_accuracy, avg(case when not abstain_expected then abstained::int::double end) as false_abstain_rate, sum(uncited)::double as uncited_claims_total, avg(latency_ms) as latency_ms"""


def _answered(spark, sf):
    c = table(spark, sf, "conversations")
    answer = F.concat("text", F.lit(" ["), F.col("turn") % 4, F.lit("]"))
    rows = c.withColumn("m", answers.citation_metrics(answer, F.array(*map(F.lit, (1, 2, 3))))).withColumn("abstained", F.col("turn") % 4 == 0)
    return rows.select(
        F.col("role").alias("category"), evaluation.points_matched(answer, F.array(F.lit("the"))).alias("correctness"), F.lit(None).cast("double").alias("supported"), "m.invalid", "m.has_citation", (F.col("conv_id") % 5 == 0).alias("abstain_expected"),
        "abstained", answers.abstain_pass(F.lit(""), F.col("abstained")).alias("abstain_pass"), F.length("text").alias("latency_ms"), F.col("m.uncited_claims").alias("uncited_claims"),
    )


@query(f"select category, {ROLLED} from {ANSWERED} group by rollup(category)")
def g10_answer_rollup(spark, sf):
    return answers.rollup(_answered(spark, sf)).select("category", "answer_correctness", "citation_valid_rate", "abstain_accuracy", "false_abstain_rate", "uncited_claims_total", "latency_ms")


@query(f"select count(*) as n, avg(case when mrr = 0 then 1.0e0 else 0 end) as no_hits_rate, avg(case when mrr < 0.5 then 1.0e0 else 0 end) as low_relevance_rate from {SCORES} where category = 'b'")
def g11_no_answer_stats(spark, sf):
    s = _scores(spark, sf).join(_questions(spark, sf).select("question_id", "category"), "question_id").where("category = 'b'")
    return s.agg(F.count("*").alias("n"), F.avg((F.col("mrr") == 0).cast("double")).alias("no_hits_rate"), F.avg((F.col("mrr") < 0.5).cast("double")).alias("low_relevance_rate"))


@query("""with v as (select case when quality = 1 and toxic = 0 then '通过' when quality = 1 then '存疑' when toxic = 1 then '不通过' else '' end as verdict from labels)
    select count(*) filter (where verdict <> '') as filled, count(*) filter (where verdict = '通过') as passed, count(*) filter (where verdict = '不通过') as failed, count(*) filter (where verdict = '存疑') as unsure, count(*) filter (where verdict = '通过')::double / nullif(count(*) filter (where verdict <> ''), 0) as pass_rate from v""")
def g12_review_summary(spark, sf):
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    verdict = F.when(good & ~toxic, answers.PASS).when(good, answers.UNSURE).when(toxic, answers.FAIL).otherwise("")
    return answers.review_summary(table(spark, sf, "labels").select(verdict.alias("verdict")))


BEFORE = f"(select metric, avg(value) as value from {LONG} where category <> 'b' and metric <> 'hit@1' group by metric)"
AFTER = f"(select metric, avg(value) as value from {LONG} where metric <> 'mrr' group by metric)"


def _runs(spark, sf):
    rows = _long(spark, sf)
    named = rows.withColumn("category", F.coalesce("category", F.lit("unknown")))
    return evaluation.macro(named.where("category <> 'b' and metric <> 'hit@1'")), evaluation.macro(named.where("metric <> 'mrr'"))


@query(f"""select metric, b.value as before, a.value as after, a.value - b.value as delta, case when b.value is null then 'added' when a.value is null then 'removed' when abs(a.value - b.value) <= 1e-9 then 'unchanged' when a.value > b.value then 'improved' else 'regressed' end as direction
    from {BEFORE} b full join {AFTER} a using (metric)""")
def e9_metric_diff(spark, sf):
    return evaluation.diff(*_runs(spark, sf))


@query(f"""with b as (select question_id, mrr as v from {SCORES} where question_id % 5 <> 0), a as (select question_id, hit_5 as v from {SCORES} where question_id % 7 <> 0)
    select question_id, case when b.v is null then 'added' when a.v is null then 'removed' when a.v > b.v then 'improved' else 'regressed' end as change from b full join a using (question_id) where b.v is null or a.v is null or a.v <> b.v""")
def e10_question_diff(spark, sf):
    s = _scores(spark, sf)
    return evaluation.question_diff(s.where("question_id % 5 <> 0").select("question_id", F.col("mrr").alias("value")), s.where("question_id % 7 <> 0").select("question_id", F.col("`hit@5`").alias("value")))


@query(f"""with t as (select * from (values ('hit@5', 1.01e0), ('mrr', 0.0e0), ('hit@99', 0.1e0)) as t(metric, floor)) select metric, floor, value from t left join (select metric, avg(value) as value from {LONG} group by metric) using (metric) where value is null or value < floor""")
def e11_gate(spark, sf):
    floors = spark.createDataFrame([("hit_at_5", 1.01), ("mrr", 0.0), ("hit_at_99", 0.1)], "metric string, floor double")
    return evaluation.gate(evaluation.macro(_long(spark, sf)), floors).select("metric", "floor", "value")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def u2_set_difference(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("select doc_id, n_chars, quality from documents join labels using (doc_id) where n_chars % 2 <> quality")
def u3_intersection_with_change(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("n_chars % 2 <> quality").select("doc_id", "n_chars", "quality")


@query("""with h as (select conv_id, count(*) filter (where role = 'assistant') as n_hits, max(case when role = 'assistant' and turn % 3 > 0 then turn / 10.0e0 end) as best from conversations group by conv_id)
    select conv_id as query_id, n_hits, best as best_score, case when n_hits = 0 then 'no_hits' when best is null then 'no_score' when best >= 0.35 then 'ok' else 'low_relevance' end as reason,
    n_hits > 0 and (best is null or best >= 0.35) as sufficient from h""")
def c1_evidence(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id")
    hits = c.where("role = 'assistant'").select("query_id", F.when(F.col("turn") % 3 > 0, F.col("turn") / 10.0).alias("rerank_score"))
    return grounding.assess(c.select("query_id").distinct(), hits)


ANSWER = "(text || ' [' || (turn % 4) || '] [' || conv_id % 7 || ']')"


@query(f"""with a as (select conv_id, turn, {ANSWER} as t from conversations), s as (select conv_id, turn, t, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\\[([0-9]{{1,3}})\\]', 1), lambda x: cast(x as int)))) as cited from a)
    select conv_id, turn, array_to_string(cited, ',') as cited, array_to_string(list_sort(list_filter(cited, lambda x: x not in (1, 2, 3))), ',') as invalid,
    len(list_filter(regexp_split_to_array(t, '[。！？!?\\n]+'), lambda x: length(trim(x)) >= 12 and not regexp_matches(x, '\\[[0-9]{{1,3}}\\]'))) as uncited from s""")
def c2_citation_audit(spark, sf):
    c = table(spark, sf, "conversations")
    answer = F.concat("text", F.lit(" ["), F.col("turn") % 4, F.lit("] ["), F.col("conv_id") % 7, F.lit("]"))
    out = c.select("conv_id", "turn", grounding.audit(answer, F.array(*map(F.lit, (1, 2, 3)))).alias("a"))
    return out.select("conv_id", "turn", F.array_join("a.cited", ",").alias("cited"), F.array_join(F.array_sort("a.invalid"), ",").alias("invalid"), F.col("a.uncited_claims").cast("long").alias("uncited"))


@query("select conv_id, turn, trim(text) <> '' and regexp_matches(text, 'sorry|无法确认|无法回答|无法确定|无法提供|资料不足|没有找到|未检索到|未找到') as refusal from conversations")
def c3_refusal(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", grounding.is_refusal(F.col("text"), "sorry").alias("refusal"))


@query("select conv_id, turn, cast(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as anchor from conversations")
def c7_step_anchors(spark, sf):
    return grounding.anchors(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn", "anchor")


@query("""select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations where role <> 'system') where n <= 4""")
def w6_history(spark, sf):
    c = table(spark, sf, "conversations").where("role <> 'system'")
    return conversations.history(c, 2).select("conv_id", "turn", "role")


@query("""select conv_id, string_agg(case role when 'user' then '用户' when 'assistant' then '助手' else role end || ': ' || text, chr(10) order by turn) as history from conversations where text <> '' group by conv_id""")
def x11_history_text(spark, sf):
    return conversations.history_text(table(spark, sf, "conversations"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) + 5 as idx from conversations where role = 'assistant'")
def w9_citation_numbers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return conversations.citation_numbers(c, "conv_id", "turn", start=5).select("conv_id", "turn", "idx")


@query("""select user_id, min(ts) filter (where event_type = 'click') as first_click, greatest(0, date_sub('second', min(ts), min(ts) filter (where event_type = 'click'))) as ttft_s from events group by user_id""")
def w12_first_latency(spark, sf):
    click = F.min(F.when(F.col("event_type") == "click", F.col("ts")))
    by = table(spark, sf, "events").groupBy("user_id").agg(click.alias("first_click"), F.min("ts").alias("first"))
    return by.select("user_id", "first_click", F.when(F.col("first_click").isNotNull(), F.greatest(F.lit(0).cast("long"), F.expr("timestampdiff(SECOND, first, first_click)"))).alias("ttft_s"))


@query("select conv_id, case when text = '' then 'New conversation' else substr(text, 1, 50) end as title from conversations where turn = 0")
def x7_title(spark, sf):
    return table(spark, sf, "conversations").where("turn = 0").select("conv_id", text.title(F.col("text")).alias("title"))


@query("""with d as (select conv_id, turn, nullif(role, 'system') as id, row_number() over (partition by conv_id, role order by turn) as n, length(text) as tokens from conversations where text is not null) select conv_id, cast(sum(tokens) as bigint) as tokens from d where n = 1 or id is null group by conv_id""")
def g15_token_dedup(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.nullif("role", F.lit("system")).alias("id"), F.length("text").alias("n_tokens"))
    return answers.token_totals(c, "conv_id", "id", "turn", "n_tokens")


KNOWN = "(select conv_id, count(*) filter (where role = 'assistant') as n_hits, max(case when role = 'assistant' and turn % 3 > 0 then turn / 10.0e0 end) as best, conv_id % 3 = 0 as bound, conv_id % 4 = 0 as web from conversations group by conv_id)"
SUFFICIENT = "(n_hits > 0 and (best is null or best >= 0.35))"


def _known(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id")
    hits = c.where("role = 'assistant'").select("query_id", F.when(F.col("turn") % 3 > 0, F.col("turn") / 10.0).alias("rerank_score"))
    found = grounding.assess(c.select("query_id").distinct(), hits)
    none = F.array().cast("array<string>")
    ids = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("kb"))).otherwise(none)
    tools = F.when(F.col("query_id") % 4 == 0, F.array(F.lit(answers.KNOWLEDGE_TOOL), F.lit("web_search"))).otherwise(F.array(F.lit(answers.KNOWLEDGE_TOOL)))
    return found.withColumn("ids", ids).withColumn("tools", tools)


@query(f"select conv_id as query_id, bound and not web and not {SUFFICIENT} as abstains, bound and web and not {SUFFICIENT} as noted from {KNOWN}")
def f12_abstain(spark, sf):
    args = F.col("sufficient"), F.col("ids"), F.col("tools")
    return _known(spark, sf).select("query_id", answers.should_abstain(*args).alias("abstains"), answers.needs_note(*args).alias("noted"))


@query(f"""select conv_id as query_id, case when n_hits = 0 then 'no_hits' when best is null then 'no_score' when best >= 0.35 then 'ok' else 'low_relevance' end as reason, bound and not web and not {SUFFICIENT} as abstained, n_hits as hit_count, best as best_score, 2 as source_count, '1,7' as cited, '7' as invalid_cited from {KNOWN}""")
def c4_grounding_record(spark, sf):
    k = _known(spark, sf)
    abstained = answers.should_abstain(F.col("sufficient"), F.col("ids"), F.col("tools"))
    g = answers.grounding_record(F.lit("short [1] [7]"), F.array(F.lit(1), F.lit(2)), F.col("reason"), F.col("n_hits"), F.col("best_score"), abstained)
    out = k.select("query_id", g.alias("g")).select("query_id", "g.*")
    return out.select("query_id", "reason", "abstained", "hit_count", "best_score", "source_count", F.array_join("cited", ",").alias("cited"), F.array_join("invalid_cited", ",").alias("invalid_cited"))


@query(f"select conv_id, turn, len(c) > 0 as has_citation, uncited from {ANSWERED}")
def e7_citation_metrics(spark, sf):
    c = table(spark, sf, "conversations")
    m = answers.citation_metrics(F.concat("text", F.lit(" ["), F.col("turn") % 4, F.lit("]")), F.array(*map(F.lit, (1, 2, 3))))
    return c.select("conv_id", "turn", m["has_citation"].alias("has_citation"), m["uncited_claims"].cast("long").alias("uncited"))


@query("select conv_id, turn, turn % 4 = 0 or contains(text, 'sorry') as passes from conversations")
def e8_abstain_pass(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", answers.abstain_pass(F.col("text"), F.col("turn") % 4 == 0, "sorry").alias("passes"))


@query(f"select 'overall' as scope, null as category, metric, avg(value) as value from {LONG} group by metric union all select 'category', category, metric, avg(value) from {LONG} group by category, metric union all select 'category', category, '_count', cast(count(distinct question_id) as double) from {LONG} group by category")
def e12_e14_report(spark, sf):
    q = _questions(spark, sf)
    long = reports.retrieval_run(q, _hits(spark, sf), [1, 5]).where("metric in ('mrr', 'hit@1', 'hit@5')")
    return reports.build("run", long, {"top": "10"}).select("scope", "category", "metric", "value")


@query(f"select metric, avg(value) as value from {LONG} group by metric")
def s13_report_round_trip(spark, sf):
    return reports.from_json(reports.to_json(reports.build("run", _long(spark, sf), {"top": "10"}))).where("scope = 'overall'").select("metric", "value")


@query("select cast(doc_id as varchar) as id, case when quality = 1 then '通过' else '不通过' end as verdict from labels where not (quality = 0 and toxic = 0)")
def s14_review_sheet(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), *(F.lit(f"x|{k}").alias(f"c{k}") for k in range(8)), F.when(F.col("quality") == 1, answers.PASS).when(F.col("toxic") == 1, answers.FAIL).otherwise("?").alias("v"))
    sheet = answers.review_sheet(rows.drop("v"), "id", *(f"c{k}" for k in range(8)))
    filled = rows.select("id", "v").join(sheet.select(F.regexp_extract("line", r"^\| ([0-9]+) \|", 1).cast("long").alias("id"), "line"), "id")
    lines = filled.select("id", F.regexp_replace("line", r"\|  \|  \|$", F.concat(F.lit("| "), F.col("v"), F.lit(" |  |"))).alias("line"))
    return answers.parsed_sheet(lines, at="id")


@query("select conv_id, turn, role = 'assistant' and length(text) > 0 as timeline from conversations")
def k11_message_history(spark, sf):
    c = table(spark, sf, "conversations").withColumn("steps", F.array().cast("array<string>"))
    return steps.timed_history(c, "steps", "text").select("conv_id", "turn", "timeline")


@query("select conv_id, turn, 'system:rules' || chr(10) || chr(10) || 'passages|user:' || text as prompt from conversations where role = 'user' and text <> ''")
def x12_prompt(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user' and text <> ''")
    p = steps.prompt(F.lit(""), F.lit("passages"), F.lit(None).cast("array<struct<role:string,content:string>>"), F.col("text"), F.lit("rules"))
    return c.select("conv_id", "turn", F.array_join(F.transform(p, lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("prompt"))


@query("select conv_id, turn, text || role as flat from conversations where not starts_with(text, '{')")
def x14_flattened(spark, sf):
    c = table(spark, sf, "conversations").where("not startswith(text, '{')")
    content = F.to_json(F.array(F.col("text"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("role").alias("text")))))
    return c.select("conv_id", "turn", steps.flattened(content).alias("flat"))


@query()
def c5_reasoning_segments(spark, sf):
    """(conv_id, turn, start, end): the segments of every message; tests compare them with literal cases."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(steps.reasoning_segments(F.col("text"))).alias("s"))
    return c.select("conv_id", "turn", "s.start", "s.end")


@query("""with m as (select conv_id, turn, string_split(text, chr(10))[1] as r from conversations where role = 'assistant' and text is not null),
    p as (select conv_id, turn, length(r) as n, least(greatest(turn * 9 - 3, 0), length(r)) as pl, trim(r) <> '' as thought from m),
    e as (select conv_id, turn, pl, 0 as o, 'act' as step_id, 'tool' as kind, cast(null as int) as "start", cast(null as int) as "end" from p where turn % 2 = 1
        union all select conv_id, turn, 0, 1, 'reasoning-0', 'thinking', 0, case when turn % 2 = 1 and pl > 0 and pl < n then pl else n end from p where thought
        union all select conv_id, turn, pl, 1, 'reasoning-' || pl, 'thinking', pl, n from p where thought and turn % 2 = 1 and pl > 0 and pl < n)
    select conv_id * 1000 + turn as message_id, row_number() over (partition by conv_id, turn order by pl, o, step_id) - 1 as pos, step_id, kind, "start", "end" from e""")
def k11_timelines(spark, sf):
    """Reasoning is each answer's first line, an action falls into every second one."""
    c = table(spark, sf, "conversations").where("text is not null")
    step = F.struct(F.lit("act").alias("step_id"), F.lit("tool").alias("kind"), (F.col("turn") * 9 - 3).cast("int").alias("reasoning_offset"))
    acts = F.when(F.col("turn") % 2 == 1, F.array(step))
    return conversations.timelines(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", F.split_part("text", F.lit("\n"), F.lit(1)).alias("reasoning"), acts.alias("steps")))


@query("""select conv_id, turn, coalesce(string_agg(h.role || ':' || h.text, '|' order by h.turn), '') as history from (select * from conversations where role = 'user') c left join lateral (select turn, role, text from (select *, row_number() over (order by turn desc) as n
    from conversations o where o.conv_id = c.conv_id and o.turn < c.turn) where n <= 4) h on true group by conv_id, c.turn""".replace("select conv_id, turn,", "select c.conv_id as conv_id, c.turn as turn,").replace("group by conv_id, c.turn", "group by c.conv_id, c.turn"))
def k12_history_before(spark, sf):
    c = conversations.history_before(table(spark, sf, "conversations"), 2).where("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("history"))


@query("select conv_id, turn, case turn % 4 when 0 then text when 1 then 'r' || turn when 2 then text end as reasoning from conversations where text <> ''")
def x14_reasoning(spark, sf):
    """From the first of four keys that is filled."""
    c, t = table(spark, sf, "conversations").where("text <> ''"), F.col("turn") % 4
    extras = F.to_json(F.struct(F.when(t == 0, F.col("text")).when(t == 1, "").alias("reasoning_content"), F.when(t == 1, F.concat(F.lit("r"), "turn")).alias("reasoning"), F.when(t < 2, "later").otherwise("").alias("reasoning_details"), F.when(t == 2, F.col("text")).alias("thinking")))
    return c.select("conv_id", "turn", conversations.reasoning_of(extras).alias("reasoning"))


REWRITES = """(select conv_id, turn, case turn % 5 when 0 then text when 1 then '那这个怎么办？' when 2 then '它的期限是多少？' when 3 then '' else '那呢？' end as q, conv_id % 3 as n, case conv_id % 4 when 0 then '改写后：退款期限是多少？' when 1 then '说明：无' when 2 then '它的期限是多少' else null end as raw from conversations)"""


@query(f"""with s as (select *, case when trim(q) = '' or n = 0 then 'NO_CONTEXT' when turn % 5 = 0 then 'NOT_NEEDED' when conv_id % 4 in (1, 3) then 'FAILURE' when conv_id % 4 = 2 and turn % 5 = 2 then 'NOT_NEEDED' else 'MODEL' end as source from {REWRITES})
    select conv_id * 1000 + turn as query_id, case when source = 'MODEL' then case conv_id % 4 when 0 then '退款期限是多少？' else '它的期限是多少' end else q end as rewritten_query, source = 'MODEL' as rewritten, source from s""")
def f11_rewrites(spark, sf):
    """Questions that point back, ones that don't, and what a model makes of them."""
    c, t, k = table(spark, sf, "conversations"), F.col("turn") % 5, F.col("conv_id") % 4
    q = F.when(t == 0, F.col("text")).when(t == 1, "那这个怎么办？").when(t == 2, "它的期限是多少？").when(t == 3, "").otherwise("那呢？")
    raw = F.when(k == 0, "改写后：退款期限是多少？").when(k == 1, "说明：无").when(k == 2, "它的期限是多少")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), q.alias("query"), (F.col("conv_id") % 3).alias("n_history"), raw.alias("raw"))
    return contracts.rewritten(rows.drop("raw"), rows.select("query_id", "raw")).select("query_id", "rewritten_query", "rewritten", "source")
