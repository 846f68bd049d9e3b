"""Answers: when to abstain, their grounding record, and how a run's answers and reviews add up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from orrery.config import RagConfig
from orrery.operators.evaluation import points_matched, points_supported
from orrery.operators.grounding import assess, audit, is_refusal
from orrery.operators.lineage import cut

#: The tool that doesn't count as another one, and a review's verdicts.
KNOWLEDGE_TOOL = "knowledge_retrieval"
PASS, FAIL, UNSURE = "通过", "不通过", "存疑"
COLUMNS = ("id", "分类", "问题", "期望答案", "实际答案", "hit@5", "要点命中", "有引用", "引用审计", "人工结论", "备注")


def has_other_tools(tools: Column) -> Column:
    return F.coalesce(F.size(F.array_except(tools, F.array(F.lit(KNOWLEDGE_TOOL)))) > 0, F.lit(False))


def _bound(knowledge_ids: Column) -> Column:
    return F.coalesce(F.size(knowledge_ids) > 0, F.lit(False))


def should_abstain(sufficient: Column, knowledge_ids: Column, tools: Column, config: RagConfig = RagConfig()) -> Column:
    """Bound to knowledge, both switches on, no other tool to try, and evidence that doesn't suffice."""
    return F.lit(config.grounding and config.abstain) & _bound(knowledge_ids) & ~has_other_tools(tools) & ~sufficient


def needs_note(sufficient: Column, knowledge_ids: Column, tools: Column, config: RagConfig = RagConfig()) -> Column:
    """Evidence doesn't suffice, yet the model is asked: its prompt has to say so."""
    return F.lit(config.grounding) & _bound(knowledge_ids) & ~sufficient & ~should_abstain(sufficient, knowledge_ids, tools, config)


def grounding_record(answer: Column, sources: Column, reason: Column, n_hits: Column, best: Column, abstained: Column, config: RagConfig = RagConfig()) -> Column:
    """What is reported with an answer; null where grounding is off. A null reason: nothing was retrieved for it."""
    known = F.coalesce(sources, F.array().cast("array<int>"))
    a = audit(F.coalesce(answer, F.lit("")), known)
    record = F.struct(
        F.coalesce(reason, F.lit("ok")).alias("reason"), abstained.alias("abstained"), F.coalesce(n_hits, F.lit(0)).alias("hit_count"), F.size(known).alias("source_count"),
        best.alias("best_score"), a["cited"].alias("cited"), F.array_sort(a["invalid"]).alias("invalid_cited"), a["uncited_claims"].alias("uncited_claims"),
    )
    return F.when(F.lit(config.grounding), record)


def citation_metrics(answer: Column, sources: Column) -> Column:
    """(cited, invalid, uncited_claims, has_citation)."""
    a = audit(F.coalesce(answer, F.lit("")), F.coalesce(sources, F.array().cast("array<int>")))
    return F.struct(a["cited"].alias("cited"), F.array_sort(a["invalid"]).alias("invalid"), a["uncited_claims"].alias("uncited_claims"), (F.size(a["cited"]) > 0).alias("has_citation"))


def abstain_pass(answer: Column, abstained: Column, message: str = "") -> Column:
    return F.coalesce(abstained, F.lit(False)) | is_refusal(answer, message)


def answer_run(questions: DataFrame, supplied: DataFrame, retrieve: Callable[[DataFrame], DataFrame], contents: DataFrame, config: RagConfig = RagConfig(), message: str = "") -> DataFrame:
    """One row for each question (query_id, category, abstain_expected, points, knowledge_ids, tools), with what rollup() needs and the grounding.

    ``retrieve`` gives hits (query_id, doc_id, rank, rerank_score) for the questions that are bound to knowledge; no others are searched for. Where
    the evidence calls for abstaining, the answer is ``message``, and neither texts nor sources are gathered for it; the other
    answers are the ``supplied`` ones (query_id, answer, latency_ms), audited against their hits' contents (doc_id, text).
    """
    bound = questions.where(_bound(F.col("knowledge_ids")))
    hits = cut(retrieve(bound.select("query_id")))
    known = assess(questions, hits, config.abstain_min_score).join(questions, "query_id")
    is_bound = _bound(F.col("knowledge_ids"))
    known = cut(known.withColumn("abstained", should_abstain(F.col("sufficient"), F.col("knowledge_ids"), F.col("tools"), config)).withColumn("reason", F.when(is_bound, F.col("reason"))))
    held = contents.join(hits.select("doc_id"), "doc_id", "left_semi")  # no other texts are shuffled
    answered = hits.join(known.where("not abstained").select("query_id"), "query_id", "left_semi").join(held, "doc_id")
    passages = answered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    passages = passages.select("query_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("context"), F.transform("p", lambda p: p["rank"].cast("int")).alias("sources"))
    rows = known.join(supplied, "query_id", "left").join(passages, "query_id", "left")
    answer = F.when(F.col("abstained"), F.lit(message)).otherwise(F.coalesce("answer", F.lit("")))
    rows = rows.withColumn("answer", answer).withColumn("grounding", grounding_record(F.col("answer"), F.col("sources"), F.col("reason"), F.col("n_hits"), F.col("best_score"), F.col("abstained"), config))
    m = citation_metrics(F.col("answer"), F.col("sources"))
    return rows.select(
        "query_id", "category", "abstain_expected", "abstained", "answer", "grounding", "latency_ms", points_matched(F.col("answer"), F.col("points")).alias("correctness"),
        points_supported(F.col("answer"), F.coalesce("context", F.lit("")), F.col("points")).alias("supported"), m["invalid"].alias("invalid"), m["has_citation"].alias("has_citation"),
        m["uncited_claims"].alias("uncited_claims"), abstain_pass(F.col("answer"), F.col("abstained"), message).alias("abstain_pass"),
    )


def rollup(answers: DataFrame) -> DataFrame:
    """Means and sums of (category, correctness, supported, invalid, has_citation, abstain_expected, abstained, abstain_pass, latency_ms, uncited_claims), overall (category null) and by category, in one pass.

    Means skip nulls; abstain_accuracy is over items without an answer, false_abstain_rate over the others.
    """
    expected = F.col("abstain_expected")
    aggregates = [
        F.avg("correctness").alias("answer_correctness"),
        F.avg("supported").alias("points_supported_rate"),
        F.avg(F.when(F.size("invalid") > 0, 0.0).otherwise(1.0)).alias("citation_valid_rate"),
        F.avg(F.col("has_citation").cast("double")).alias("cited_present_rate"),
        F.avg(F.when(expected, F.col("abstain_pass").cast("double"))).alias("abstain_accuracy"),
        F.avg(F.when(~expected, F.col("abstained").cast("double"))).alias("false_abstain_rate"),
        F.sum("uncited_claims").cast("double").alias("uncited_claims_total"),
        F.avg(F.col("latency_ms").cast("double")).alias("latency_ms"),
    ]
    named = answers.withColumn("category", F.coalesce("category", F.lit("unknown")))
    return named.rollup("category").agg(*aggregates)


def review_sheet(rows: DataFrame, *columns: str) -> DataFrame:
    """(line): a Markdown table with a line for each row, its verdict and remark left empty; ``columns`` name the nine others in order."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns), F.lit(""), F.lit("")), F.lit(" |")).alias("line"))


def sheet_head() -> list[str]:
    return ["| " + " | ".join(COLUMNS) + " |", "| " + " | ".join("---" for _ in COLUMNS) + " |"]


def parsed_sheet(lines: DataFrame, at: str = "at", line: str = "line") -> DataFrame:
    """(id, verdict) of a sheet's lines (at, line): of several verdicts on a question the last counts; unknown ones don't."""
    bare = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
    cells = lines.where(F.trim(line).startswith("|")).select(F.col(at).alias("at"), F.transform(F.split(bare, r"(?<!\\)\|", -1), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|"))).alias("c"))
    found = cells.where(F.size("c") == len(COLUMNS)).select("at", F.get("c", F.lit(0)).alias("id"), F.get("c", F.lit(COLUMNS.index("人工结论"))).alias("verdict"))
    return found.where((F.col("id") != "") & F.col("verdict").isin(PASS, FAIL, UNSURE)).groupBy("id").agg(F.max_by("verdict", "at").alias("verdict"))


def review_summary(verdicts: DataFrame, verdict: str = "verdict") -> DataFrame:
    """One row: counts of each verdict, those filled in, and the share that passes, null without any."""
    n = lambda v: F.count_if(F.col(verdict) == v)
    out = verdicts.agg(n(PASS).alias("passed"), n(FAIL).alias("failed"), n(UNSURE).alias("unsure"))
    filled = F.col("passed") + F.col("failed") + F.col("unsure")
    return out.select(filled.alias("filled"), "*", (F.col("passed") / F.nullif(filled, F.lit(0))).alias("pass_rate"))


def token_totals(chunks: DataFrame, by: str, message: str, order: str, tokens: str) -> DataFrame:
    """(by, tokens): usage of a stream's chunks; the first chunk of a message id counts, chunks without an id all do, those without usage don't."""
    usage = chunks.where(F.col(tokens).isNotNull())
    named = usage.where(F.col(message).isNotNull()).groupBy(by, message).agg(F.min_by(tokens, order).alias("n")).select(by, "n")
    loose = usage.where(F.col(message).isNull()).select(by, F.col(tokens).alias("n"))
    return named.unionByName(loose).groupBy(by).agg(F.sum("n").cast("long").alias("tokens"))
