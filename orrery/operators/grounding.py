"""Whether the evidence suffices, and whether an answer's citations hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Phrases that mark a refusal, and where sentences end.
REFUSALS = ("无法确认", "无法回答", "无法确定", "无法提供", "资料不足", "没有找到", "未检索到", "未找到")
SENTENCE_END, CLAIM_LENGTH = r"[。！？!?\n]+", 12


def evidence(n_hits: Column, best: Column, least: float = 0.35) -> Column:
    """Why evidence does or doesn't suffice. Without any valid score it does (no_score)."""
    return F.when(n_hits == 0, "no_hits").when(best.isNull(), "no_score").when(best >= least, "ok").otherwise("low_relevance")


def assess(queries: DataFrame, hits: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, n_hits, best_score, reason, sufficient) for each query, from hits (query_id, rerank_score)."""
    best = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.max("rerank_score").alias("best_score"))
    out = queries.select("query_id").join(best, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    reason = evidence(F.col("n_hits"), F.col("best_score"), least)
    return out.withColumn("reason", reason).withColumn("sufficient", F.col("reason").isin("ok", "no_score"))


def is_refusal(answer: Column, message: str = "") -> Column:
    marks = [m for m in (message, *REFUSALS) if m]
    out = F.lit(False)
    for m in marks:
        out = out | answer.contains(m)
    return F.coalesce(out & (F.trim(answer) != ""), F.lit(False))


def cited(answer: Column) -> Column:
    """The distinct numbers in brackets, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))))


def audit(answer: Column, sources: Column) -> Column:
    """(cited, invalid, uncited_claims) of an answer against the indices of its sources."""
    sentences = F.transform(F.split(answer, SENTENCE_END), F.trim)
    claim = lambda s: (F.length(s) >= CLAIM_LENGTH) & ~s.rlike(r"\[[0-9]{1,3}\]") & ~is_refusal(s)
    return F.struct(cited(answer).alias("cited"), F.array_except(cited(answer), sources).alias("invalid"), F.size(F.filter(sentences, claim)).alias("uncited_claims"))


def anchors(messages: DataFrame, by: str, order: str, length: Column) -> DataFrame:
    """messages with the running length of what came before in their group, which places steps on a timeline."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("anchor", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def timeline(steps: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Actions (message_id, step_id, at) and thinking segments (message_id, start, end) in one order.

    Offsets are clamped to the reasoning's length; segments are cut where actions fall inside them; at one
    place the action comes first.
    """
    length = thoughts.groupBy("message_id").agg(F.max("end").alias("length"))
    acts = steps.join(length, "message_id", "left").select("message_id", "step_id", F.greatest(F.lit(0), F.least("at", F.coalesce("length", F.lit(0)))).alias("at"))
    inner = thoughts.join(acts.groupBy("message_id").agg(F.collect_set("at").alias("cuts")), "message_id", "left")
    points = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > F.col("start")) & (c < F.col("end"))))))
    parts = inner.withColumn("p", points).select("message_id", F.explode(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda a, k: F.struct(a.alias("at"), F.get("p", k + 1).alias("end")))).alias("s"))
    both = acts.select("message_id", "at", F.lit(None).cast("int").alias("end"), "step_id", F.lit(0).alias("kind")).unionByName(parts.select("message_id", "s.at", "s.end", F.lit(None).cast("string").alias("step_id"), F.lit(1).alias("kind")))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("message_id").orderBy("at", "kind", "end", "step_id")))
