"""A conversation's messages as the next turn sees them: history of the last rounds, its text, and the timeline of thoughts and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.config import RagConfig
from orrery.operators import steps

#: How roles are written in a history, and the keys that models give their reasoning under, the first filled one wins.
SPEAKERS = {"user": "用户", "assistant": "助手"}
REASONING_KEYS = ("reasoning_content", "reasoning", "reasoning_details", "thinking")


def history(messages: DataFrame, rounds: int = RagConfig.history_rounds, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``rounds`` rounds, of two messages each, of every conversation; all messages where rounds is 0. Tasks keep no more of a conversation before it is shuffled."""
    if rounds <= 0:
        return messages
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return messages.withColumn("from the end", place).where(F.col("from the end") <= 2 * rounds).drop("from the end")


def history_before(messages: DataFrame, rounds: int = RagConfig.history_rounds, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages with ``history``: an array of (role, content) of the last rounds before each message, itself not among them."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(-2 * rounds if rounds > 0 else Window.unboundedPreceding, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before))


def history_text(messages: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(by, history): a line for each message that isn't empty, in order."""
    speaker = F.col("role")
    for role, name in SPEAKERS.items():
        speaker = F.when(F.col("role") == role, name).otherwise(speaker)
    rows = messages.where("text <> ''").select(by, F.struct(order, F.concat(speaker, F.lit(": "), F.col("text")).alias("line")).alias("m"))
    return rows.groupBy(by).agg(F.sort_array(F.collect_list("m")).alias("m")).select(by, F.array_join(F.transform("m", lambda m: m["line"]), "\n").alias("history"))


def reasoning_of(extras: Column) -> Column:
    """The reasoning text among a message's extra fields, as JSON; null if there is none."""
    return F.coalesce(*(F.nullif(F.get_json_object(extras, f"$.{k}"), F.lit("")) for k in REASONING_KEYS))


def timelines(messages: DataFrame) -> DataFrame:
    """(message_id, pos, step_id, kind, start, end): actions and thoughts in one order, of the assistant's messages (message_id, role, reasoning, steps) that have either.

    A step is (step_id, kind, reasoning_offset); it comes where its offset stands in the reasoning, before the thought that starts there, and a thought that it falls into is cut in two.
    """
    own = messages.where("role = 'assistant'").select("message_id", F.coalesce("reasoning", F.lit("")).alias("reasoning"), "steps")
    acts = own.select("message_id", F.explode("steps").alias("s"), F.length("reasoning").alias("length")).where("s is not null")
    at = F.greatest(F.lit(0), F.least(F.coalesce("s.reasoning_offset", F.lit(0)), F.col("length")))
    acts = acts.select("message_id", F.coalesce("s.step_id", F.lit("step")).alias("step_id"), F.coalesce("s.kind", F.lit("tool")).alias("kind"), at.alias("at"))
    thoughts = own.where("reasoning <> ''").select("message_id", F.explode(steps.reasoning_segments(F.col("reasoning"))).alias("s")).select("message_id", "s.start", "s.end")
    inner = thoughts.join(acts.groupBy("message_id").agg(F.collect_set("at").alias("cuts")), "message_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    points = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), F.filter("cuts", lambda c: (c > F.col("start")) & (c < F.col("end"))))))
    parts = inner.withColumn("p", points).select("message_id", F.explode(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda a, k: F.struct(a.alias("start"), F.get("p", k + 1).alias("end")))).alias("s"))
    none = F.lit(None).cast("int")
    rows = acts.select("message_id", "at", F.lit(0).alias("order"), "step_id", "kind", none.alias("start"), none.alias("end"))
    rows = rows.unionAll(parts.select("message_id", "s.start", F.lit(1), F.concat(F.lit("reasoning-"), F.col("s.start")), F.lit("thinking"), "s.start", "s.end"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("message_id").orderBy("at", "order", "step_id")) - 1).select("message_id", "pos", "step_id", "kind", "start", "end")


def citation_numbers(hits: DataFrame, by: str, *order: str, start: Column | int = 0) -> DataFrame:
    """hits with ``idx``: one numbering for all passages shown in a request, in the order of ``order``, after the ``start`` ones shown before."""
    first = F.lit(start) if isinstance(start, int) else start
    return hits.withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy(*order)) + first)


