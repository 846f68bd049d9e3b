"""A conversation's course: numbered events, steps with their cost, and the segments of a reasoning text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Numbered lines; lines of nothing but spaces and tabs part blocks.
NUMBERED = re.compile(r"\s*\d+[.、)]\s*")
BLOCK = re.compile(r"(?:(?![ \t]*(?:\n|\Z))[^\n]*(?:\n|\Z))+")


def numbered(events: DataFrame, by: str, *order: str, out: str = "seq") -> DataFrame:
    """events with their number in the request, from 1."""
    return events.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def collected(events: DataFrame, by: str, step: str = "step_id", kind: str = "kind", at: str = "at_ms") -> DataFrame:
    """(by, step, started, finished, cost_ms): each step's first start with its first finish from then on; unfinished steps have no cost, finishes without a start go."""
    starts = events.where(F.col(kind) == "start").groupBy(by, step).agg(F.min(at).alias("started"))
    ends = events.where(F.col(kind) == "finish").select(by, step, F.col(at).alias("end"))
    rows = starts.join(ends, [by, step], "left").groupBy(by, step, "started").agg(F.min(F.when(F.col("end") >= F.col("started"), F.col("end"))).alias("finished"))
    return rows.withColumn("cost_ms", F.col("finished") - F.col("started"))


def segments(text: str | None) -> list[dict]:
    """Spans of the blocks between blank lines; a block of several lines that are all numbered gives its lines."""
    out = []

    def stripped(a: int, b: int) -> dict | None:
        s = text[a:b]
        inner = s.strip()
        start = a + len(s) - len(s.lstrip())
        return {"start": start, "end": start + len(inner)} if inner else None

    for m in BLOCK.finditer(text or ""):
        lines = [s for x in re.finditer(r"[^\n]+", m.group()) if (s := stripped(m.start() + x.start(), m.start() + x.end()))]
        if len(lines) > 1 and all(NUMBERED.match(text, s["start"], s["end"]) for s in lines):
            out += lines
        elif whole := stripped(*m.span()):
            out.append(whole)
    return out


def reasoning_segments(text: Column) -> Column:
    """Character spans (start, end) of a reasoning text's segments, end exclusive."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(segments)

    return found(text)


def timed_history(messages: DataFrame, steps: str = "steps", reasoning: str = "reasoning") -> DataFrame:
    """messages with ``timeline``: whether the message is an assistant's and has steps or reasoning to show."""
    return messages.withColumn("timeline", (F.col("role") == "assistant") & ((F.coalesce(F.size(steps), F.lit(0)) > 0) | (F.coalesce(F.length(reasoning), F.lit(0)) > 0)))


def prompt(system: Column, context: Column, history: Column, user: Column, rules: Column | None = None) -> Column:
    """An array of (role, content): system prompt with the reference block, rules first, then history, then the user."""
    block = F.when(F.length(context) > 0, F.concat_ws("\n\n", *([rules] if rules is not None else []), context))
    head = F.concat_ws("\n\n", F.nullif(system, F.lit("")), block)
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.concat(F.when(head != "", F.array(one("system", head))).otherwise(F.array().cast("array<struct<role:string,content:string>>")), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(one("user", user)))


def flattened(content: Column) -> Column:
    """The text of a message's content as JSON: a string, or a list of strings and {"text": ...} blocks."""
    parts = F.transform(F.from_json(content, "array<string>"), lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.when(~p.startswith("{"), p), F.lit("")))
    return F.when(F.ltrim(content).startswith("["), F.array_join(parts, "")).otherwise(content)
