"""Reports of evaluation runs: one table of metrics for all runs, JSON for exchange, text for reading."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.operators import evaluation, retrieval

CUT = 20


def retrieval_run(questions: DataFrame, hits: DataFrame, ks: list[int], top: int = 10) -> DataFrame:
    """(question_id, category, metric, value) of all questions at once, over at most ``top`` hits each."""
    best = hits.where(F.col("rank") <= top)
    scores = evaluation.retrieval_scores(questions, best, ks)
    return evaluation.long_form(scores, ["question_id"]).join(questions.select("question_id", "category"), "question_id")


def build(run_id: str, long: DataFrame, meta: Mapping[str, str]) -> DataFrame:
    """(run_id, scope, category, metric, value, meta): a run's averages, overall and by category."""
    overall = evaluation.macro(long).select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("category"), "metric", "value")
    groups = evaluation.by_category(long).select(F.lit("category").alias("scope"), "category", "metric", "value")
    return overall.unionByName(groups).select(F.lit(run_id).alias("run_id"), "*", F.lit(json.dumps(dict(meta), sort_keys=True)).alias("meta"))


def append(report: DataFrame, path: str) -> None:
    """Adds a run to the table of runs; a run that is written again replaces itself."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def to_json(report: DataFrame) -> DataFrame:
    """(value): one JSON object for each run."""
    rows = F.sort_array(F.collect_list(F.struct("scope", "category", "metric", "value")))
    return report.groupBy("run_id", "meta").agg(rows.alias("metrics")).select(F.to_json(F.struct("run_id", "meta", "metrics")).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    """What to_json wrote, as a report."""
    kinds = "run_id string, meta string, metrics array<struct<scope:string,category:string,metric:string,value:double>>"
    parsed = lines.select(F.from_json("value", kinds).alias("r")).select("r.run_id", "r.meta", F.explode("r.metrics").alias("m"))
    return parsed.select("run_id", "m.scope", "m.category", "m.metric", "m.value", "meta")


def rendered(headers: list[str], rows: list[tuple]) -> str:
    """A text table; nulls as dashes, numbers to three places."""
    shown = [["-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in [tuple(headers), *rows]]
    widths = [max(len(r[k]) for r in shown) for k in range(len(headers))]
    return "\n".join("  " + "  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in shown)


def summary(report: DataFrame) -> str:
    """The overall averages of a run, as many rows as there are metrics."""
    rows = report.where("scope = 'overall'").orderBy("metric").select("metric", "value").collect()
    return rendered(["metric", "value"], [tuple(r) for r in rows])


def diff_text(diff: DataFrame, changes: DataFrame, cut: int = CUT) -> str:
    """A comparison of two runs: all metrics, and the first ``cut`` questions of each kind of change."""
    metrics = rendered(["metric", "before", "after", "delta", "direction"], [tuple(r) for r in diff.orderBy("metric").collect()])
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    first = retrieval.ranked(changes, cut, F.col("question_id"), by="change").orderBy("change", "rank").collect()
    lines = [f"{c} ({n}): " + ", ".join(str(r["question_id"]) for r in first if r["change"] == c) + (" …" if n > cut else "") for c, n in sorted(counts.items())]
    return "\n".join([metrics, *lines])


def read(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)
