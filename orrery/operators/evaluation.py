"""Scores of retrieval and answers, averages, differences between runs, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Metrics that are better when lower.
LOWER_IS_BETTER = ("uncited_claims_total", "false_abstain_rate", "latency_ms")


def evidence_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, evidence, rank): the ranks of hits (question_id, rank, content) that hold a question's evidence."""
    wanted = questions.select("question_id", F.explode("evidence").alias("evidence"))
    return hits.join(wanted, "question_id").where(F.expr("contains(content, evidence)")).select("question_id", "evidence", "rank")


def retrieval_scores(questions: DataFrame, hits: DataFrame, ks: list[int]) -> DataFrame:
    """hit@k and evidence_recall@k for each k, and the reciprocal rank of the first evidence over all hits; null without evidence."""
    found = evidence_hits(questions, hits)
    cols: list[Column] = [F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        cols.append(F.coalesce(F.max(F.when(F.col("rank") <= k, 1.0)), F.lit(0.0)).alias(f"hit@{k}"))
        cols.append(F.count_distinct(F.when(F.col("rank") <= k, F.col("evidence"))).alias(f"covered@{k}"))
    graded = questions.select("question_id", F.size("evidence").alias("n"))
    out = graded.join(found, "question_id", "left").groupBy("question_id", "n").agg(*cols)
    has = F.col("n") > 0
    scores = [F.when(has, F.col("mrr")).alias("mrr")]
    for k in ks:
        scores += [F.when(has, F.col(f"hit@{k}")).alias(f"hit@{k}"), F.when(has, F.col(f"covered@{k}") / F.col("n")).otherwise(1.0).alias(f"evidence_recall@{k}")]
    return out.select("question_id", *scores)


def source_recall(found: Column, expected: Column) -> Column:
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(found, expected)) / F.size(expected))


def points_matched(answer: Column, points: Column) -> Column:
    """The share of the points that the answer holds; null without points."""
    return F.when(F.size(points) > 0, F.size(F.filter(points, lambda p: answer.contains(p))) / F.size(points))


def points_supported(answer: Column, context: Column, points: Column) -> Column:
    """Of the points that the answer holds, the share that the context holds too; null if it holds none."""
    own = F.filter(points, lambda p: answer.contains(p))
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda p: context.contains(p))) / F.size(own))


def long_form(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Wide scores as (keys, metric, value)."""
    names = [c for c in scores.columns if c not in keys]
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in names))
    return scores.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def macro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of a metric over questions, nulls skipped; metrics without a value go."""
    return scores.groupBy(*(by or []), "metric").agg(F.avg("value").alias("value"), F.count("value").alias("n")).where("n > 0").drop("n")


def by_category(scores: DataFrame) -> DataFrame:
    """Macro averages of (question_id, category, metric, value) by category, with _count, the graded questions of each."""
    named = scores.withColumn("category", F.coalesce("category", F.lit("unknown"))).where("value is not null")
    counts = named.groupBy("category").agg(F.count_distinct("question_id").cast("double").alias("value")).select("category", F.lit("_count").alias("metric"), "value")
    return macro(named, ["category"]).unionByName(counts)


def diff(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(metric, before, after, delta, direction) over the metrics of either run."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    bare = F.regexp_replace("metric", "^answers\\.", "")
    better = F.when(bare.isin(*LOWER_IS_BETTER), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    direction = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.abs("delta") <= tolerance, "unchanged").when(better, "improved").otherwise("regressed")
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("direction", direction)


def question_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question_id, change): added, removed, improved or regressed by value; equal values don't appear."""
    both = before.select("question_id", F.col("value").alias("b"), F.lit(1).alias("inb")).join(after.select("question_id", F.col("value").alias("a"), F.lit(1).alias("ina")), "question_id", "full_outer")
    change = F.when(F.col("inb").isNull(), "added").when(F.col("ina").isNull(), "removed").when(F.col("a") > F.col("b"), "improved").when(F.col("a") < F.col("b"), "regressed")
    return both.select("question_id", change.alias("change")).where("change is not null")


def threshold_metric(key: Column) -> Column:
    """The metric that a threshold's key names: hit_at_5 is hit@5, others are themselves."""
    return F.regexp_replace(key, "_at_([0-9]+)$", "@$1")


def unknown_keys(row: Column, known: list[str]) -> Column:
    """The keys of a JSON object that aren't among the known ones."""
    return F.array_except(F.json_object_keys(row), F.array(*map(F.lit, known)))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds (metric, floor) that fail: measured below, or not at all."""
    named = thresholds.withColumn("metric", threshold_metric(F.col("metric")))
    return named.join(metrics.select("metric", "value"), "metric", "left").where(F.col("value").isNull() | (F.col("value") < F.col("floor")))


def violations(questions: DataFrame, categories: list[str], behaviours: list[str]) -> DataFrame:
    """(question_id, problem) for each rule that a golden question breaks."""
    evidence, history = F.coalesce(F.size("evidence"), F.lit(0)), F.coalesce(F.size("history"), F.lit(0))
    answers = F.col("behaviour") == "answer"
    rules = {
        "bad category": ~F.col("category").isin(*categories),
        "bad behaviour": ~F.col("behaviour").isin(*behaviours),
        "missing evidence": answers & (evidence == 0),
        "evidence on abstain": ~answers & (evidence > 0),
        "missing history": F.col("category").isin("multi_turn", "anaphora") & (history == 0),
        "duplicate id": F.col("copies") > 1,
    }
    problems = F.filter(F.array(*(F.when(F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items())), lambda p: p.isNotNull())
    counted = questions.withColumn("copies", F.count("*").over(Window.partitionBy("question_id")))
    return counted.withColumn("problems", problems).select("question_id", F.explode("problems").alias("problem")).distinct()
