"""Documents as files, and golden questions as TOML."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions.text import extension
from orrery.operators.evaluation import violations

EXTENSIONS, MAX_BYTES = ("txt", "md"), 10 << 20
CATEGORIES = ("simple_fact", "keyword", "proper_noun", "multi_turn", "anaphora", "cross_chunk", "no_answer")
QUESTION = "question_id string, category string, question string, evidence array<string>, sources array<string>, behaviour string, history array<struct<role:string,content:string>>"


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): texts of supported files with their digest; files that are empty, too large or of another kind, and why."""
    files = spark.read.format("binaryFile").load(path).withColumn("ext", extension(F.col("path")))
    reason = F.when(~F.col("ext").isin(*EXTENSIONS), "unsupported").when(F.col("length") > MAX_BYTES, "too large")
    checked = files.withColumn("reason", reason)
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), r"\r\n?", "\n")
    good = checked.where("reason is null").select("path", "ext", "length", F.sha2("content", 256).alias("sha256"), text.alias("text"))
    bad = checked.where("reason is not null").select("path", "length", "reason")
    empty = spark.createDataFrame(_empty(spark, path), "path string").withColumn("ext", extension(F.col("path")))
    return good, bad.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.when(F.col("ext").isin(*EXTENSIONS), "empty").otherwise("unsupported").alias("reason")))


def _empty(spark: SparkSession, path: str) -> list[tuple[str]]:
    """Files without content, which Spark's reader leaves out, from the listing of their folder."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(place) or []
    out = []
    for top in found:
        entries = top.getPath().getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(top.getPath())
        out += [(e.getPath().toString(),) for e in entries if e.isFile() and e.getLen() == 0]
    return out


def read_golden(spark: SparkSession, text: str) -> DataFrame:
    """Golden questions of a TOML text; raises with every problem found."""
    raw = tomllib.loads(text)
    rows = [
        (q.get("id"), q.get("category"), q.get("question"), q.get("expected_evidence", []), q.get("expected_source", []), q.get("expected_behavior", "answer"), [(h["role"], h["content"]) for h in q.get("history", [])])
        for d in raw.get("datasets", [])
        for q in d.get("questions", [])
    ]
    questions = spark.createDataFrame(rows, QUESTION)
    problems = [f"{r.question_id}: {r.problem}" for r in violations(questions, list(CATEGORIES), ["answer", "abstain"]).orderBy("question_id", "problem").collect()]
    if problems:
        raise ValueError("; ".join(problems))
    return questions
