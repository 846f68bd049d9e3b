"""From raw documents to token shards: five stages, each one operator over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``. run() writes what a stage returns as Parquet in the shared folder and reads it back for the next.

Nulls, empty texts, ties, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import bpe, decontaminate, langid, lines, simhash
from orrery.llm.shared import saved, ship

#: A document goes if its best language has less than this mean probability over its words.
SCORE = 0.4
#: Near copies: texts whose sets of five-word shingles have at least this similarity (Jaccard).
SHINGLE, LEAST = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or without a clear language go."""
    ship(spark)
    model = langid.train(docs)
    found = langid.predict(docs, model, out="lang pred", score="lang score")
    return found.where((F.col("lang pred") != langid.UNKNOWN) & (F.col("lang score") >= SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that come earlier; n_chars follows the text."""
    ship(spark)
    return lines.dedup(docs, count=None).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of several texts under one id that with the smallest MD5.

    A document is an id and its text: others with the same id but another text are judged by their own. Of rows that
    are equal in both one stays. Documents without an id stay.
    """
    ship(spark)
    found = saved(simhash.copies(docs, words=SHINGLE, least=LEAST), "copies")
    own = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("own digest", own)
    is_row = lambda other: (rows["doc_id"] == other["doc_id"]) & (rows["own digest"] == other["digest"])
    gone, repeated = found.where("not kept"), found.where("kept and n_rows > 1")
    kept = rows.join(gone, is_row(gone), "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, is_row(repeated), "left_semi").dropDuplicates(["doc_id", "own digest"])
        kept = kept.join(repeated, is_row(repeated), "left_anti").unionAll(once)
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the packed token ids, and the text that they decode to."""
    ship(spark)
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded", keep_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", simhash_dedup),
    ("decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]
#: SQL cannot express the classifier, the fingerprints and the edit distances. Tests compare the near-copy stage with brute force;
#: of the other stages they hold the operators to brute force, the library or held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
