"""What plugs into retrieval from outside: retrievers, rerankers and rewriters as functions over DataFrames, and table functions for SQL."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.config import RagConfig
from orrery.operators import retrieval, rewrite
from orrery.operators.lineage import cut

log = logging.getLogger(__name__)
#: Why a query is searched for as it is, or rewritten.
DISABLED, NO_CONTEXT, NOT_NEEDED, MODEL, FAILURE = "DISABLED", "NO_CONTEXT", "NOT_NEEDED", "MODEL", "FAILURE"
#: queries (query_id, ...) -> ranked hits (query_id, doc_id, rank, and score if it has one).
Retrieve = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Retriever:
    """An optional one that fails adds nothing; one that isn't fails the search."""

    name: str
    retrieve: Retrieve
    weight: float = 1.0
    optional: bool = False


@dataclass
class Retrievers:
    """The retrievers that take part in a search, in the order in which they were added: ties go to the earlier."""

    known: dict[str, Retriever] = field(default_factory=dict)

    def add(self, name: str, weight: float = 1.0, optional: bool = False) -> Callable[[Retrieve], Retrieve]:
        def register(f: Retrieve) -> Retrieve:
            if name in self.known:
                raise ValueError(f"{name} is registered already")
            self.known[name] = Retriever(name, f, weight, optional)
            return f

        return register

    def search(self, queries: DataFrame, config: RagConfig = RagConfig(), names: list[str] | None = None) -> DataFrame:
        """The retrievers' lists, fused by weighted reciprocal ranks. Each list is run, and kept, on its own, so that failing is told apart."""
        lists = []
        for name in self.known if names is None else names:
            r = self.known[name]
            try:
                lists.append((cut(r.retrieve(queries)), r.name, r.weight))
            except Exception:
                if not r.optional:
                    raise
                log.warning("retriever %s failed and is left out", name, exc_info=True)
        if not lists:
            raise ValueError("no retriever took part")
        return retrieval.rrf(lists, config.rrf_k, config.candidate_k if config.rerank else config.top_k)


def reranked(hits: DataFrame, score: Callable[[DataFrame], Column], top: int, threshold: float = 0.0) -> DataFrame:
    """Hits (query_id, rank, ...) by a scorer's column, from the threshold on, the first ``top`` of each query; those without a score go. The hits' own columns stay as they are."""
    scored = hits.withColumn("rerank_score", score(hits).cast("double")).where(F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.col("rerank_score") >= threshold))
    return retrieval.ranked(scored, max(1, top), F.desc("rerank_score"), F.col("rank"), out="new_rank")


def rewritten(queries: DataFrame, proposals: DataFrame | None, enabled: bool = True) -> DataFrame:
    """(query_id, original_query, rewritten_query, rewritten, source) of queries (query_id, query, n_history) and what a model made of them (query_id, raw).

    Only queries that need it are rewritten, and only by usable proposals; a missing or unusable one leaves the query as it is.
    """
    text = F.coalesce("query", F.lit(""))
    joined = queries.join(proposals.select("query_id", "raw"), "query_id", "left") if proposals is not None else queries.withColumn("raw", F.lit(None).cast("string"))
    clean = joined.withColumn("clean", rewrite.sanitized(F.col("raw"), F.col("query")))
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s？?。.!！]+", ""))
    source = (
        F.when(F.lit(not enabled), DISABLED)
        .when((F.trim(text) == "") | (F.coalesce("n_history", F.lit(0)) <= 0), NO_CONTEXT)
        .when(~rewrite.needs_rewrite(F.col("query"), F.col("n_history")), NOT_NEEDED)
        .when(F.col("clean").isNull(), FAILURE)
        .when(plain(F.col("clean")) == plain(text), NOT_NEEDED)
        .otherwise(MODEL)
    )
    out = clean.withColumn("source", source).withColumn("rewritten", F.col("source") == MODEL)
    return out.select("query_id", F.col("query").alias("original_query"), F.when(F.col("rewritten"), F.col("clean")).otherwise(F.col("query")).alias("rewritten_query"), "rewritten", "source")


class QueryTerms:
    """A query's search terms: identifiers, words, numbers and pairs of CJK characters, each once, in this order."""

    def eval(self, query: str, most: int) -> Iterator[tuple]:
        text, found = query or "", {}
        named = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+"
        rest = re.sub(named, " ", text)
        every = re.findall(named, text) + re.findall("[A-Za-z]{2,}", rest) + re.findall("[0-9]{2,}", rest)
        every += [run[k : k + 2] for run in re.findall("[一-鿿]{2,}", rest) for k in range(len(run) - 1)]
        for term in every:
            found.setdefault(term.lower(), term)
        for k, term in enumerate([*found.values()][: max(0, most)]):
            yield term, k + 1


class WithinBudget:
    """The rows of a query's hits, given in rank order, as far as their texts fit into a budget of characters; the first always does."""

    def __init__(self) -> None:
        self.used = self.n = 0
        self.full = False

    def eval(self, budget: int, row) -> Iterator[tuple]:
        size = len(row["text"] or "")
        self.full = self.full or (self.n > 0 and self.used + size > budget)
        if not self.full:
            self.n, self.used = self.n + 1, self.used + size
            yield row["query_id"], row["doc_id"], self.n, self.used


def register(spark: SparkSession) -> None:
    """Makes ``query_terms(query, most)`` and ``within_budget(budget, TABLE(hits) PARTITION BY query_id ORDER BY rank)`` known to SQL."""
    spark.udtf.register("query_terms", F.udtf(QueryTerms, returnType="term string, pos int"))
    spark.udtf.register("within_budget", F.udtf(WithinBudget, returnType="query_id long, doc_id long, n int, used long"))
