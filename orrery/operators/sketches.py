"""Mergeable sketches of usage facts: distinct users and quantiles of a measure, kept by day and rolled up to periods without the facts.

A stored row holds sums beside a HyperLogLog sketch and a KLL sketch. Rows of new facts are merged into stored ones, so a day that
gets late facts isn't read again. Distinct counts are off by about 1.04 / sqrt(2^LG_K) (1.6 %, one standard deviation), ranks of quantiles by 1.33 % at most with a confidence of 99 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LG_K, KLL_K = 12, 200


def sketched(facts: DataFrame, keys: list[str], distinct: str = "user_id", measure: str = "total_cost") -> DataFrame:
    """(keys, calls, total_tokens, distinct_sketch, quantile_sketch) of facts. Null measures count in no quantile, null identifiers in no distinct count."""
    return facts.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(measure).cast("double"), KLL_K).alias("quantile_sketch"),
    )


def rolled_up(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows merged to coarser keys."""
    return stored.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def merged(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of new facts; to be written in one atomic overwrite."""
    return rolled_up(stored.unionByName(fresh), keys)


def estimates(stored: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(keys, calls, total_tokens, users, and each named quantile; null where no measure was known)."""
    known = F.kll_sketch_get_n_double("quantile_sketch") > 0

    def at(q: float) -> Column:
        return F.when(known, F.kll_sketch_get_quantile_double(F.col("quantile_sketch"), F.lit(q)))

    return stored.select(*keys, "calls", "total_tokens", F.hll_sketch_estimate("distinct_sketch").alias("users"), *(at(q).alias(name) for name, q in quantiles.items()))
