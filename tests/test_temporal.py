"""Joins by time against brute force, hot keys and plans included."""

import random
import re
from datetime import date, datetime, timedelta

import pytest

from orrery.operators import temporal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(seed, n=600, keys=6):
    r = random.Random(seed)
    key = lambda: r.choice(["hot"] * 4 + [f"k{k}" for k in range(keys)] + [None])
    left = [(k, key(), r.choice([None, *[r.randrange(200)] * 9])) for k in range(n)]
    right = [(key(), r.choice([None, *[r.randrange(200)] * 9]), r.randrange(5)) for k in range(n // 3)]
    return left, right


@pytest.mark.parametrize("hot", [5, 10**6])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof(spark, hot, tolerance):
    left, right = made(hot)
    out = temporal.asof_join(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, since long, v int"), ["k"], "t", "since", ["v"], hot=hot, tolerance=tolerance)
    assert out.columns == ["id", "k", "t", "v"]
    for r in out.collect():
        fit = [(s, v) for k, s, v in right if k == r.k and None not in (k, s, r.t) and s <= r.t]
        best = max(fit, default=(0, None))
        assert r.v == (best[1] if tolerance is None or (fit and r.t - best[0] <= tolerance) else None), r
    assert sorted(r.id for r in out.collect()) == list(range(len(left)))


def test_asof_of_a_hot_key_is_dealt_by_time(spark):
    """All rows have one key: the running window has a partition for each bucket, and no bucket holds much more than its share."""
    from pyspark.sql import functions as F

    one = F.expr("concat('k', id div 1000000)").alias("k")
    left = spark.range(20_000).select(one, F.col("id").alias("t"))
    right = spark.range(0, 20_000, 7).select(one, F.col("id").alias("since"), F.col("id").alias("v"))
    out = temporal.asof_join(left, right, ["k"], "t", "since", ["v"], hot=1000)
    assert out.where("v <> t - t % 7 or v is null").count() == 0 and out.count() == 20_000
    assert re.search(r"Window \[last.*\[k#\d+, bucket#\d+\]", plan(out)) and "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_asof_kinds(spark):
    t = datetime(2024, 3, 1)
    left = spark.createDataFrame([(1, t), (2, t + timedelta(hours=5)), (3, None)], "k int, at timestamp_ntz")
    right = spark.createDataFrame([(1, t.date(), "a"), (2, t.date(), "b"), (2, date(2024, 3, 2), "late"), (3, t.date(), "c")], "k int, day date, v string")
    rows = lambda **more: [(r.k, r.v) for r in temporal.asof_join(left, right, ["k"], "at", "day", ["v"], **more).orderBy("k").collect()]
    assert rows() == [(1, "a"), (2, "b"), (3, None)]
    assert rows(how="inner") == [(1, "a"), (2, "b")] and rows(tolerance=timedelta(hours=4)) == [(1, "a"), (2, None), (3, None)]
    assert temporal.asof_join(left.limit(0), right, ["k"], "at", "day", ["v"]).count() == 0
    assert [r.v for r in temporal.asof_join(left, right.limit(0), ["k"], "at", "day", ["v"]).collect()] == [None] * 3
    with pytest.raises(ValueError):
        temporal.asof_join(left, right.withColumnRenamed("v", "at"), ["k"], "at", "day", ["at"])


@pytest.mark.parametrize("keyed", [True, False])
def test_periods(spark, keyed):
    r = random.Random(4)
    points = [(k, r.choice(["a", "b", None]), r.choice([None, *[r.randrange(-500, 3000)] * 9])) for k in range(300)]
    periods = [(k, r.choice(["a", "b", None]), s, r.choice([None, *[s + r.choice([0, -3, 1, 2, 5, 40, 700, 9000])] * 9])) for k in range(200) for s in [r.randrange(-600, 3000)]]
    p, s = spark.createDataFrame(points, "id int, k string, t long"), spark.createDataFrame(periods, "pid int, k2 string, start long, stop long")
    s = s.withColumnRenamed("k2", "k") if keyed else s
    out = temporal.period_join(p, s, "t", "start", "stop", on=["k"] if keyed else None)
    true = {(i, j) for i, k, t in points for j, k2, a, b in periods if t is not None and a <= t and (b is None or t < b) and (not keyed or (k is not None and k == k2))}
    got = [(x.id, x.pid) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == true
    assert "Join" in plan(out) and "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert temporal.period_join(p.limit(0), s, "t", "start", "stop", on=["k"] if keyed else None).count() == 0
    assert temporal.period_join(p, s.limit(0), "t", "start", "stop", on=["k"] if keyed else None).count() == 0


def test_overlaps(spark):
    r = random.Random(5)
    spans = lambda n: [(k, s, r.choice([None, *[s + r.choice([0, 1, 3, 30, 400])] * 9])) for k in range(n) for s in [r.randrange(1000)]]
    a, b = spans(120), spans(100)
    out = temporal.overlap_join(spark.createDataFrame(a, "i int, a0 long, a1 long"), spark.createDataFrame(b, "j int, b0 long, b1 long"), ("a0", "a1"), ("b0", "b1"))
    end = lambda x: float("inf") if x is None else x
    true = {(i, j) for i, s, e in a for j, u, v in b if s < end(e) and u < end(v) and s < end(v) and u < end(e)}
    got = [(x.i, x.j) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == true


@pytest.mark.parametrize("step", [1, 1000, 86_400_000_000])
def test_totals_without_pairs(spark, step):
    """What points in periods and periods that overlap come to is what their pairs come to, and no plan makes the pairs."""
    from pyspark.sql import functions as F

    r = random.Random(step)
    spans = lambda n: [(k % (n // 2), s * step, r.choice([None, *[(s + r.choice([0, -2, 1, 2, 9, 70, 900])) * step] * 9])) for k in range(n) for s in [r.choice([None, *[r.randrange(-300, 1500)] * 9])] if s is not None]
    a, b = spark.createDataFrame(spans(120), "i int, a0 long, a1 long"), spark.createDataFrame(spans(100), "j int, b0 long, b1 long")
    points = spark.createDataFrame([(k, r.choice([None, *[r.randrange(-400, 1600) * step + r.choice([0, 0, 1])] * 9])) for k in range(300)], "v int, t long")
    values = lambda c: {"n": ("sum", F.lit(1)), "total": ("sum", F.col(c)), "least": ("min", F.col(c))}
    pairs = lambda met, c: sorted(map(tuple, met.groupBy("i").agg(F.count("*"), F.sum(c), F.min(c)).collect()))
    out = temporal.totals(points, a, "t", "a0", "a1", ["i"], values("v"))
    assert sorted(map(tuple, out.collect())) == pairs(temporal.period_join(points, a, "t", "a0", "a1"), "v")
    both = temporal.overlap_totals(a, b, ("a0", "a1"), ("b0", "b1"), ["i"], values("j"))
    assert sorted(map(tuple, both.collect())) == pairs(temporal.overlap_join(a, b, ("a0", "a1"), ("b0", "b1")), "j")
    assert temporal.totals(points.limit(0), a, "t", "a0", "a1", ["i"], values("v")).count() == 0
    assert temporal.overlap_totals(a, b.limit(0), ("a0", "a1"), ("b0", "b1"), ["i"], values("j")).count() == 0
