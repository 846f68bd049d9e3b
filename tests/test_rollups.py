"""Grouping sets, sketches, cycles and the answer run."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from orrery.config import RagConfig
from orrery.operators import answers, hierarchy, sketches, usage


@pytest.fixture(scope="module")
def facts(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(8000), date(2024, 1, 1 + r.randrange(14)), r.randrange(50), r.choice([None, r.expovariate(0.1)]), r.randrange(2)) for _ in range(60_000)]
    return spark.createDataFrame(rows, "agent string, user_id long, usage_date date, total_tokens long, total_cost double, status int").cache()


def test_sketches_stay_in_their_bounds(facts):
    got = sketches.estimates(sketches.rolled_up(sketches.sketched(facts, ["usage_date", "agent"]), ["agent"]), ["agent"], {"p50": 0.5, "p95": 0.95})
    rows = facts.select("agent", "user_id", "total_tokens", "total_cost").collect()
    for g in got.collect():
        own = [x for x in rows if x.agent == g.agent]
        users, costs = len({x.user_id for x in own}), sorted(x.total_cost for x in own if x.total_cost is not None)
        assert (g.calls, g.total_tokens) == (len(own), sum(x.total_tokens for x in own))
        assert abs(g.users - users) <= 4 * 1.04 / 64 * users
        for q, v in ((0.5, g.p50), (0.95, g.p95)):
            rank = sum(c <= v for c in costs) / len(costs)
            assert abs(rank - q) <= 0.03
    assert got.count() == 3


def test_sketches_are_merged_without_the_facts(spark, facts):
    keys = ["usage_date", "agent"]
    first, second = facts.where("user_id % 3 = 0"), facts.where("user_id % 3 <> 0")
    whole = sketches.estimates(sketches.sketched(facts, keys), keys, {"p50": 0.5})
    both = sketches.estimates(sketches.merged(sketches.sketched(first, keys), sketches.sketched(second, keys), keys), keys, {"p50": 0.5})
    pick = lambda df: {(r.usage_date, r.agent): r for r in df.collect()}
    whole, both = pick(whole), pick(both)
    assert whole.keys() == both.keys()
    for k, w in whole.items():
        assert (w.calls, w.total_tokens) == (both[k].calls, both[k].total_tokens) and abs(w.users - both[k].users) <= 0.05 * w.users
    none = sketches.sketched(spark.createDataFrame([("a", None, 1, None)], "agent string, user_id long, total_tokens long, total_cost double"), ["agent"])
    r = sketches.estimates(none, ["agent"], {"p50": 0.5}).first()
    assert (r.calls, r.users, r.p50) == (1, 0, None)


def test_sets_in_one_scan(facts):
    out = usage.summary_sets(facts, ["agent", "usage_date"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 1 and plan.count("InMemoryTableScan") <= 1 and plan.count("Exchange hashpartitioning") == 2
    by = {(r.set_id, r.agent, r.usage_date): r for r in out.collect()}
    total = by[(3, None, None)]
    assert total.calls == 60_000 and total.users == facts.select("user_id").distinct().count()
    assert (1, None, None) in by and by[(1, None, None)].calls == facts.where("agent is null").count()  # a null of the data
    assert sum(r.calls for (s, _, _), r in by.items() if s == 2) == 60_000 and len(by) == 1 + 3 + 14


def components(edges):
    """{node: component} of nodes that reach themselves."""
    reach = {a: {b for x, b in edges if x == a} for a in {n for e in edges for n in e}}
    while True:
        new = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
        if new == reach:
            break
        reach = new
    return {a: min(b for b in bs if a in reach[b]) for a, bs in reach.items() if a in bs}


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (8, None), (None, 1)],
        [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (6, 7), (7, 5), (9, 8)],  # cycles within cycles, and one that another leads to
        [(1, 2), (2, 3), (3, 4)], [(5, 5)], [],
    ],
)
def test_cycles(spark, edges):
    out = hierarchy.cycles(spark.createDataFrame(edges, "id int, parent_id int"))
    assert {r.id: r.cycle for r in out.collect()} == components([e for e in edges if None not in e])


def test_cycles_of_a_random_graph(spark):
    r = random.Random(2)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(48)]
    assert {x.id: x.cycle for x in hierarchy.cycles(spark.createDataFrame(edges, "id int, parent_id int")).collect()} == components(edges)


def test_answer_run(spark):
    kinds = "query_id int, category string, abstain_expected boolean, points array<string>, knowledge_ids array<string>, tools array<string>"
    questions = spark.createDataFrame([(1, "a", False, ["cat", "dog"], ["kb"], []), (2, "a", True, ["cat"], ["kb"], []), (3, "b", False, [], [], []), (4, None, False, ["x"], ["kb"], ["web"]), (5, "b", False, ["cat"], ["kb"], [])], kinds)
    supplied = spark.createDataFrame([(1, "A cat sat here all day [1].", 10), (2, "never shown", 20), (3, "free talk", 30), (4, "x [3]", 40)], "query_id int, answer string, latency_ms int")
    contents = spark.createDataFrame([(10, "the cat"), (11, "other")], "doc_id int, text string")
    asked = []

    def retrieve(bound):
        asked.extend(r.query_id for r in bound.collect())
        return spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.1), (2, 11, 1, 0.2), (4, 11, 1, 0.2), (5, 10, 1, 0.8)], "query_id int, doc_id int, rank int, rerank_score double")

    out = {r.query_id: r for r in answers.answer_run(questions, supplied, retrieve, contents, RagConfig(), "not known").collect()}
    assert sorted(asked) == [1, 2, 4, 5] and sorted(out) == [1, 2, 3, 4, 5]
    assert (out[1].correctness, out[1].supported, out[1].invalid, out[1].grounding.reason, out[1].grounding.hit_count) == (0.5, 1.0, [], "ok", 2)
    assert (out[2].answer, out[2].abstained, out[2].grounding.reason, out[2].grounding.source_count, out[2].abstain_pass) == ("not known", True, "low_relevance", 0, True)
    assert (out[3].abstained, out[3].correctness, out[3].grounding.hit_count) == (False, None, 0)
    assert (out[4].abstained, out[4].invalid) == (False, [3]) and out[5].answer == "" and out[5].latency_ms is None
    total = answers.rollup(spark.createDataFrame([*out.values()], answers.answer_run(questions, supplied, retrieve, contents).schema)).where(F.col("category").isNull()).first()
    assert total.abstain_accuracy == 1.0 and total.false_abstain_rate == 0.0


def test_positions_without_one_task(spark):
    from orrery.operators.lineage import positions

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    out = positions(df, "v")
    assert out.where("pos <> v + 1").count() == 0 and out.count() == 5000 and positions(df.limit(0), "v").count() == 0
