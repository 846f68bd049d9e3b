"""What plugs in from outside, and conversations as the next turn sees them."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import contracts, conversations, hierarchy, index, retrieval

HITS = "query_id int, doc_id string, rank int, score double"


def test_a_retriever_from_outside_takes_part(spark):
    queries = spark.createDataFrame([(1, "cat")], "query_id int, q string")
    known = contracts.Retrievers()
    known.add("vector", 1.0)(lambda q: q.select("query_id", F.lit("a").alias("doc_id"), F.lit(1).alias("rank"), F.lit(0.9).alias("score")))

    @known.add("own", weight=10.0, optional=True)
    def own(q):
        return q.select("query_id", F.concat(F.lit("doc of "), "q").alias("doc_id"), F.lit(1).alias("rank"))

    out = known.search(queries).orderBy("rank").collect()
    assert [(r.doc_id, r.retrievers) for r in out] == [("doc of cat", "own"), ("a", "vector")]
    assert [r.doc_id for r in known.search(queries, names=["vector"]).collect()] == ["a"]
    known.add("broken", optional=True)(lambda q: q.select("query_id", F.raise_error(F.lit("down")).cast("string").alias("doc_id"), F.lit(1).alias("rank")))
    assert known.search(queries).count() == 2
    known.add("needed")(lambda q: q.select("nothing of the kind"))
    with pytest.raises(Exception, match="nothing of the kind"):
        known.search(queries)
    with pytest.raises(ValueError):
        known.add("own")(own)
    with pytest.raises(ValueError):
        contracts.Retrievers().search(queries)


def test_reranking_by_any_column(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.4), (1, "c", 3, None), (2, "d", 1, 0.1)], HITS)
    out = contracts.reranked(hits, lambda h: h["score"] * h["rank"], 5, 0.3).orderBy("query_id", "new_rank").collect()
    assert [(r.doc_id, r["rank"], r.new_rank, round(r.rerank_score, 3)) for r in out] == [("b", 2, 1, 0.8), ("a", 1, 2, 0.5)]


def test_five_outcomes_of_rewriting(spark):
    queries = [(1, "那这个怎么办？", 1), (2, "那这个怎么办？", 0), (3, " ", 2), (4, "企业版退款期限是多少？", 1), (5, "那期限呢？", 1), (6, "那期限呢？", 1), (7, None, 1)]
    proposals = spark.createDataFrame([(1, "改写后：退款怎么办？"), (2, "x？"), (5, "说明：无"), (4, "y？")], "query_id int, raw string")
    q = spark.createDataFrame(queries, "query_id int, query string, n_history int")
    out = {r.query_id: (r.rewritten_query, r.rewritten, r.source) for r in contracts.rewritten(q, proposals).collect()}
    assert out[1] == ("退款怎么办？", True, "MODEL") and out[2][2] == out[3][2] == out[7][2] == "NO_CONTEXT" and out[4] == (queries[3][1], False, "NOT_NEEDED")
    assert out[5] == out[6] == ("那期限呢？", False, "FAILURE")
    same = spark.createDataFrame([(1, "那这个怎么办")], "query_id int, raw string")
    assert contracts.rewritten(q.where("query_id = 1"), same).first().source == "NOT_NEEDED"
    assert {r.source for r in contracts.rewritten(q, proposals, enabled=False).collect()} == {"DISABLED"} and contracts.rewritten(q.where("query_id = 1"), None).first().source == "FAILURE"


def test_table_functions(spark):
    contracts.register(spark)
    spark.createDataFrame([(1, "call user/list or HTTP-500 退款期限 x 42"), (2, None), (3, "a")], "id int, q string").createOrReplaceTempView("qs")
    out = spark.sql("select id, t.* from qs, lateral query_terms(q, 9) t order by id, pos").collect()
    assert [(r.id, r.term) for r in out] == [(1, t) for t in ("user/list", "HTTP-500", "call", "or", "42", "退款", "款期", "期限")]
    rows = [(1, k, "x" * n, k) for k, n in enumerate((50, 30, 30, 5))] + [(2, 9, "y" * 500, 1), (2, 8, "z", 2)]
    spark.createDataFrame(rows, "query_id long, doc_id long, text string, rank int").createOrReplaceTempView("hs")
    out = spark.sql("select * from within_budget(100, table(hs) partition by query_id order by rank) order by query_id, n").collect()
    assert [tuple(r) for r in out] == [(1, 0, 1, 50), (1, 1, 2, 80), (2, 9, 1, 500)]


def test_history(spark):
    rows = [("c", k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(7)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted(r.turn for r in conversations.history(df, 2).collect()) == [3, 4, 5, 6] and conversations.history(df, 0).count() == 7
    before = {r.turn: [h.content for h in r.history] for r in conversations.history_before(df, 1).collect()}
    assert before[0] == [] and before[1] == ["t0"] and before[6] == ["t4", "t5"]
    assert len(conversations.history_before(df, 0).where("turn = 6").first().history) == 6
    assert conversations.history_text(df.limit(2)).first().history == "用户: t0\n助手: t1"


def test_reasoning_keys(spark):
    rows = ['{"reasoning_content": "", "reasoning": "b", "thinking": "d"}', '{"thinking": "d"}', "{}", None, '{"reasoning_content": "a"}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, j string")
    assert [r.x for r in df.select("k", conversations.reasoning_of(F.col("j")).alias("x")).orderBy("k").collect()] == ["b", "d", None, None, "a"]


def test_timelines(spark):
    kinds = "message_id int, role string, reasoning string, steps array<struct<step_id:string,kind:string,reasoning_offset:int>>"
    rows = [(1, "assistant", "first\n\nsecond part", [("s1", "retrieval", 0), ("s2", None, 9), ("s3", "tool", 999)]), (2, "assistant", None, [("s4", "tool", 5)]), (3, "assistant", "only thought", None), (4, "user", "not shown", None), (5, "assistant", None, None)]
    out = conversations.timelines(spark.createDataFrame(rows, kinds)).orderBy("message_id", "pos").collect()
    assert [(r.message_id, r.step_id, r.kind, r.start, r.end) for r in out] == [
        (1, "s1", "retrieval", None, None), (1, "reasoning-0", "thinking", 0, 5), (1, "reasoning-7", "thinking", 7, 9), (1, "s2", "tool", None, None), (1, "reasoning-9", "thinking", 9, 18), (1, "s3", "tool", None, None),
        (2, "s4", "tool", None, None), (3, "reasoning-0", "thinking", 0, 12),
    ]


def test_sources_have_all_fields(spark):
    hits = spark.createDataFrame([(1, 1, "k1", "d1", None, "kb", 3, 0.5, "x" * 300)], "query_id int, rank int, chunk_id string, document_id string, document_name string, knowledge_base_id string, seq_no int, score double, content string")
    r = retrieval.sources(hits, 4).first()
    assert (r["index"], r.type, r.chunk_id, r.document_name, r.knowledge_base_id, r.knowledge_base_name, r.seq_no, r.score, r.file_id, len(r.content)) == (5, "knowledge", "k1", "", "kb", "", 3, 0.5, None, 200)


def test_permission_and_replacement(spark):
    users = spark.createDataFrame([(1, True), (2, False), (3, None), (4, False)], "user_id int, is_superuser boolean")
    codes = spark.createDataFrame([(2, "a"), (2, "b"), (3, "b"), (4, "z")], "user_id int, code string")
    assert sorted(r.user_id for r in hierarchy.allowed(users, codes, ["a", "b"]).collect()) == [1, 2, 3]
    old = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3), (None, 4)], "document_id string, v int")
    fresh = spark.createDataFrame([("d1", 9), ("d3", 8)], "document_id string, v int")
    assert sorted(r.v for r in index.replace(old, fresh).collect()) == [3, 4, 8, 9]
    assert sorted(r.v for r in index.replace(index.replace(old, fresh), fresh).collect()) == [3, 4, 8, 9]
