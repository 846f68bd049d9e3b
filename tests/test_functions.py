"""Literal expectations for functions and small operators."""

import json
import time
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orrery.functions import measures, text
from orrery.operators import chunking, evaluation, grounding, hierarchy, index, retrieval, usage
from orrery.sources import files


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "t, check",
    [
        ("ERR_4012 是什么错误", lambda x: x[0] == "ERR_4012" and "ERR" not in x and "4012" not in x and "错误" in x),
        ("v1.2.3 版本的 get_user_info 接口怎么调用", lambda x: {"v1.2.3", "get_user_info"} <= {*x} and not {"get", "user"} & {*x}),
        ("员工迟到超过30分钟怎么处理", lambda x: x[0] == "30"),
        ("", lambda x: x == []), ("？？！", lambda x: x == []), ("好", lambda x: x == []), (None, lambda x: x == []),
        ("Foo foo FOO bar", lambda x: x == ["Foo", "bar"]),
    ],
)
def test_keywords(spark, t, check):
    assert check(one(spark, text.keywords(F.col("t"), 20), t=t))
    assert one(spark, text.keywords(F.col("t"), 0), t=t) == []


def test_keywords_of_long_texts(spark):
    """A text is read a few times, not once for each of its words."""
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}x" for k in range(600)]
    t = " ".join(words * 8)
    began = time.perf_counter()
    assert one(spark, text.keywords(F.col("t")), t=t) == words[:8]
    assert time.perf_counter() - began < 10
    assert one(spark, text.keywords(F.col("t"), 700), t=t.upper()) == [w.upper() for w in words]


def test_like_and_scalars(spark):
    assert [text.like_escaped(s) for s in ("ERR_4012", "100%", "a\\b")] == ["%ERR\\_4012%", "%100\\%%", "%a\\\\b%"]
    assert one(spark, text.paragraphs(F.col("t")), t="第一段。\r\n\r\n第二段。\n \n\n") == ["第一段。", "第二段。"]
    assert one(spark, text.extension(F.col("t")), t="/a.b/C.TXT") == "txt" and one(spark, text.extension(F.col("t")), t="/a.b/c") == ""
    ns = uuid.UUID(index.NAMESPACE)
    for name in ("kbchunk:ab:1", "kbchunk:zz:77", "é"):
        assert one(spark, text.uuid5(index.NAMESPACE, F.col("t")), t=name) == uuid.uuid5(ns, name).hex
    assert str(one(spark, measures.cost(F.lit(1), F.lit(0), F.lit("0.0005"), F.lit(None)), t="")) == "0.000001"  # half goes up
    assert one(spark, measures.percent_change(F.lit(3), F.lit(0)), t="") is None
    assert str(one(spark, measures.business_date(F.lit(datetime(2024, 1, 1, 16)).cast("timestamp_ntz")), t="")) == "2024-01-02"


def test_ranges_and_limits(spark):
    with pytest.raises(ValueError):
        usage.resolve_range(datetime(2024, 1, 2), datetime(2024, 1, 2))
    with pytest.raises(ValueError):
        usage.resolve_range(datetime(2022, 1, 1), datetime(2024, 1, 2))
    with pytest.raises(ValueError):
        usage.summary(None, ["a"], 101)
    with pytest.raises(ValueError):
        usage.daily_trend(None, "hour")


def test_fusion(spark):
    a = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8)], "query_id int, doc_id string, rank int, score double")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, None, 3)], "query_id int, doc_id string, rank int")
    rows = retrieval.rrf([(a, "vector", 1.0), (b, "keyword", 1.0)]).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["b", "a", "c"] and rows[0].score == 0.8 and rows[0].retrievers == "keyword,vector" and rows[2].score is None
    rows = retrieval.rrf([(a.where("doc_id = 'a'"), "vector", 0.1), (b.where("doc_id = 'b'"), "keyword", 10.0)]).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["b", "a"]


def test_rerank_sanitising(spark):
    items = [(0, 0.9), (7, 0.5), (0, 0.8), ("x", 0.5), ("1", 0.5), (True, 0.5), (1, "junk"), (1, True), (2, 0.1), (2, 0.7), (1.0, 0.9), (None, 0.9)]
    body = [{"index": i, "relevance_score": s} for i, s in items] + ["text", 3, None, {"index": 1}]
    rows = [(1, json.dumps({"results": body})), (2, json.dumps({"output": {"results": body}})), (3, "no json"), (4, None), (5, json.dumps({"results": "x"})), (6, json.dumps({"results": [{"index": 1, "relevance_score": 1}]}))]
    found = retrieval.parsed_results(spark.createDataFrame(rows, "query_id int, body string"))
    out = retrieval.sanitized(found, F.lit(3), 0.3).collect()
    assert sorted((r.query_id, r["index"], r.rerank_score) for r in out) == [(1, 0, 0.9), (2, 0, 0.9), (6, 1, 1.0)]


def test_grounding(spark):
    q = spark.createDataFrame([(k,) for k in range(4)], "query_id int")
    hits = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.35), (3, None)], "query_id int, rerank_score double")
    assert {r.query_id: (r.reason, r.sufficient) for r in grounding.assess(q, hits).collect()} == {0: ("no_hits", False), 1: ("low_relevance", False), 2: ("ok", True), 3: ("no_score", True)}
    sources = F.array(F.lit(1))
    a = one(spark, grounding.audit(F.col("t"), sources), t="试用期为 60 天 [1]，另有隐藏条款 [9]。")
    assert (a.cited, a.invalid) == ([1, 9], [9])
    assert one(spark, grounding.cited(F.col("t")), t="[1][1] x [0] y [1234]") == [0, 1]
    assert one(spark, grounding.audit(F.col("t"), sources), t="这是一个没有任何引用标记的很长的句子。").uncited_claims == 1
    assert [one(spark, grounding.is_refusal(F.col("t"), "no idea"), t=t) for t in ("no idea", "现有资料不足，无法回答", "a fact", " ")] == [True, True, False, False]


def test_timeline(spark):
    steps = spark.createDataFrame([("m", "a", 5), ("m", "b", 99)], "message_id string, step_id string, at int")
    thoughts = spark.createDataFrame([("m", 0, 10), ("m", 12, 20)], "message_id string, start int, end int")
    rows = grounding.timeline(steps, thoughts).orderBy("pos").collect()
    assert [(r.at, r.end, r.step_id) for r in rows] == [(0, 5, None), (5, None, "a"), (5, 10, None), (12, 20, None), (20, None, "b")]


def test_evaluation(spark):
    q = spark.createDataFrame([(1, ["alpha", "beta"]), (2, []), (3, ["none"])], "question_id int, evidence array<string>")
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "the alpha"), (3, 1, "x")], "question_id int, rank int, content string")
    out = {r.question_id: r for r in evaluation.retrieval_scores(q, hits, [1, 5]).collect()}
    assert out[1]["hit@1"] == 0 and out[1]["hit@5"] == 1 and out[1]["evidence_recall@5"] == 0.5 and abs(out[1].mrr - 1 / 3) < 1e-12
    assert out[2].mrr is None and out[2]["evidence_recall@5"] == 1 and out[3].mrr == 0
    before = spark.createDataFrame([("hit@5", 0.8), ("answers.uncited_claims_total", 4.0), ("mrr", 0.5), ("same", 1.0)], "metric string, value double")
    after = spark.createDataFrame([("hit@5", 0.9), ("answers.uncited_claims_total", 1.0), ("new", 0.5), ("same", 1.0 + 1e-12)], "metric string, value double")
    assert {r.metric: r.direction for r in evaluation.diff(before, after).collect()} == {"hit@5": "improved", "answers.uncited_claims_total": "improved", "mrr": "removed", "new": "added", "same": "unchanged"}


def test_hierarchy_cycles(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    up = hierarchy.ancestors(tree, spark.createDataFrame([("c",), ("x",), ("lost",)], "id string")).collect()
    assert {(r.root, r.id) for r in up} == {("c", "c"), ("c", "b"), ("c", "a"), ("x", "x"), ("x", "y"), ("lost", "lost")}
    down = hierarchy.descendants(tree, spark.createDataFrame([("a",)], "id string")).collect()
    assert {r.id for r in down} == {"a", "b", "c"}


MANUAL = """# Handbook

Intro text.

## One

- item
  more
- item

## Two

| a | b |
|---|---|
| 1 | 2 |

```python
# x
| not | a table |
```
"""


def test_markdown(spark):
    docs = spark.createDataFrame([("d1", MANUAL), ("d2", None)], "document_id string, text string")
    kinds = [(b.kind, b.level) for b in chunking.block_rows(docs).orderBy("block_no").collect()]
    assert kinds == [("heading", 1), ("paragraph", None), ("heading", 2), ("list", None), ("heading", 2), ("table", None), ("code", None)]
    df = chunking.drafts(docs)
    assert {r.document_id: len(r.drafts) for r in df.collect()} == {"d1": 3, "d2": 0}
    rows = index.payload(df.select("document_id", "drafts")).orderBy("document_id", "seq_no").collect()
    assert [(r.seq_no, r.section_path) for r in rows] == [(1, "Handbook"), (2, "Handbook > One"), (3, "Handbook > Two")]
    assert rows[0].content.startswith("Handbook") and rows[2].chunk_type == "mixed" and rows[1].embedding_text.startswith("Handbook > One\nOne")
    assert all(r.char_count == len(r.content) for r in rows)


def test_splitting(spark):
    pieces = chunking.split_text("这是一句话。" * 60, 80, 20)
    assert all(len(p) <= 80 for p in pieces) and len(pieces) > 4
    table = "| h | k |\n|---|---|\n" + "\n".join(f"| row{k} | x |" for k in range(20))
    parts = spark.range(1).select(chunking.table_pieces(F.lit(table), 60).alias("x")).first().x
    assert all(p.startswith("| h | k |\n|---|---|\n") for p in parts)
    assert [r for p in parts for r in p.split("\n")[2:]] == table.split("\n")[2:]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("x\r\ny\xff".encode("latin-1"))
    (tmp_path / "b.exe").write_bytes(b"z")
    (tmp_path / "c.txt").write_bytes(b"")
    good, bad = files.read_documents(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["x\ny�"]
    assert {r.reason for r in bad.collect()} == {"unsupported", "empty"}


def test_golden(spark):
    toml = '[[datasets]]\nname = "d"\n[[datasets.questions]]\nid = "q1"\ncategory = "simple_fact"\nquestion = "?"\nexpected_evidence = ["e"]\n'
    assert files.read_golden(spark, toml).count() == 1
    with pytest.raises(ValueError, match="q1: missing evidence"):
        files.read_golden(spark, toml.replace('expected_evidence = ["e"]', ""))


def test_dimension(spark):
    ok = spark.createDataFrame([([1.0, 2.0],), ([1.0, 3.0],)], "embedding array<double>")
    assert index.check_dimension(ok) == 2
    with pytest.raises(ValueError):
        index.check_dimension(ok.unionAll(spark.createDataFrame([([1.0],)], "embedding array<double>")))
