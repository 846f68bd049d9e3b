"""Literal expectations for rewriting, abstaining, reviews, steps, browsing, containment and the index."""

import pytest
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import answers, browse, chunking, evaluation, hierarchy, index, reports, retrieval, rewrite, steps


@pytest.mark.parametrize(
    "q, n, yes",
    [("那这个怎么办？", 1, True), ("然后呢？", 2, True), ("退款咋办？", 1, True), ("企业版退款期限是多少？", 1, False), ("那这个怎么办？", 0, False), ("  ", 3, False), (None, 3, False)],
)
def test_needs_rewrite(spark, q, n, yes):
    assert spark.createDataFrame([(q, n)], "q string, n int").select(rewrite.needs_rewrite(F.col("q"), F.col("n")).alias("x")).first().x is yes


@pytest.mark.parametrize(
    "raw, original, line",
    [
        ("```text\n企业版的退款期限是多少？\n```", "期限是多少？", "企业版的退款期限是多少？"), ("说明：补全主语\n改写后：企业版 的  退款期限是多少？", "那期限呢？", "企业版 的 退款期限是多少？"),
        ("“企业版退款期限是多少？”", "那个呢？", "企业版退款期限是多少？"), ("企业版退款期限是 30 天。", "期限是多少？", None), (" \n ", "x", None), ("长" * 201, "陈述", None), (None, "x", None),
    ],
)
def test_sanitized(spark, raw, original, line):
    assert spark.createDataFrame([(raw, original)], "r string, o string").select(rewrite.sanitized(F.col("r"), F.col("o")).alias("x")).first().x == line


def test_identifiers_join_by_slashes(spark):
    assert spark.range(1).select(text.keywords(F.lit("call user/list or HTTP-500")).alias("x")).first().x[:2] == ["user/list", "HTTP-500"]


def test_headings_and_tables(spark):
    text = "## C#\ntext | with a pipe\n\n| a | b |\n|---|---|\n| 1 | 2 |\nprose | after\n"
    b = chunking.block_rows(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("block_no").collect()
    assert [(x.kind, x.text) for x in b] == [("heading", "C#"), ("paragraph", "text | with a pipe"), ("table", "| a | b |\n|---|---|\n| 1 | 2 |"), ("paragraph", "prose | after")]


def test_abstain(spark):
    rows = [(False, ["k"], []), (False, ["k"], ["knowledge_retrieval"]), (False, ["k"], ["web_search"]), (True, ["k"], []), (False, [], []), (False, None, None)]
    df = spark.createDataFrame(rows, "s boolean, k array<string>, t array<string>")
    out = df.select(answers.should_abstain(F.col("s"), F.col("k"), F.col("t")).alias("a"), answers.needs_note(F.col("s"), F.col("k"), F.col("t")).alias("n")).collect()
    assert [(r.a, r.n) for r in out] == [(True, False), (True, False), (False, True), (False, False), (False, False), (False, False)]


def test_segments():
    cut = lambda t: [t[s["start"] : s["end"]] for s in steps.segments(t)]
    assert cut("first\nstill\n \t\n second ") == ["first\nstill", "second"]
    assert cut("1. a\n2、b\n3) c\n\nend") == ["1. a", "2、b", "3) c", "end"]
    assert cut("1. alone") == ["1. alone"] and cut("1. a\nb") == ["1. a\nb"] and cut(" \n\n ") == [] and steps.segments(None) == []


def test_steps(spark):
    rows = [("r", "s1", "start", 5), ("r", "s1", "finish", 3), ("r", "s1", "finish", 9), ("r", "s2", "start", 6), ("r", "s3", "finish", 7)]
    out = steps.collected(spark.createDataFrame(rows, "r string, step_id string, kind string, at_ms long"), "r").orderBy("step_id").collect()
    assert [(x.step_id, x.finished, x.cost_ms) for x in out] == [("s1", 9, 4), ("s2", None, None)]
    flat = lambda t: spark.createDataFrame([(t,)], "c string").select(steps.flattened(F.col("c")).alias("x")).first().x
    assert flat("plain") == "plain" and flat('["a", {"type": "text", "text": "b"}, {"type": "image"}]') == "ab" and flat(None) is None


def test_tokens(spark):
    rows = [("r", "m", 1, 5), ("r", "m", 2, 9), ("r", None, 3, 2), ("r", None, 4, 2), ("r", "n", 5, None)]
    assert answers.token_totals(spark.createDataFrame(rows, "r string, m string, at int, n int"), "r", "m", "at", "n").first().tokens == 9


def test_review(spark):
    lines = [*answers.sheet_head(), "| q1 | c | a \\| b |  |  |  |  |  |  | 通过 |  |", "| q2 |  |  |  |  |  |  |  |  | maybe |  |", "junk", "| q1 |  |  |  |  |  |  |  |  | 存疑 |  |", "| q3 |  |  |  |  |  |  |  |  | 不通过 |  |"]
    found = answers.parsed_sheet(spark.createDataFrame([*enumerate(lines)], "at int, line string"))
    assert {r.id: r.verdict for r in found.collect()} == {"q1": "存疑", "q3": "不通过"}
    s = answers.review_summary(found).first()
    assert (s.filled, s.passed, s.failed, s.unsure, s.pass_rate) == (2, 0, 1, 1, 0.0)
    assert answers.review_summary(found.limit(0)).first().pass_rate is None


def test_reports(spark, tmp_path):
    long = spark.createDataFrame([("a", "x", "mrr", 1.0), ("b", None, "mrr", 0.5), ("b", None, "hit@5", None)], "question_id string, category string, metric string, value double")
    report = reports.build("r1", long, {"top": "10"})
    reports.append(report, f"{tmp_path}/runs")
    reports.append(report, f"{tmp_path}/runs")
    back = reports.read(spark, f"{tmp_path}/runs", "r1")
    key = lambda r: (r.scope, str(r.category), r.metric, r.value)
    expected = [("category", "unknown", "_count", 1.0), ("category", "unknown", "mrr", 0.5), ("category", "x", "_count", 1.0), ("category", "x", "mrr", 1.0), ("overall", "None", "mrr", 0.75)]
    assert sorted(map(key, back.collect())) == sorted(map(key, reports.from_json(reports.to_json(report)).collect())) == expected
    assert reports.summary(report).split() == ["metric", "value", "mrr", "0.750"]
    changes = spark.createDataFrame([(f"q{k:02}", "added") for k in range(25)], "question_id string, change string")
    diff = evaluation.diff(long.limit(0).select("metric", "value"), long.where("question_id = 'a'").select("metric", "value"))
    assert "q19 …" in reports.diff_text(diff, changes) and "added (25)" in reports.diff_text(diff, changes)


def test_browse(spark):
    df = spark.createDataFrame([(1, "a_b", "key"), (2, "axb", ""), (3, "zz", None)], "id int, name string, secret string")
    assert [r.id for r in browse.listed(df, "a_b", ("name",)).collect()] == [1]
    assert [(r.id, r.has) for r in browse.masked(df, "secret", "has").orderBy("id").collect()] == [(1, True), (2, False), (3, False)]
    assert [r.id for r in browse.page(df, 2, 2, key="id").collect()] == [1]
    agents = spark.createDataFrame([(1, "running", "v1"), (2, "paused", "v1"), (3, "running", None), (4, "running", "v9")], "agent_id int, status string, current_version string")
    versions = spark.createDataFrame([(1, "v1", "old"), (1, "v2", "new"), (2, "v1", "c")], "agent_id int, version string, config string")
    assert {r.agent_id: (r.config, r.problem) for r in browse.published(agents, versions).collect()} == {1: ("old", None), 2: (None, "not running"), 3: (None, "not published"), 4: (None, "no snapshot")}
    existing = spark.createDataFrame([("a", "old", 0), ("b", "mine", 1)], "code string, name string, status int")
    wanted = spark.createDataFrame([("a", "new", 1), ("c", "fresh", 1)], "code string, name string, status int")
    assert sorted(tuple(r) for r in browse.seeded(existing, wanted).collect()) == [("a", "new", 0), ("b", "mine", 1), ("c", "fresh", 1)]


def test_tree_order(spark):
    tree = spark.createDataFrame([("1", None, "b", "menu"), ("2", None, "a", "menu"), ("3", "1", "z", "menu"), ("4", "1", "y", "button"), ("5", "lost", "c", "menu")], "id string, parent_id string, name string, type string")
    assert [r.id for r in hierarchy.ordered(tree).orderBy("pos").collect()] == ["2", "1", "4", "3", "5"]


def test_containment(spark):
    docs = [(1, "x one two  three four five y"), (2, "one two three four"), (3, "a one two  three four fivefold"), (4, None), (5, "")]
    items = [("p", "one two  three four five"), ("q", "three"), ("r", None), ("s", "wo  three four fiv")]
    out = retrieval.containment(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    true = {(d, i) for d, t in docs for i, s in items if t is not None and s is not None and s in t}
    assert sorted(tuple(r) for r in out) == sorted(true) and len(true) == 7


def test_index_lifecycle(spark):
    old = spark.createDataFrame([("d1", 1, "old1"), ("d2", 1, "old2"), ("d3", 1, "old3")], "document_id string, seq_no int, content string")
    drafts = spark.createDataFrame([("d1", [("new", None, None, "text"), ("more", None, None, "text")]), ("d2", [("lost", None, None, "text")])], "document_id string, drafts array<struct<content:string,section_path:string,page_no:int,chunk_type:string>>")
    documents = spark.createDataFrame([("d1", None), ("d2", "x" * 900)], "document_id string, error string")
    vectors = index.payload(drafts).select("id", F.array(F.lit(1.0)).alias("embedding"))
    fresh, done = index.rebuilt(old, documents, drafts, vectors)
    assert sorted((r.document_id, r.content) for r in fresh.collect()) == [("d1", "more"), ("d1", "new"), ("d2", "old2"), ("d3", "old3")]
    assert {r.document_id: (r.status, len(r.error or "")) for r in done.collect()} == {"d1": ("parsed", 0), "d2": ("failed", 500)}
    with pytest.raises(ValueError):
        index.points(index.payload(drafts), vectors.limit(1))
    assert index.delete(old, "document_id", "d1", "d3").count() == 1


def test_permissions_are_found_once_for_each_set_of_roles(spark):
    """Users with several, shared, disabled and unknown roles; the users are joined to codes, no pair of theirs is made distinct."""
    from orrery.operators import hierarchy

    own = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (3, "off"), (4, "none"), (5, None), (6, "a"), (6, "off"), (None, "a")], "user_id long, role_id string")
    roles = spark.createDataFrame([("a", 1), ("b", 1), ("off", 0)], "role_id string, status int")
    links = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x"), ("off", "z")], "role_id string, permission_id string")
    tree = spark.createDataFrame([("top", None, "t", 1), ("x", "top", "cx", 1), ("y", "top", "cy", 0), ("z", "top", "cz", 1)], "id string, parent_id string, code string, status int")
    out = hierarchy.effective(own, roles, links, tree)
    assert sorted(map(tuple, out.collect())) == [(1, "cx"), (1, "t"), (2, "cx"), (2, "t"), (6, "cx"), (6, "t")]
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top
