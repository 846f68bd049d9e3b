"""Queries on tables that hold what only larger or unusual ones do."""

import duckdb
import pytest

from orrery.plans import catalog


@pytest.fixture
def compared(spark, tmp_path):
    """compared(name, **tables): the query's rows and its SQL's, over tables given as SQL for DuckDB, in the order of their columns' names."""

    def run(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            c.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        names = ", ".join(sorted(df.columns))
        plain = lambda rows: sorted([f"{v:.9g}" if isinstance(v, float) else str(v) for v in r] for r in rows)
        return plain(df.select(*sorted(df.columns)).collect()), plain(c.execute(f"select {names} from ({catalog.oracle_sql()[name]})").fetchall())

    return run


def test_missing_vectors_where_ids_pass_a_hundred_thousand(compared):
    """Documents 14 and 28 name vectors that nobody has, though the vectors 100014 and 100028 exist."""
    out, expected = compared(
        "j9_missing_by_document", documents="select i::bigint as doc_id, 'src' || (i % 3) as source from range(60) t(i)", embeddings="select i::bigint as vec_id from range(50000, 50030) t(i)"
    )
    assert out == expected and len(out) == 3


def test_budget_sees_only_documents_that_may_fit(spark, compared, monkeypatch):
    """Of 400 long documents, copies and ties among them, a few reach the budget's table function; the rows stay the SQL's."""
    from orrery.plans import retrieval as plans

    seen, within = [], plans._within
    monkeypatch.setattr(plans, "_within", lambda *a: (seen.append(out := within(*a)), out)[1])
    text = "case when i % 50 = 3 then null when i % 50 = 4 then '' when i % 4 = 2 then repeat('x', 70000) else repeat('y', (7000 + 500 * (i % 3))::int) end"
    out, expected = compared("u9_context_budget", documents=f"select i::bigint as doc_id, {text} as text, 'l' || (i % 4) as lang from range(400) t(i)")
    assert out == expected and len(out) > 20
    assert seen[0].count() < 60


def test_all_scores_in_blocks(spark, compared, monkeypatch):
    """Queries and vectors that meet in several blocks, null and zero vectors and repeated ids among them; before, a zero vector failed the query and each pair was a row of two vectors."""
    from orrery.operators import retrieval

    for name, n in (("VECTORS", 100), ("QUERIES", 3), ("AT_ONCE", 32), ("TOLD", 2)):
        monkeypatch.setattr(retrieval, name, n)
    vector = "case when i % 60 = 7 then null when i in (50, 61) then [0.0, 0.0, 0.0] else [sin(i * i), cos(i * 3), sin(i + 2)] end"
    out, expected = compared("r5_vector_scan", embeddings=f"select (i % 350)::bigint as vec_id, ({vector})::float[] as embedding from range(353) t(i)", documents="select i::bigint as doc_id from range(340) t(i)")
    assert out == expected and len(out) > 2000
    assert "NestedLoop" not in retrieval.scores(spark.range(60).selectExpr("id query_id", "array(id, 1) q"), spark.range(9).selectExpr("id doc_id", "array(id, 1) embedding"))._jdf.queryExecution().toString()


def test_scores_of_uneven_vectors(spark):
    from orrery.operators import retrieval

    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0]), (3, [4.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    out = {(r.query_id, r.doc_id): r.score for r in retrieval.scores(df.where("doc_id < 7").selectExpr("doc_id query_id", "embedding q"), df).collect()}
    assert len(out) == 7 * 9 - 7 and {k for k, v in out.items() if v is not None and v == v} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert out[0, 1] == 0.707107 and out[2, 3] == 1.0 and out[0, 7] != out[0, 7] and out[0, 8] is None
