import numpy as np
from pyspark.sql import functions as F

from orrery.llm import neighbours, queries

KINDS = "vec_id long, embedding array<double>"


def exact(rows, asked, k=5):
    """{query: [(id, score)]} by comparing all."""
    ids = np.array([r for r, _ in rows])
    v = np.array([v for _, v in rows], dtype=float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero([asked(i) for i in ids]):
        s = u @ u[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, true):
    assert set(got) == set(true) and all(len(got[q]) == len(true[q]) for q in true)
    for q, best in got.items():
        assert [s for _, s in best] == sorted((s for _, s in best), reverse=True) and q not in [i for i, _ in best]
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in true[q]}) / len(true[q]) for q in true])


def spread(n, width=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, width))
    return [(k, (centres[k % 40] * (k % 3 > 0) + rng.standard_normal(width) * rng.choice([0.2, 0.6, 1.0])).tolist()) for k in range(n)]


def test_recall_over_many_cells(spark, monkeypatch):
    """Small blocks, so that the upper tree has cells, crowded ones have several blocks, and queries several groups."""
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    rows = spread(6000)
    got = found(neighbours.nearest(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 50 == 0))
    true = exact(rows, lambda i: i % 50 == 0)
    assert recall(got, true) >= 0.95
    for q, best in got.items():  # scores are exact
        v = dict(rows)
        assert all(abs(s - np.dot(v[q], v[i]) / np.linalg.norm(v[q]) / np.linalg.norm(v[i])) < 1e-12 for i, s in best)


def test_search_stops_early():
    """Of vectors in tight groups the test verifies a small share."""
    rows = spread(4000)
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    block = neighbours.Block(np.arange(4000), u, neighbours._projection(32))
    tight = [k for k in range(4000) if k % 3 > 0][:60]
    for q in tight:
        block.nearest(q, u[q], u[q] @ neighbours._projection(32), 4.0, 5, neighbours.reach())
    assert block.verified < 0.5 * 60 * 4000
    assert abs(neighbours.chi_square(neighbours.reach(0.9)) - 0.9) < 1e-9 and abs(neighbours.chi_square(15.507) - 0.95) < 1e-4


def test_copies_ties_and_few(spark):
    same, near = [1.0, 2.0, 2.0], [1.0, 2.0, 2.1]
    rows = [(k, same) for k in range(300)] + [(1000, near), (1001, [3.0, 0.0, 0.0])]
    got = found(neighbours.nearest(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 50 == 0))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4] and [i for i, _ in got[1000]] == [0, 1, 2, 3, 4]
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]
    assert found(neighbours.nearest(spark.createDataFrame(few, KINDS), F.col("vec_id") == 0)) == {0: [(1, 0.0), (2, -1.0)]}
    assert found(neighbours.nearest(spark.createDataFrame(few[:1], KINDS), F.col("vec_id") == 0)) == {}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1e300, 1e300]), (7, [1.0, 1.5]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(k, v, 1, "c") for k, v in rows], KINDS + ", rank int, node string")
    got = found(neighbours.nearest(df, F.lit(True)))
    assert {q: [i for i, _ in best] for q, best in got.items()} == {6: [8, 7], 7: [6, 8], 8: [6, 7]}
    assert abs(got[6][0][1] - 1) < 1e-12
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and any(r.embedding) and np.isfinite(np.array(r.embedding, dtype=float)).all()]
    out = queries.op13_neighbours(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert recall(found(out), exact(rows, lambda i: i % 50 == 0)) >= 0.95
