import numpy as np

from orrery.llm import embeddings


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    rows = [c + rng.standard_normal(24) * s for c in centres for s in rng.choice([0.01, 0.1, 0.16, 0.5], 20)]
    rows = np.concatenate([rows, rows[:7], rng.standard_normal((100, 24))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in embeddings.near_groups(df).collect()}
    u = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    best = np.arange(len(rows))
    while True:
        new = np.array([min(best[k], best[near[k]].min(initial=len(rows))) for k in range(len(rows))])
        if (new == best).all():
            break
        best = new
    links = np.array([out[k].n_links for k in range(len(rows))])
    assert links.sum() >= 0.98 * near.sum() and (links <= near.sum(1)).all()
    assert np.mean([out[k].component_id == best[k] for k in range(len(rows))]) >= 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1e300, 1e300]), (8, [1.0, 1.0]), (9, [2.0, 2.0]), (10, [1.0]), (9, [2.0, 2.0]), (None, [1.0, 1.0])]
    out = {r.vec_id: r for r in embeddings.near_groups(spark.createDataFrame([(k, v, "c") for k, v in rows], "vec_id long, embedding array<double>, component_id string")).collect()}
    assert sorted(out) == list(range(1, 11))
    assert [out[k].n_links for k in range(1, 11)] == [0] * 6 + [2, 2, 2, 0]
    assert out[9].component_id == 7 and out[1].kept and not out[8].kept
    assert embeddings.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_dense_groups_joined_by_far_pairs(spark):
    """Every member has more closer neighbours than a list holds; the links between the groups count all the same."""
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    b = 0.966 * a + np.sqrt(1 - 0.966**2) * b
    rows = np.concatenate([c + 0.1 / np.sqrt(32) * rng.standard_normal((150, 32)) for c in (a, b)])
    u = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    inner, cross = [np.sort((u @ u.T)[k, lo : lo + 150])[::-1] for k in range(300) for lo in [150 * (k // 150)]], (u @ u.T)[:150, 150:]
    assert all(x[49] > c for x, c in zip(inner, [*cross.max(1), *cross.max(0)])) and near[:150, 150:].sum() > 5000
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in embeddings.near_groups(df).collect()}
    assert [out[k].n_links for k in range(300)] == near.sum(1).tolist()
    assert {r.component_id for r in out.values()} == {0}


def test_rare_links_among_many_vectors(spark):
    """Pairs just over the threshold, far from all else, are found whatever the number of vectors."""
    import math

    rng = np.random.default_rng(11)
    v = rng.standard_normal((20_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.standard_normal((200, 64))
    w -= (w * v[:200]).sum(1, keepdims=True) * v[:200]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    near = 0.952 * v[:200] + math.sqrt(1 - 0.952**2) * w
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate([v, near]))]
    out = {r.vec_id: r for r in embeddings.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(out[k].n_links == 1 and out[20_000 + k].component_id == k for k in range(200))
    print("pairs found:", found)
    assert found >= 190 and sum(r.n_links for r in out.values()) == 2 * found
    assert embeddings.orders_for(10**9) > embeddings.orders_for(50_000) >= 6
