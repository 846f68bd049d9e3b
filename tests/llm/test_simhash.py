import random

from xxhash import xxh64_intdigest

from orrery.llm import simhash
from orrery.llm.components import components


def plain(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x, 42) for x in sh]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def brute(prints):
    best = {k: k for k in prints}
    while True:
        new = {a: min(best[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3) for a in prints}
        if new == best:
            return best
        best = new


def test_groups(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(60)) for _ in range(12)]
    texts = {}
    for k in range(150):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(["xx", "yy"])
        texts[k] = " ".join(w)
    out = {x.doc_id: x for x in simhash.near_groups(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    prints = {k: plain(t) for k, t in texts.items()}
    assert {k: int(x.fingerprint, 16) for k, x in out.items()} == prints
    assert {k: x.component_id for k, x in out.items()} == brute(prints)


def test_links_of_random_values_lose_none(spark):
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in values[:40]:
        for n in range(1, 6):
            x = v
            for b in r.sample(range(64), n):
                x ^= 1 << b
            values.append(x)
    nodes = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "node long, value long")
    found = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    expected = brute(dict(enumerate(values)))
    assert {k: found.get(k, k) for k in expected} == expected


def test_pivots_discard_pairs_before_they_are_compared():
    import numpy as np

    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = values[:100] ^ np.uint64(0b101)
    values, refs = np.concatenate([values, near]), np.random.default_rng(64).integers(0, 1 << 64, simhash.PIVOTS, dtype=np.uint64, endpoint=False)
    tally = [0, 0, 0]
    found = simhash._forest(np.arange(500), values, 3, refs, tally)
    assert len(found) == tally[2] == 100
    assert tally[0] < 0.7 * 500 * 499 / 2 and tally[1] < 0.01 * tally[0]


def test_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (7, 6)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in range(201)} == {0} and {found[k] for k in range(1000, 1100)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    out = simhash.near_groups(odd("fingerprint", "component_id")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and by[1].fingerprint == "0" * 16 and by[2].component_id == by[6].component_id == 1
    assert by[4].component_id == 3 and by[None].component_id is None
    assert simhash.near_groups(none).count() == 0


def test_pivots_discard_before_near_copies_are_compared():
    """The links of a band of near copies and unrelated texts are those of comparing all; most pairs that aren't near go by the table."""
    import numpy as np

    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    rows = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 63, base.shape, dtype=np.uint64)) for _ in range(15)])
    tally = [0, 0]
    found = simhash._near(np.arange(len(rows)), rows[:, 0], rows[:, 1], tally)
    assert len(found) == len(rows) - 12 and all(i % 12 == j % 12 and d <= simhash.WITHIN for i, j, d in found)
    assert tally[1] < 0.2 * tally[0]
