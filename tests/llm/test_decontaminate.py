import random

import numpy as np

from orrery.llm import decontaminate as d


def vary(r, words, n):
    w = list(words)
    for _ in range(n):
        k, how = r.randrange(len(w) + 1), r.randrange(3)
        if how == 0:
            w.insert(k, f"n{r.randrange(99)}")
        elif k < len(w):
            w[k : k + 1] = [f"n{r.randrange(99)}"] if how == 1 else []
    return w


def test_edits_within():
    r = random.Random(1)
    for _ in range(200):
        item = [r.randrange(5) for _ in range(r.randint(1, 9))]
        words = [r.randrange(5) for _ in range(r.randint(0, 12))]

        def edit(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        best = min(edit(item, words[a:b]) for a in range(len(words) + 1) for b in range(a, len(words) + 1))
        assert d.edits_within(np.array(item), np.array(words, int)) == best


def test_recall_and_precision(spark):
    r = random.Random(6)
    items = [(k, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(3, 60)))) for k in range(60)]
    docs, true = [], {}
    for k in range(400):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randint(0, 120))]
        if k % 2:
            i, t = r.choice(items)
            t = t.split()
            n = int(0.15 * len(t)) if len(t) >= d.SHORT else 0
            at = r.randint(0, len(w))
            w[at:at] = vary(r, t, n)
            true[k] = i
        docs.append((k, " ".join(w)))
    out = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in out}
    assert len(found & set(true.items())) >= 0.9 * len(true)
    assert {a for a, _ in found} <= set(true)
    exact = {(k, i) for k, t in docs for i, s in items if f" {s} " in f" {t} "}
    assert exact <= found


def test_recall_at_the_limit():
    """Items of every length with as many edits as are allowed, spread or crowded into one half."""
    r = random.Random(7)
    for lo, hi in ((1, 4), (5, 7), (8, 11), (12, 15), (16, 31), (32, 63), (64, 127), (128, 200)):
        items = [[f"w{r.randrange(3000)}" for _ in range(r.randint(lo, hi))] for _ in range(120)]
        block = d.Block([(k, d.word_hashes(" ".join(t))) for k, t in enumerate(items)])
        for crowded in (None, 0, 1):
            found = 0
            for k, t in enumerate(items):
                cut = len(t) // 2
                n = d.allowed(len(t))
                near = vary(r, t, n) if crowded is None else vary(r, t[:cut], n) + t[cut:] if crowded == 0 else t[:cut] + vary(r, t[cut:], n)
                w = [f"w{r.randrange(3000)}" for _ in range(40)]
                w[20:20] = near
                found += any(m[0] == k for m in block.matches(["", " ".join(w), None])[1])
            assert found >= 0.95 * len(items), (lo, hi, crowded, found)


def test_long_items_are_planned_at_once():
    """Items of thousands of words go by pieces; edits may be spread, or crowd into all pieces but one."""
    import time

    r = random.Random(9)
    items = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in (93, 200, 500, 1000, 2000, 10_000)]
    d.walks_of.cache_clear()
    began = time.perf_counter()
    block = d.Block([(k, d.word_hashes(" ".join(t))) for k, t in enumerate(items)])
    assert time.perf_counter() - began < 10  # 2 s where nothing else runs
    for k, t in enumerate(items[:5]):
        n = d.allowed(len(t))
        for near in (t, vary(r, t, n), vary(r, t[: len(t) // 2], n) + t[len(t) // 2 :]):
            text = " ".join([f"x{r.randrange(99)}" for _ in range(300)] + near + ["y"] * 50)
            assert [m[0] for m in block.matches([text])[0]] == [k]
        assert block.matches([" ".join(t[: len(t) // 2])])[0] == []
    assert [m[:2] for m in block.matches([" ".join(items[5])])[0]] == [(5, 0)]


def test_an_unmet_target_fails():
    import pytest

    with pytest.raises(ValueError, match="walks find"):
        d.Block([(1, d.word_hashes("a b c d e f g h i j"))], target=1.01)


def test_starts_that_are_left_out_hold_nothing():
    """Every window within the limit has enough of its item's runs, whatever the edits."""
    r = random.Random(8)
    for _ in range(2000):
        n = r.randint(d.SHORT, 90)
        item = list(range(n))
        k = d.allowed(n)
        near = vary(r, item, k)
        g = d.GRAM
        runs = {tuple(item[a : a + g]) for a in range(n - g + 1)}
        assert sum(tuple(near[a : a + g]) in runs for a in range(len(near) - g + 1)) >= max(1, n - g + 1 - g * k)


def test_clean_and_blocks(spark, odd, none):
    items = spark.createDataFrame([(1, "the same words stand in this line of text twice"), (2, ""), (3, None), (4, "1 2 3")], "item_id long, text string")
    kept = sorted((x.doc_id for x in d.clean(odd("edits"), items).collect()), key=str)
    assert kept == sorted([1, 2, None, 5, 6], key=str)
    assert d.matches(odd("start"), items).count() == 4
    assert d.matches(none, items).count() == 0 and d.clean(odd(), items.limit(0)).count() == 9
    assert len([*d.blocks(items, size=3)]) == 2
