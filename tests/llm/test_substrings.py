import random

from orrery.llm import substrings


def brute(docs, size):
    first = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        stays = [True] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                stays[k : k + size] = [False] * size
        out[i] = b" ".join(x for x, s in zip(w, stays) if s).decode()
    return out


def test_against_brute_force_however_small_the_sketch(spark):
    r = random.Random(9)
    passages = [[r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(20)] for _ in range(6)]
    docs = []
    for k in range(120):
        w = [f"w{r.randrange(4000)}" for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        docs.append((k * 3, " ".join(w)))
    docs.append((1000, docs[5][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs, 13)
    for cells, shard in ((8, 8), (20, 18)):
        out = substrings.dedup(df, cells=cells, shard=shard).collect()
        assert {r.doc_id: r.kept for r in out} == expected
        assert all(r.n_words - r.n_removed == len(r.kept.split()) for r in out)


def test_odd_rows(odd, none):
    out = substrings.dedup(odd("kept", "n_words", "places"), cells=16, shard=16).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and by[1].kept == by[2].kept == by[6].kept == "" and by[5].n_removed == 0 and by[5].n_words == 30_000
    assert by[None].n_removed == 0 and by[4].n_words == 10
    assert substrings.dedup(none, cells=16, shard=16).count() == 0


def test_rows_that_share_an_id_keep_their_own_words(spark):
    """Of two texts under one id only the one that repeats an earlier document's window loses it."""
    shared, alone = " ".join(f"s{k}" for k in range(13)), " ".join(f"v{k}" for k in range(13))
    df = spark.createDataFrame([(1, shared, "p"), (2, alone, "q"), (2, shared, "r"), (2, alone, "q"), (None, shared, None)], "doc_id long, text string, places string")
    out = sorted((str(r.doc_id), r.kept, str(r.places)) for r in substrings.dedup(df).collect())
    assert out == sorted([("1", shared, "p"), ("2", alone, "q"), ("2", alone, "q"), ("2", "", "r"), ("None", shared, "None")])
    assert substrings.cells_for(df, "text") == 16 and substrings.cells_for(df, "text", most=12) == 12
