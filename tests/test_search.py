"""The indexes against exact scans."""

import random

import numpy as np
import pytest

from orrery.operators import keyword_index, retrieval, vector_index
from orrery.operators.lineage import place
from orrery.plans.search import item_terms, r4_hybrid_indexed

SF = "/root/testdata/sf0.01"


def key(rows):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in rows)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 24))
    rows = [(k, (centres[k % 30] + rng.standard_normal(24) * rng.choice([0.3, 0.7])).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>").cache()
    queries = df.where("doc_id % 50 = 0").selectExpr("doc_id query_id", "embedding q").cache()
    return df, queries, vector_index.build(df, place(spark, "test")), retrieval.vector_top(queries, df, 12, -1.0).collect()


def test_probed_recall(vectors):
    df, queries, index, true = vectors
    got = {(r.query_id, r.doc_id) for r in vector_index.search(queries, index, 12).collect()}
    assert len(true) == 60 * 12 and len(got & {(r.query_id, r.doc_id) for r in true}) >= 0.95 * len(true)
    n = index.centroids.count()
    assert n > 40 and index.lists.count() == 3000


def test_exact_and_all_lists_equal_the_scan(vectors):
    df, queries, index, true = vectors
    assert key(vector_index.search(queries, index, 12, probes=index.centroids.count()).collect()) == key(true)
    assert key(vector_index.search(queries, index, 12, probes=2, exact=True).collect()) == key(true)
    over = key(r for r in true if r.score >= 0.9)
    assert over and key(vector_index.search(queries, index, 12, 0.9, probes=1, exact=True).collect()) == over


def test_parts_of_a_crowded_list(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 20)
    df, queries, _, true = vectors
    index = vector_index.build(df, place(spark, "test"), lists=3)
    assert index.lists.select("list", "part").distinct().count() > 50
    assert key(vector_index.search(queries, index, 12, probes=3).collect()) == key(true)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (0, [1.0, 1.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    index = vector_index.build(df, place(spark, "test"))
    q = df.selectExpr("doc_id query_id", "embedding q")
    assert [(r.query_id, r.doc_id) for r in vector_index.search(q, index, 3, exact=True).orderBy("query_id").collect()] == [(0, 7), (7, 0)]
    none = vector_index.build(df.limit(0), place(spark, "test"))
    assert vector_index.search(q, none, 3).count() == 0


def test_keyword_index_equals_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = keyword_index.build(docs, place(spark, "test"))
    terms = item_terms(spark, SF)
    out = keyword_index.matches(docs, terms, index)
    assert "NestedLoop" not in (p := out._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in p
    row = lambda r: (r.query_id, r.doc_id, r.match_count, r.len)
    assert sorted(map(row, out.collect())) == sorted(map(row, retrieval.keyword_matches(docs, terms).collect()))


def test_hybrid_search_fails_with_either_index(spark, monkeypatch):
    """No list of one retriever alone is given out as the fused result."""

    def broken(*args, **kwargs):
        raise RuntimeError("no index")

    for module in (keyword_index, vector_index):
        with monkeypatch.context() as m, pytest.raises(RuntimeError, match="no index"):
            m.setattr(module, "build", broken)
            r4_hybrid_indexed(spark, "/root/testdata/sf0.001").collect()


def test_odd_texts_and_terms(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 7)
    r = random.Random(9)
    texts = [None, "", "a", "ÄB", "ab🎉c", "x" * 20_000, "İstanbul", "日本語の文"] + ["".join(r.choice("abcä🎉 ") for _ in range(r.randint(0, 12))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "abc")], "doc_id int, text string")
    terms = ["a", "B", "ab", "abc", "🎉", "🎉c", "äb", " ", "xxx", "xxxx", "zzz", "", None, "日本", "本語の", "cab ", "İ"]
    asked = spark.createDataFrame([(k % 3, t) for k, t in enumerate(terms)], "query_id int, term string")
    row = lambda r: (r.query_id, r.doc_id, r.match_count, r.len)
    index = keyword_index.build(docs, place(spark, "test"))
    expected = sorted(map(row, retrieval.keyword_matches(docs.where("doc_id is not null"), asked).collect()))
    assert sorted(map(row, keyword_index.matches(docs, asked, index).collect())) == expected and expected
    assert keyword_index.matches(docs, asked, keyword_index.build(docs.limit(0), place(spark, "test"))).count() == 0


def test_keyword_index_of_shared_ids_in_pieces(spark, monkeypatch):
    """Rows that share an id, ids that are texts, queries of several pieces; no row for each gram of a document is made, and a block's lists stay short."""
    for name, n in (("BLOCK", 15), ("PIECE", 3), ("TOLD", 2), ("GRAMMED", 64), ("RAREST", 2)):
        monkeypatch.setattr(keyword_index, name, n)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abÄ𝄞") for _ in range(r.randint(1, 5)))
    rows = [(f"d{r.randint(0, 150)}", r.choice([None, "", " ".join(word() for _ in range(r.randint(1, 30)))])) for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    terms = spark.createDataFrame([(f"q{q}", word().upper()) for q in range(20) for _ in range(9)], "query_id string, term string")
    index = keyword_index.build(docs, place(spark, "test"))
    out = keyword_index.matches(docs, terms, index)
    row = lambda r: (r.query_id, r.doc_id, r.match_count, r.len)
    expected = sorted(map(row, retrieval.keyword_matches(docs, terms).collect()))
    assert sorted(map(row, out.collect())) == expected and len(expected) > 500
    assert index.blocks.count() > 3 and index.postings.where("dense").count() and index.postings.where("not dense").count()
    lists = index.postings.selectExpr("count(*) lists", "sum(n) n", "max(length(bits)) longest").first()
    assert lists.lists * 2 < lists.n and lists.longest <= 20
    few = docs.where("doc_id < 'd2'")  # documents that have gone since, and ones that came since
    assert sorted(map(row, keyword_index.matches(few, terms, index).collect())) == [x for x in expected if x[1] < "d2"]
    assert keyword_index.matches(docs, terms, keyword_index.build(few, place(spark, "test"))).count() == sum(x[1] < "d2" for x in expected)


def test_best_documents_of_many_queries(spark, monkeypatch):
    """In blocks of any size, with ties, shared ids, long terms and letters beyond the first plane, as the list of all matches says; no such list is made."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abÄ𝄞") for _ in range(r.randint(1, 5)))
    docs = spark.createDataFrame([(r.choice([k, k, k, None, 7]), r.choice([None, "", " ".join(word() for _ in range(r.randint(1, 30)))])) for k in range(120)], "doc_id long, text string")
    terms = spark.createDataFrame([(q, t) for q in range(40) for t in [r.choice(["", "zzz", word().upper(), word() + " " + word()]) for _ in range(r.randint(0, 9))]], "query_id long, term string")
    expected = sorted(tuple(x) for x in retrieval.keyword_top(docs.where("doc_id is not null"), terms, 4).select("query_id", "doc_id", "match_count", "len", "rank").collect())
    assert len(expected) > 80
    for name, n in (("QUERIES", 9), ("DOCUMENTS", 25), ("AT_ONCE", 4), ("COUNTED", 3)):
        monkeypatch.setattr(keyword_index, name, n)
    out = keyword_index.top(docs, terms, 4)
    assert sorted(tuple(x) for x in out.select("query_id", "doc_id", "match_count", "len", "rank").collect()) == expected
    assert keyword_index.top(docs.limit(0), terms, 4).count() == 0 and keyword_index.top(docs, terms.limit(0), 4).count() == 0


def test_words_of_documents_are_searched_once(monkeypatch):
    """However often its words come again in documents; results are those of brute force, for terms of any letters, spans of any size and words forgotten on the way."""
    r = random.Random(4)
    known = ["".join(r.choice("abÄ𝄞é") for _ in range(r.randint(1, 7))) for _ in range(60)]
    docs = sorted((len(t), k, t) for k in range(400) for t in [" ".join(r.choice(known) for _ in range(r.randint(0, 25)))])
    searched, found = [], keyword_index._Block._held_terms
    monkeypatch.setattr(keyword_index._Block, "_held_terms", lambda self, texts: searched.append(sum(map(len, texts))) or found(self, texts))

    def best(asked):
        block = keyword_index._Block(4)
        for q, terms in enumerate(asked):
            block.add({"id": q, "len": None, "low": None, "terms": terms})
        for n, k, t in docs:
            block.add({"id": k, "len": n, "low": t, "terms": None})
        expected = [(q, k, m, n) for q, terms in enumerate(asked) for m, n, k in sorted(((sum(x in t for x in terms), n, k) for n, k, t in docs), key=lambda x: (-x[0], x[1:]))[:4] if m]
        got = [tuple(x.values()) for b in block.result() for x in b.to_pylist()]
        assert sorted(got) == sorted(expected) and expected

    words = [list({r.choice(known)[: r.randint(1, 7)] for _ in range(r.randint(1, 20))}) for _ in range(70)]
    best(words)
    assert sum(searched) <= sum(len(t.encode()) for t in known)
    for name, n in (("SPAN", 64), ("AT_ONCE", 9), ("COUNTED", 7), ("WORDS", 20), ("LETTERS", 200)):
        monkeypatch.setattr(keyword_index, name, n)
    best(words)
    best([w + [f"{r.choice(known)} {r.choice(known)}", "zzz"] for w in words])


def test_exact_scan_in_blocks(spark, monkeypatch):
    """Blocks of any size give the nearest vectors, ties to the smaller id; vectors without a cosine are left out; no plan has a nested loop."""
    r = np.random.default_rng(8)
    known = [(k, v) for k, v in enumerate(r.normal(size=(90, 5)).round(1).tolist() * 2)] + [(200, None), (201, [0.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5)]
    e = spark.createDataFrame(known, "doc_id long, embedding array<double>")
    for name, n in (("VECTORS", 40), ("QUERIES", 7), ("AT_ONCE", 16), ("ASKED", 3)):
        monkeypatch.setattr(retrieval, name, n)
    out = retrieval.vector_top(e.where("doc_id % 5 = 0").selectExpr("doc_id query_id", "embedding q"), e, 12, 0.3)
    units = {k: np.array(v) / np.linalg.norm(v) for k, v in known[:180]}
    expected = []
    for q in range(0, 180, 5):
        scores = sorted((-round(float(units[q] @ units[d]), 6), d) for d in units if d != q)
        expected += [(q, j + 1, d, round(-s, 5)) for j, (s, d) in enumerate(scores[:12]) if -s >= 0.3]
    assert key(out.collect()) == sorted(expected)
    assert "NestedLoop" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
