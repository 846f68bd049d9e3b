import numpy as np
import pytest

from orrery.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(langid.held_out())
    rows = langid.predict(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_words_of_mixed_text(spark, model):
    df = spark.createDataFrame([("the heea from the thanly und der die enbever ist nicht",)], "text string")
    words = langid.predict(df, model, words="w").first().w
    assert words[:4] == ["en"] * 4 and words[-4:] == ["de"] * 4


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    e, trans, start = rng.standard_normal((7, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    p = langid.marginals(e, np.array([4, 1, 2]), trans, start)[0]
    for first, n in ((0, 4), (4, 1), (5, 2)):
        total = np.zeros((n, 3))
        for ys in product(range(3), repeat=n):
            w = np.exp(start[ys[0]] + sum(e[first + k, y] for k, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
            for k, y in enumerate(ys):
                total[k, y] += w
        assert np.allclose(p[first : first + n], total / total.sum(1, keepdims=True))


def test_odd_rows(odd, none, model):
    rows = langid.predict(odd("lang_pred", "score"), model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 6, 7)) and by[5].lang_pred in model["langs"]
    assert langid.predict(none, model).count() == 0
    assert langid.train(none) == {"langs": []} and langid.predict(odd(), {"langs": []}).where("lang_pred <> 'und'").count() == 0
