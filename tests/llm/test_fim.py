import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import fim

SF = "/root/testdata/sf0.001"


def plainly(doc_id, text):
    """One document's row, restated."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_query_against_a_plain_restatement(spark):
    from orrery.llm import queries

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op11_fim(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        n, form, a, m, output = plainly(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, m, sha(output), sha(texts[r.doc_id] or ""))
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 128, 1000):
        s = rng.integers(0, 16, n).astype(np.uint8)
        w = fim.WaveletMatrix(s)
        at = np.arange(n + 1)
        for wanted in ([3], range(16), [0, 15, 7], [4, 5, 6, 7]):
            assert (w.ranks(wanted, at) == np.concatenate([[0], np.cumsum(np.isin(s, list(wanted)))])).all()
        for c in range(16):
            where = np.flatnonzero(s == c)
            assert (w.places(c, np.arange(len(where))) == where).all()


@pytest.mark.parametrize("unit", fim.UNITS)
def test_cuts_of_units(unit):
    r = random.Random(3)
    texts = ["", "\n", "a", " a", "\n\nx", "😀 é\nß"] + ["".join(r.choice("ab é.😀\n \n") for _ in range(r.randint(0, 90))) for _ in range(400)]
    draws = [np.array([r.getrandbits(32) for _ in texts], np.uint64) for _ in range(2)]
    starts = {
        "char": lambda t: list(range(len(t))),
        "word": lambda t: [k for k in range(len(t)) if k == 0 or (t[k - 1].isspace() and not t[k].isspace())],
        "line": lambda t: [k for k in range(len(t)) if k == 0 or t[k - 1] == "\n"],
    }[unit]
    units, first, second = fim.cut_places(texts, draws, unit)
    for k, t in enumerate(texts):
        at = [*starts(t), len(t)]
        n = len(at) - 1
        cuts = sorted(int(d[k]) % (n + 1) for d in draws)
        assert (units[k], first[k], second[k]) == (n, at[cuts[0]], at[cuts[1]])


def test_select_where_one_class_starts_units(monkeypatch):
    monkeypatch.setitem(fim.UNITS, "break", [4 * fim.NEWLINE + fim.WORD])
    texts = ["ab\ncd\nef", "\nab", "", "x", "a\n.b\nc"]
    for draw in range(6):
        units, first, second = fim.cut_places(texts, [np.full(5, draw, np.uint64)] * 2, "break")
        for k, t in enumerate(texts):
            at = [*(k for k in range(len(t)) if k == 0 or (t[k - 1] == "\n" and t[k].isalnum())), len(t)]
            assert (units[k], first[k], second[k]) == (len(at) - 1, at[draw % len(at)], at[draw % len(at)])


def test_odd_rows(spark, odd, none):
    df = odd("output", "form", "n", "fim cuts")
    out = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == 9
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text) and r.back == (r.text or "")
    assert fim.transform(none).count() == 0
    marks = [(k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M>", "<P<P", "<", ">S><", "<S<M", "P>"] * 40)]
    out = fim.transform(spark.createDataFrame(marks, "doc_id long, text string")).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text and (r.form == "plain" or not re.search("<[PSM]>", r.text)) for r in out) and len({r.form for r in out}) == 3
