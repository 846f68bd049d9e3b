"""The queries' columns and digests against plain restatements, over whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from orrery.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def kinds(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def test_op2(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    out = queries.op2_bpe(spark, SF)
    assert kinds(out)[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))


def test_op3(spark, texts):
    from xxhash import xxh64_intdigest

    prints = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        hs = [xxh64_intdigest(" ".join(w[j : j + 3]).encode(), seed=42) for j in range(max(1, len(w) - 2))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    best = {k: k for k in prints}
    while True:
        new = {k: min([best[j] for j in prints if (prints[j] ^ prints[k]).bit_count() <= 3]) for k in prints}
        if new == best:
            break
        best = new
    out = queries.op3_simhash(spark, SF)
    assert kinds(out)[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()} == {k: (f"{prints[k]:016x}", best[k]) for k in prints}


def test_op4(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(k for k, v in rows.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v))
    u = np.array([rows[k] for k in ids], dtype=float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    best = np.array(ids)
    while True:
        new = np.array([min(best[k], best[near[k]].min(initial=best[k])) for k in range(len(ids))])
        if (new == best).all():
            break
        best = new
    true = {k: (int(near[j].sum()), int(best[j]), bool(best[j] == k)) for j, k in enumerate(ids)}
    out = queries.op4_embeddings(spark, SF)
    assert kinds(out)[:4] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()} == {k: true.get(k, (0, k, True)) for k in rows}


def test_op8(spark, texts):
    out = queries.op8_langid(spark, SF)
    assert kinds(out)[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) and (r.lang_pred == "und" or r.lang_pred in set(langs.values()))
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_op10(spark, texts):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    out = queries.op10_pii(spark, SF)
    assert kinds(out)[:7] == [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in forms), ("base_sha256", "string"), ("spans", "string")]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [f"{k}:{m.start()}:{m.end()}" for k, form in forms.items() for m in re.finditer(form, texts[r.doc_id] or "") if fits[k](m.group())]
        spans = [s for s in r.spans.split(",") if s]
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: ([*forms].index(s.split(":")[0]), int(s.split(":")[1])))
        assert [r[f"n_{k}"] for k in forms] == [sum(s.startswith(f"{k}:") for s in spans) for k in forms]


def test_op6_against_every_window(spark):
    """Whole documents by whole items, with the plain edit distance; sampling may miss few, and invents none."""
    from orrery.llm import decontaminate as d

    docs = [(r.doc_id, d.word_hashes(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, d.word_hashes(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    true = {}
    for k, h in docs:
        for i, w in items:
            common = np.isin(w, h).sum()
            if len(w) and common >= len(w) - d.allowed(len(w)) and (e := d.edits_within(w, h)) <= d.allowed(len(w)):
                true[k, i] = e
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op6_decontaminate(spark, SF).collect()}
    assert true and set(got) <= set(true) and len(got) >= 0.97 * len(true) and all(got[k] == true[k] for k in got)
