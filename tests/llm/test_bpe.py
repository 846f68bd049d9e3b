import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from orrery.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return bpe.WordBpe(open(PATH, encoding="utf-8").read()), t


def test_matches_the_library(pair):
    model, t = pair
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzéßΣİ'’!?.<|>日本\x1c\x1d\x85  \t\n0123456789ǅﬁÀ́̈​🎉"
    words = ["the", "ing", "aaa", "aaaa", "!!!", "<|endoftext|>", "'s", "er", "ΑΣ", " "]
    texts = ["", "<|startoftext|>x<|endoftext|>", "a" * 5000, "don't I'LL"]
    for k in range(6000):
        texts.append("".join(r.choice(letters if k % 2 else words) for _ in range(r.randint(0, 25))))
    for s, packed in zip(texts, model.encode(texts)):
        ids = t.encode(s, add_special_tokens=False).ids
        assert np.array(ids, "<u4").tobytes() == packed, s
        assert model.decode(packed) == t.decode(ids, skip_special_tokens=False)


def test_odd_rows(spark, odd, none):
    df = odd("token_ids", "decoded")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    rows = out.collect()
    assert len(rows) == 9 and {r.doc_id: r.n_tokens for r in rows}[1] == 0
    assert {r.decoded for r in rows if r.doc_id in (1, 2)} == {""}
    ids = out.where("doc_id = 7").select("n_tokens", bpe.unpacked(out.token_ids).alias("ids"), "token_ids").first()
    assert ids.ids == np.frombuffer(ids.token_ids, "<u4").tolist() and len(ids.ids) == ids.n_tokens
    assert bpe.encode(none, PATH).count() == 0
