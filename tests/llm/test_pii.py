import random
import re

import pytest

from orrery.llm import pii

SF = "/root/testdata/sf0.01"


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans():
    r = random.Random(3)
    parts = ["a", "b@", ".", "1", "23", "@", "é", "+", "-", "(", ")", " ", "4111111111111111", "255", "\x1f", "%", "_", "１"]
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 22)))
        assert sorted(plain(t)) == sorted(pii.base_spans(t)), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_additions(spark, model):
    texts = ["mail us: jane.doe [at] sample [dot] com today", "call (415) 555-0134 now", "on 2021-03-04 it rained", "see pages 12-34", "bob@x.org and 10.0.0.1"]
    rows = pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s.kind for s in rows[0].added] == ["email"]
    assert not rows[2].added and not rows[3].added
    assert {s.kind for s in rows[4].base} == {"email", "ip"}
    out = [r.redacted for r in pii.redact(pii.find(spark.createDataFrame([(texts[4],)], "text string"), model)).collect()]
    assert out == ["[email] and [ip]"]


def test_odd_rows(odd, none, model):
    rows = pii.find(odd("base", "added"), model).collect()
    assert len(rows) == 9 and all(not r.base for r in rows)
    assert pii.find(none, model).count() == 0
    assert pii.train(none)["trees"]


def test_overlaps_of_any_number(spark):
    """A span inside a long base span is never added, however many others lie before it."""
    address = "1.2.3.4." * 12 + "555.555.5555@host.example"
    base = pii.base_spans(address)
    model = {"thresholds": dict.fromkeys(pii.KINDS, 0.0), **{k: v for k, v in pii.train(spark.createDataFrame([], "doc_id long, text string")).items() if k != "thresholds"}}
    assert base[0] == ("email", 0, len(address)) and pii.added_spans(address, base, model) == []


def test_generators_and_measures(spark):
    model = pii.train(spark.createDataFrame([(1, "some plain words of a line\nmore")], "doc_id long, text string"))
    for s in ("fe80::1", "2001:db8::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"):
        assert ("ip", 5, 5 + len(s)) in pii.proposals(f"host {s} up"), s
        assert ("ip", 6, 6 + len(s)) in pii.proposals(f"host [{s}]:8080 up"), s
    found = pii.measured(model, ["other words that stand in lines", "and some more of them"])
    print(found)
    assert all(p >= 0.9 and r >= 0.8 for p, r in found.values())


def test_lines_written_by_hand(spark, model):
    """What the base forms and the additions find together in lines that no generator made."""
    from pii_lines import LINES

    rows = pii.find(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LINES)], "doc_id long, text string"), model).collect()
    found = {(r.doc_id, s.kind, LINES[r.doc_id][0][s.start : s.end]) for r in rows for s in [*r.base, *r.added]}
    true = {(k, *d) for k, (_, ds) in enumerate(LINES) for d in ds}
    print("RECALL", len(found & true) / len(true), "PRECISION", len(found & true) / len(found), "MISSED", sorted(true - found), "EXTRA", sorted(found - true))
    assert len(found & true) >= 0.8 * len(true) and len(found & true) >= 0.9 * len(found)
