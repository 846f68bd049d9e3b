import gzip
import hashlib
import random

from pyspark.sql import functions as F

from orrery.llm import warc


def test_round_trip(spark, tmp_path):
    r = random.Random(5)
    bodies = ["", None, "short é", "x" * 1000, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40, "y" * 999] + ["".join(r.choice("ab\n\r☃") for _ in range(1500)) for _ in range(3)]
    pages = [(k, f"http://h.example/p{k}", r.choice(bodies)) for k in range(80)] + [(200, None, "z"), (201, "bad url\r\n", "z")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/w")
    records = warc.read(spark, f"{tmp_path}/w")
    assert records.count() == 3 * len(pages)
    rows = warc.transactions(records).collect()
    assert len(rows) == len(pages)
    top = {}
    for k, _, h in pages:
        if len((h or "").encode()) >= 1000:
            top[h] = max(k, top.get(h, k))
    for x in rows:
        k = int(x.metadata[0].payload.decode().split("\r\n")[0].split(": ")[1])
        html = (next(h for p, _, h in pages if p == k) or "").encode()
        revisit = top.get(html.decode(), k) != k
        assert x.capture.type == ("revisit" if revisit else "response") and x.capture.payload_bytes == len(html)
        assert x.capture.payload_digest == "sha1:" + hashlib.sha1(html).hexdigest()
        assert revisit or bytes(x.capture.payload) == html
        assert x.request.concurrent_to == x.capture.id


def test_foreign_archive(spark, tmp_path):
    def record(kind, rid, to=None, body=b"b"):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n" + (f"WARC-Concurrent-To: <{to}>\r\n" if to else "") + f"Content-Length: {len(body)}\r\n\r\n"
        return gzip.compress(head.encode() + body + b"\r\n\r\n")

    data = record("warcinfo", "i") + record("response", "r1") + record("request", "q1", "r1") + record("metadata", "m1", "q1") + record("metadata", "m2", "r1") + record("response", "r2") + record("metadata", "m3", "lost")
    (tmp_path / "a.warc.gz").write_bytes(data)
    out = {x.capture.id: x for x in warc.transactions(warc.read(spark, str(tmp_path))).collect()}
    assert sorted(out) == ["r1", "r2"] and out["r1"].request.id == "q1" and sorted(m.id for m in out["r1"].metadata) == ["m1", "m2"]
    assert out["r2"].request is None and out["r2"].metadata == []


def _record(kind, rid, *to, length=None, body=b"b"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n" + "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in to) + f"Content-Length: {len(body) if length is None else length}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_links_in_both_directions_and_chains(spark, tmp_path):
    data = _record("response", "r1", "q1", "m1") + _record("request", "q1") + _record("metadata", "m1") + _record("metadata", "m2", "q1") + _record("metadata", "m3", "m2") + _record("metadata", "m4", "m3")
    data += _record("revisit", "v1", "q2") + _record("request", "q2", "v1") + _record("metadata", "m5", "r1", "v1") + _record("metadata", "m6", "m7") + _record("metadata", "m7", "m6") + _record("response", "r2")
    (tmp_path / "a.warc").write_bytes(data)
    out = {x.capture.id: x for x in warc.transactions(warc.read(spark, str(tmp_path))).collect()}
    assert sorted(out) == ["r1", "r2", "v1"]
    assert (out["r1"].request.id, sorted(m.id for m in out["r1"].metadata)) == ("q1", ["m1", "m2", "m3", "m4", "m5"])
    assert (out["v1"].request.id, [m.id for m in out["v1"].metadata]) == ("q2", ["m5"]) and out["r2"].request is None
    assert out["r1"].capture.links == ["q1", "m1"] and out["r1"].capture.concurrent_to == "q1"


def test_malformed_records_are_told(spark, tmp_path):
    good = _record("response", "r1") + _record("request", "q1", "r1")
    (tmp_path / "a.warc").write_bytes(good + _record("metadata", "bad", "r1", length="abc") + _record("metadata", "minus", "r1", length="-4") + _record("metadata", "m1", "r1") + _record("response", "cut", length=999))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(_record("response", "r2")) + gzip.compress(_record("response", "r3") * 50)[:40] + b"\xff" * 300)
    records = warc.read(spark, str(tmp_path))
    assert sorted(str(r.id) for r in records.where("type = 'malformed'").collect()) == ["None", "bad", "cut", "minus"]
    out = {x.capture.id: x for x in warc.transactions(records).collect()}
    assert {"r1", "r2"} <= set(out) and out["r1"].request.id == "q1" and [m.id for m in out["r1"].metadata] == ["m1"]


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string, refers_to string"), f"{tmp_path}/w")
    assert warc.transactions(warc.read(spark, f"{tmp_path}/w")).count() == 0


def test_query_with_pages_without_key(spark, tmp_path):
    """The digests of the query itself; rows whose page_id is null are responses, also where the payload repeats."""
    from orrery.llm import queries

    long = "l" * 1200
    pages = [(1, "http://h/a", long), (2, "http://h/b", long), (None, "http://h/c", long), (None, None, long), (None, "u", None), (3, None, "short"), (4, "http://h/d", "short")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op5_warc(spark, str(tmp_path)).collect()
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    expected = [(i, len(h or ""), sha(h), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in pages]
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, expected))
