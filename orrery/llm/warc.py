"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload captured elsewhere) and metadata. The
archives are gzip files of WARC/1.1 records, written by Spark's text writer, so any store that Spark writes
to will do; records are parsed by their Content-Length, so payloads may hold anything. The reader takes
whole files of bounded size (the writer cuts them by bytes) and also understands archives made elsewhere.

Transactions: records name others of their transaction in WARC-Concurrent-To, which may stand on either of the two, and more
than once. A request or metadata record that names a response or revisit, or is named by one, belongs to it; one that does neither
belongs to what the records belong to that it is linked with by other requests and metadata, however many. Every capture gives one nested row.

Defined cases: a null payload counts as empty; a page without a key is a response, named by its payload, whose
metadata names no page; a capture without request or metadata has null or an empty list there; of several
requests of one capture the one with the smallest record id is nested; a record of several captures is nested in each; records
that lead to no response or revisit give no row; unknown record types are ignored; a record whose length is no number, or
that ends too early, and the rest of a broken gzip file are skipped and give a row of type ``malformed``, which tells what is lost; no pages give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.components import components
from orrery.llm.shared import folder, saved

#: Payloads from this many bytes on are stored once; archive files hold about FILE_BYTES before compression.
REVISIT_BYTES, FILE_BYTES = 1000, 8 << 20
#: The end of a record, as the text writer's line separator.
END = "\r\n\r\n"


def _record(kind: str, rid: Column, fields: dict[str, Column], block: Column) -> Column:
    """A record without its end. Fields whose value is null are left out."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), rid, F.lit(">\r\n")]
    head += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields.items()]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def _name(kind: str, key: Column) -> Column:
    """A record's URN, made of the page's key, so that a task that is run again writes the same bytes."""
    digits = F.md5(F.concat(F.lit(kind + ":"), key.cast("string")).cast("binary"))
    cut = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def decided(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """pages with ``refers_to``: of equal payloads of at least ``least`` bytes, the largest key, for the others among them."""
    body = F.coalesce(F.encode(payload, "UTF-8"), F.lit(b""))
    slim = pages.select(key, F.octet_length(body).alias("n"), F.unhex(F.sha2(body, 256)).alias("same")).where(F.col("n") >= least)
    kept = saved(slim.groupBy("same").agg(F.max(key).alias("refers_to"), F.min(key).alias("least")).where("least < refers_to").drop("least"), "payloads")
    revisits = saved(slim.join(kept, "same").where(F.col(key) < F.col("refers_to")).select(key, "refers_to").distinct(), "revisits")
    return pages.drop("refers_to").join(revisits, key, "left")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> None:
    """Three records for each page: request, response or revisit, metadata. Where key repeats, payloads should too."""
    mean = pages.agg(F.avg(F.octet_length(payload))).first()[0] or 0
    rows = decided(pages.select(key, url, payload), key, payload, least)
    body = F.coalesce(F.col(payload), F.lit(""))
    k = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("none-"), F.sha1(F.encode(body, "UTF-8"))))
    digest = F.concat(F.lit("sha1:"), F.sha1(F.encode(body, "UTF-8")))
    safe = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "")  # a header line holds no line breaks
    host, rest = F.regexp_extract(safe, "^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(safe, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    main = F.when(F.col("refers_to").isNull(), _name("response", k)).otherwise(_name("revisit", k))
    at = {"WARC-Target-URI": F.when(safe != "", safe), "WARC-Date": F.lit("2024-01-01T00:00:00Z")}
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    request = _record("request", _name("request", k), at | {"WARC-Concurrent-To": F.concat(F.lit("<"), main, F.lit(">")), "Content-Type": F.lit("application/http; msgtype=request")}, F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    own = at | {"WARC-Payload-Digest": digest, "Content-Type": F.lit("application/http; msgtype=response")}
    size = F.concat(F.lit(f"{http}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    response = _record("response", main, own, F.concat(size, body))
    revisit = _record("revisit", main, own | {"WARC-Refers-To": F.concat(F.lit("<"), _name("response", F.col("refers_to")), F.lit(">")), "WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")}, size)
    named = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")), F.lit(""))
    notes = F.concat(named("page", key), named("refers-to-page", "refers_to"))
    metadata = _record("metadata", _name("metadata", k), at | {"WARC-Concurrent-To": F.concat(F.lit("<"), main, F.lit(">")), "Content-Type": F.lit("application/warc-fields")}, notes)
    records = rows.select(F.concat(request, F.lit(END), F.when(F.col("refers_to").isNull(), response).otherwise(revisit), F.lit(END), metadata).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1200)))).text(path)


#: ``links`` has all records that a record names as concurrent, ``concurrent_to`` the first; ``fields`` the first value of each field.
RECORD = "type string, id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>, links array<string>"


class _Stream:
    """An archive's bytes, decompressed as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.source, self.at, self.step, self.member, self.held = memoryview(data), 0, step, None, bytearray()
        self.packed, self.broken = data[:2] == b"\x1f\x8b", False

    def more(self) -> bool:
        import zlib

        if self.at >= len(self.source):
            return False
        part = self.source[self.at : self.at + self.step]
        if not self.packed:
            self.held += part
            self.at += len(part)
            return True
        self.member = self.member or zlib.decompressobj(31)
        try:
            self.held += self.member.decompress(part)
        except zlib.error:
            self.at, self.broken = len(self.source), True
            return False
        self.at += len(part) - len(self.member.unused_data)
        if self.member.eof:  # one member for each record in many archives, one for the file in ours
            self.member = None
        return True

    def find(self, what: bytes) -> int:
        start = 0
        while (at := self.held.find(what, start)) < 0:
            start = max(0, len(self.held) - len(what))
            if not self.more():
                return -1
        return at

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive's bytes. The payload of HTTP messages is what follows their own header."""
    stream = _Stream(data)
    while (at := stream.find(b"WARC/")) >= 0:
        stream.take(at)
        if (end := stream.find(b"\r\n\r\n")) < 0:
            return
        every = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in stream.take(end + 4)[:-4].decode("utf-8", "replace").split("\r\n")[1:])]
        fields = dict(reversed(every))
        size = fields.get("content-length", "0")
        block = stream.take(int(size)) if size.isascii() and size.isdigit() else b""
        if str(len(block)) != (size.lstrip("0") or "0"):
            yield "malformed", fields.get("warc-record-id", "").strip("<>") or None, None, None, None, None, b"", b"", fields, []
            continue
        payload = block
        if "application/http" in fields.get("content-type", ""):
            payload = block.partition(b"\r\n\r\n")[2]
        bare = lambda k: fields[k].strip("<>") if k in fields else None
        links = [*dict.fromkeys(v.strip("<>") for k, v in every if k == "warc-concurrent-to")]
        yield fields.get("warc-type"), bare("warc-record-id"), bare("warc-concurrent-to"), bare("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), block, payload, fields, links
    if stream.broken:
        yield "malformed", None, None, None, None, None, b"", b"", {}, []


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below path. payload_bytes of a revisit is that of the payload it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(),) * 6 + (pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()))
        names = ["type", "id", "concurrent_to", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload", "fields", "links"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for x in batches:
            for data in x.column("content"):
                rows, held = [], 0
                for kind, rid, to, refers, uri, digest, block, payload, fields, links in _parse(data.as_py()):
                    n = len(payload)
                    if kind == "revisit":
                        head = block.partition(b"\r\n\r\n")[0].decode("latin-1").lower()
                        n = next((int(v) for k, _, v in (line.partition(":") for line in head.split("\r\n")) if k == "content-length"), n)
                    rows.append((kind, rid, to, refers, uri, digest, n, payload, [*fields.items()], links))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture, request, metadata (a list)."""
    captures = records.where("type in ('response', 'revisit')")
    # saved, since several joins below read them: archives are parsed once for these and once for captures
    is_other = F.col("type").isin("request", "metadata")
    held = saved(records.where(is_other | (F.size("links") > 0)).withColumn("payload", F.when(is_other, F.col("payload"))), "others")
    others, naming = held.where(is_other & F.col("id").isNotNull()), held.where(~is_other).select(F.col("id").alias("capture_id"), F.explode("links").alias("id"))
    linked = others.select("*", F.explode("links").alias("capture_id")).join(others.select(F.col("id").alias("capture_id"), F.lit(True).alias("inner link")).distinct(), "capture_id", "left")
    parts = linked.where("`inner link` is null").drop("inner link")
    several = False
    if not naming.isEmpty():
        parts, several = parts.unionByName(others.join(naming.where("capture_id is not null").distinct(), "id")), True
    inner = saved(linked.where("`inner link`").select(F.col("id").alias("a"), F.col("capture_id").alias("b")), "inner")
    if not inner.isEmpty():
        sets = saved(components(inner), "sets").withColumnRenamed("node", "id")
        owned = parts.select("id", "capture_id").distinct()
        reached = owned.join(sets, "id").select("component", "capture_id").distinct()
        further = sets.join(owned, "id", "left_anti").join(reached, "component").select("id", "capture_id")
        parts, several = parts.unionByName(others.join(further, "id")), True
    if several:
        parts = parts.dropDuplicates(["capture_id", "id"])
    record = F.struct(*(c for c in records.columns if c != "type"))
    nested = parts.groupBy("capture_id").agg(
        F.min_by(F.when(F.col("type") == "request", record), F.when(F.col("type") == "request", F.col("id"))).alias("request"),
        F.collect_list(F.when(F.col("type") == "metadata", record)).alias("metadata"),
    )
    joined = captures.join(nested, captures["id"] == nested["capture_id"], "left")
    return joined.select(F.struct(*(captures[c] for c in captures.columns)).alias("capture"), "request", F.coalesce("metadata", F.array().cast(nested.schema["metadata"].dataType)).alias("metadata"))


def archive_folder(spark: SparkSession) -> str:
    return f"{folder(spark)}/warc-{uuid.uuid4().hex}"
