"""The block parser and chunker against plain ones over random documents, and literal cases of each rule."""

import random

import pytest
from plain_chunking import chunk, markdown_blocks, split_table
from pyspark.sql import functions as F

from orrery.config import RagConfig
from orrery.operators import chunking

LINES = [
    "# One", "## Two  ", "### ", "#nospace", "####### seven", "- item", "  - nested", "1. first", "2) second", "*", "* star", "plain words", "  indented words", "\tx", "", "   ", "　", "| a | b |", "|---|:--:|", "| --- |", " | x |", "|--|", "```", "```python",
    "~~~", "  ~~~ ", "`` no", "text with | pipe", "长句子。还有！" * 3, "a b", "end\x85more", "\x1cgap", "# 　 ", "+ plus", "- ",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    out = ["", None, "\n", "x", "```", "| a |\n|---|", "- a\n\n  b\n- c\r\n  d\re", "~~~\n```\n~~~\n# in\n```\nlast"]
    return out + ["\n".join(r.choice(LINES) for _ in range(r.randint(1, 40))) for _ in range(400)] + ["word " * 3000, "# h\n" + "p\n\n" * 1500]


def test_blocks_against_plain(spark, texts):
    df = spark.createDataFrame([*enumerate(texts), (None, "# lost")], "document_id int, text string")
    got = {k: [] for k in range(len(texts))}
    for r in chunking.block_rows(df).orderBy("document_id", "block_no").collect():
        got[r.document_id].append((r.text, r.kind, r.level))
    for k, t in enumerate(texts):
        assert got[k] == [(b["text"], b["kind"], b["level"]) for b in markdown_blocks(t)], t


@pytest.mark.parametrize("size, overlap", [(800, 120), (60, 0), (40, 15), (1, 0)])
def test_chunks_against_plain(spark, texts, size, overlap):
    some = texts if size > 1 else texts[:60]
    df = spark.createDataFrame([*enumerate(some)], "document_id int, text string")
    got = {k: [] for k in range(len(some))}
    for r in chunking.draft_rows(chunking.block_rows(df), config=RagConfig(chunk_size=size, chunk_overlap=overlap)).orderBy("document_id", "seq_no").collect():
        assert r.seq_no == len(got[r.document_id]) + 1
        got[r.document_id].append((r.content, r.section_path, r.page_no, r.chunk_type))
    for k, t in enumerate(some):
        assert got[k] == [(d["content"], d["section_path"], d["page_no"], d["chunk_type"]) for d in chunk(markdown_blocks(t), size, overlap)], t


def test_blocks_of_any_form_against_plain(spark):
    """Pages, deep headings and tables without rules, as other parsers give them."""
    r = random.Random(13)
    docs = [[{"text": "\n".join(["w" * r.randint(1, 30)] * r.randint(1, 6)), "kind": (kind := r.choice(["heading", "paragraph", "table", "list"])), "level": r.randint(1, 9) if kind == "heading" else None, "page_no": r.choice([None, 1, 1, 2])} for _ in range(r.randint(0, 15))] for _ in range(150)]
    rows = [(k, n, b["text"], b["kind"], b["level"], b["page_no"]) for k, bs in enumerate(docs) for n, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "document_id int, block_no int, text string, kind string, level int, page_no int").repartition(5)
    got = {k: [] for k in range(len(docs))}
    for x in chunking.draft_rows(df, config=RagConfig(chunk_size=90, chunk_overlap=10)).orderBy("document_id", "seq_no").collect():
        got[x.document_id].append((x.content, x.section_path, x.page_no, x.chunk_type))
    for k, bs in enumerate(docs):
        assert got[k] == [(d["content"], d["section_path"], d["page_no"], d["chunk_type"]) for d in chunk(bs, 90, 10)]


def test_tables_against_plain(spark):
    r = random.Random(14)
    tables = ["\n".join(r.choice(["| ab |", "|---|", "| long row of a table |", "x"]) for _ in range(r.randint(1, 12))) for _ in range(200)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(tables)], "k int, t string").select("k", chunking.table_pieces(F.col("t"), 40).alias("x")).collect()
    assert all(x.x == split_table(tables[x.k], 40) for x in rows)


def test_one_exchange_by_document(spark):
    df = spark.createDataFrame([(1, "# a\nb")], "document_id int, text string")
    plan = chunking.draft_rows(chunking.block_rows(df))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("EvalPython") :]
    assert below.count("Exchange hashpartitioning") == 1 and plan.count("Exchange hashpartitioning") == 2 and plan.count("EvalPython") == 1


def drafts(spark, text, size=1000, overlap=0, form="md"):
    df = spark.createDataFrame([(1, text)], "document_id int, text string")
    return chunking.drafts(df, form=form, config=RagConfig(chunk_size=size, chunk_overlap=overlap)).first().drafts


def test_sections(spark):
    found = drafts(spark, "# Book\n\n## A\n\nFor all.\n\n## B\n\nTwice a day.")
    assert [d.section_path for d in found] == ["Book > A", "Book > B"] and found[0].content == "A\n\nFor all."
    found = drafts(spark, "# Book\n\n## B\n\n" + "A rule here. " * 20, 60)
    assert len(found) > 2 and {d.section_path for d in found} == {"Book > B"}
    assert [d.section_path for d in drafts(spark, "one\n\ntwo", form="txt")] == [None] and drafts(spark, "one\n\ntwo", form="txt")[0].content == "one\n\ntwo"
    assert [d.section_path for d in drafts(spark, "## x\na\n# y\nb\n### z\nc\n## w\nd")] == ["x", "y", "y > z", "y > w"]


def test_overlap_and_coverage(spark):
    text = "".join(f"Sentence {k} of the text。" for k in range(60))
    plain, lapped = drafts(spark, text, 100), drafts(spark, text, 100, 30)
    assert "".join(d.content for d in plain) == text and len(lapped) > len(plain) and all(len(d.content) <= 100 for d in lapped)
    at = 0
    for d in lapped:  # each piece starts no farther than where the one before ended
        found = text.index(d.content, max(0, at - 100))
        assert found <= at
        at = found + len(d.content)
    assert at == len(text)
