"""Structural blocks of documents and chunks made of them, in DataFrame operations.

A document becomes rows of lines; line forms, and running windows over a document's lines, tell which lines make a block
(fences, which may hold anything, are matched in the row before). Blocks become sections, sections chunks, by windows and
folds over what a section holds. All of it follows one exchange by document. Only the splitter of texts that are too long
for a chunk is Python; it sees those texts alone, and numbering the chunks after it takes a second exchange.

A document is known by its key; rows without one are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.config import RagConfig
from orrery.functions.text import paragraphs

#: Line forms of Markdown, and separators for texts that are too long, coarse to fine.
_S = r"[\s\x1c-\x1f]"
FENCE, HEADING, LIST = rf"(?U)^{_S}*(```|~~~)", rf"(?Us)^(#{{1,6}}){_S}+(.*)$", rf"(?U)^{_S}*(?:[-*+]|[0-9]+[.)]){_S}+"
ROW, RULE = rf"(?Us)^{_S}*\|.*\|{_S}*$", rf"(?U)^{_S}*\|(?:{_S}*:?-{{2,}}:?{_S}*\|)+{_S}*$"
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
#: Headings deeper than this don't occur.
LEVELS = 9
DRAFT = "struct<content:string,section_path:string,page_no:int,chunk_type:string>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_S}+|{_S}+$", "")


def _fenced(lines: Column) -> Column:
    """For each line the number of the fence that it is in, from 1, or 0. A fence ends with the next line that starts with its mark; an open one runs to the end."""
    marks = F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("at"), F.regexp_extract(x, FENCE, 1).alias("mark"))), lambda m: m["mark"] != "")
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.lit("").alias("open"), F.lit(-1).alias("since"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        opened = F.struct(m["mark"].alias("open"), m["at"].alias("since"), acc["spans"].alias("spans"))
        closed = F.struct(F.lit("").alias("open"), F.lit(-1).alias("since"), F.concat(acc["spans"], span(acc["since"], m["at"])).alias("spans"))
        return F.when(acc["open"] == "", opened).when(acc["open"] == m["mark"], closed).otherwise(acc)

    return F.aggregate(marks, start, step, lambda acc: F.when(acc["open"] == "", acc["spans"]).otherwise(F.concat(acc["spans"], span(acc["since"], F.size(lines) - 1))))


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, line, fence)"""
    rows = df.where(F.col(key).isNotNull()).select(key, F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1).alias("lines"))
    rows = rows.withColumn("spans", _fenced(F.col("lines")))
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("spans", k - 1)["b"])
    parts = F.flatten(F.transform("spans", lambda s, k: F.concat(F.array_repeat(F.lit(0), s["a"] - before(k) - 1), F.array_repeat(k + 1, s["b"] - s["a"] + 1))))
    last = F.when(F.size("spans") == 0, F.lit(-1)).otherwise(F.element_at("spans", -1)["b"])
    rows = rows.withColumn("fences", F.concat(parts, F.array_repeat(F.lit(0), F.size("lines") - 1 - last)))
    return rows.select(key, F.posexplode(F.arrays_zip("lines", "fences")).alias("no", "x")).select(key, "no", F.col("x.lines").alias("line"), F.col("x.fences").alias("fence"))


def block_rows(df: DataFrame, key: str = "document_id", text: str = "text", form: str = "md") -> DataFrame:
    """(key, block_no, text, kind, level, page_no): structural blocks of Markdown in order, or the paragraphs of plain text."""
    none = F.lit(None).cast("int")
    if form == "txt":
        rows = df.where(F.col(key).isNotNull()).select(key, F.posexplode(paragraphs(F.coalesce(text, F.lit("")))).alias("block_no", "text"))
        return rows.select(key, "block_no", "text", F.lit("paragraph").alias("kind"), none.alias("level"), none.alias("page_no"))
    if form != "md":
        raise ValueError(f"no parser for {form!r}")
    by = Window.partitionBy(key).orderBy("no")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.col("fence") == 0
    x = _lines(df, key, text).withColumn("row", open_ & F.col("line").rlike(ROW))
    # a table starts with a row over a rule and takes the rows that follow
    x = x.withColumn("opens", F.col("row") & F.coalesce(F.lead(open_ & F.col("line").rlike(RULE)).over(by), F.lit(False)))
    x = x.withColumn("opened", F.max(F.when(F.col("opens"), F.col("no"))).over(so_far)).withColumn("no row", F.max(F.when(~F.col("row"), F.col("no"))).over(so_far))
    table = F.col("row") & (F.col("opened") > F.coalesce("no row", F.lit(-1)))
    kind = F.when(~open_, "code").when(F.col("line").rlike(HEADING), "heading").when(table, "table").when(F.col("line").rlike(LIST), "list").when(strip(F.col("line")) == "", "blank").otherwise("paragraph")
    x = x.withColumn("own kind", F.coalesce(kind, F.lit("paragraph")))
    # an indented line below a list, or below such a line, belongs to the list
    x = x.withColumn("indented", (F.col("own kind") == "paragraph") & F.col("line").rlike(rf"(?U)^{_S}"))
    above = F.last(F.when(~F.col("indented"), F.col("own kind")), ignorenulls=True).over(so_far)
    x = x.withColumn("kind", F.when(F.col("indented") & (above == "list"), "list").otherwise(F.col("own kind")))
    changes = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(by)) | ~F.col("fence").eqNullSafe(F.lag("fence").over(by))
    x = x.withColumn("changes", changes.cast("int")).withColumn("block_no", F.sum("changes").over(so_far)).where("kind <> 'blank'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda r: r["line"]), "\n")
    found = x.groupBy(key, "block_no", "kind").agg(joined.alias("whole"))
    heading = F.col("kind") == "heading"
    found = found.withColumn("text", strip(F.when(heading, F.regexp_extract("whole", HEADING, 2)).otherwise(F.col("whole"))))
    level = F.when(heading, F.length(F.regexp_extract("whole", HEADING, 1)))
    return found.where("text <> ''").select(key, F.col("block_no").cast("int").alias("block_no"), "text", "kind", level.alias("level"), none.alias("page_no"))


def _chunk_numbers(size: int) -> Column:
    """For each block of a section (array ``bs``) its chunk: a new page or a full one opens the next. A heading alone takes what follows.

    The length of a chunk counts its blocks, not the blank lines between them.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("length"), F.lit(True).alias("alone"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        long, heading = F.length(b["text"]), b["kind"] == "heading"
        opens = (acc["n"] > 0) & (~acc["page"].eqNullSafe(b["page_no"]) | (~acc["alone"] & (acc["length"] + long > size)))
        chunk = acc["chunk"] + opens.cast("int")
        return F.struct(
            (acc["n"] + 1).alias("n"), F.when(opens, long).otherwise(acc["length"] + long).alias("length"), F.when(opens, heading).otherwise(acc["alone"] & heading).alias("alone"),
            b["page_no"].alias("page"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"),
        )

    return F.aggregate("bs", start, step, lambda acc: acc["out"])


def table_pieces(text: Column, size: int) -> Column:
    """Pieces of a table on row borders, each with its header: the first row, and the second if it is a rule. A longer row stands alone."""
    rows = F.split(text, "\n", -1)
    n_head = F.when(F.coalesce(F.get(rows, F.lit(1)).rlike(RULE), F.lit(False)), 2).otherwise(1)
    head = F.array_join(F.slice(rows, F.lit(1), n_head), "\n")
    piece = lambda acc: F.concat(head, F.lit("\n"), acc["held"])
    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        full = F.length(head) + F.length(acc["held"]) + F.length(row) + 2 > size
        more = F.struct(F.coalesce(F.concat(acc["held"], F.lit("\n"), row), row).alias("held"), acc["out"].alias("out"))
        return F.when(full, F.struct(row.alias("held"), F.concat(acc["out"], F.array(piece(acc))).alias("out"))).otherwise(more)

    body = F.slice(rows, n_head + 1, F.greatest(F.size(rows) - n_head, F.lit(0)))
    return F.aggregate(body, start, step, lambda acc: F.when(acc["held"].isNotNull(), F.concat(acc["out"], F.array(piece(acc)))).otherwise(F.array(head)))


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves, each starting with up to ``overlap`` of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next(s for s in separators if not s or s in text)
    finer = separators[separators.index(mark) + 1 :] or ("",)
    parts = [text[k : k + 1] for k in range(len(text))] if not mark else [p + mark for p in text.split(mark)[:-1]] + [text.split(mark)[-1]]
    out, held = [], []
    length = 0
    for p in parts:
        if len(p) > size:
            if held:
                out.append("".join(held))
            out += split_text(p, size, overlap, finer)
            held, length = [], 0
            continue
        if length + len(p) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        out.append("".join(held))
    return [s for s in (p.strip() for p in out) if s]


def draft_rows(blocks: DataFrame, key: str = "document_id", config: RagConfig = RagConfig()) -> DataFrame:
    """(key, seq_no, content, section_path, page_no, chunk_type): chunks of blocks (key, block_no, text, kind, level, page_no), numbered from 1.

    A heading opens a chunk; headings alone make none.
    """
    by = Window.partitionBy(key).orderBy("block_no")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("kind") == "heading"
    x = blocks.withColumn("section", F.sum(heading.cast("int")).over(so_far))
    # of the headings so far the last of each level is open unless one of a lower level follows it
    x = x.select("*", *(F.last(F.when(heading & (F.col("level") == m), F.struct("block_no", "text")), ignorenulls=True).over(so_far).alias(f"h{m}") for m in range(1, LEVELS + 1)))
    after = lambda m: F.greatest(F.lit(-1), *(F.col(f"h{j}.block_no") for j in range(1, m)), F.lit(-1))
    names = F.array_compact(F.array(*(F.when(F.col(f"h{m}.block_no") > after(m), F.col(f"h{m}.text")) for m in range(1, LEVELS + 1))))
    x = x.select(key, "section", F.array_join(names, " > ").alias("path"), F.struct("block_no", "text", "kind", "page_no").alias("b"))
    sections = x.groupBy(key, "section").agg(F.first("path").alias("path"), F.array_sort(F.collect_list("b")).alias("bs"))
    sections = sections.withColumn("chunks", _chunk_numbers(config.chunk_size))
    held = sections.select(key, "section", "path", F.explode(F.arrays_zip("bs", "chunks")).alias("x")).groupBy(key, "section", F.col("x.chunks").alias("chunk"))
    held = held.agg(F.first("path").alias("path"), F.array_sort(F.collect_list("x.bs")).alias("held")).where(F.exists("held", lambda b: b["kind"] != "heading"))

    texts = lambda keep, mark: F.array_join(F.transform(F.filter("held", keep), lambda b: b["text"]), mark)
    is_table = lambda b: b["kind"] == "table"
    kind = F.when(~F.exists("held", is_table), "text").when(F.forall("held", is_table), "table").otherwise("mixed")
    held = held.withColumn("kind", kind).withColumn("whole", texts(lambda b: F.lit(True), "\n\n")).withColumn("page_no", F.get(F.filter("held", lambda b: b["page_no"].isNotNull()), F.lit(0))["page_no"])
    fits = F.length("whole") <= config.chunk_size

    @F.pandas_udf("array<string>")
    def split(longer: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in longer:
            yield s.map(lambda t: None if t is None else split_text(t, config.chunk_size, config.chunk_overlap))

    # all tables are one, behind all that isn't a table
    held = held.withColumn("lead", strip(texts(lambda b: ~is_table(b), "\n\n"))).withColumn("table", texts(is_table, "\n"))
    held = held.withColumn("rows", F.when(~fits & (F.col("kind") != "text"), table_pieces(F.col("table"), max(1, config.chunk_size))))
    held = held.withColumn("texts", split(F.when(~fits & (F.col("kind") == "text"), F.col("whole"))))
    one = lambda c, k: F.struct(c.alias("content"), k.alias("chunk_type"))
    first = one(F.concat_ws("\n\n", F.nullif("lead", F.lit("")), F.get("rows", F.lit(0))), F.col("kind"))
    tables = F.concat(F.array(first), F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: one(r, F.lit("table"))))
    pieces = F.when(fits, F.array(one(F.col("whole"), F.col("kind")))).when(F.col("kind") == "text", F.transform("texts", lambda t: one(t, F.lit("text")))).otherwise(tables)
    out = held.select(key, "section", "chunk", F.nullif("path", F.lit("")).alias("section_path"), "page_no", F.posexplode(pieces).alias("piece", "d"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("section", "chunk", "piece"))
    return out.select(key, number.alias("seq_no"), "d.content", "section_path", "page_no", "d.chunk_type")


def drafts(df: DataFrame, key: str = "document_id", text: str = "text", form: str = "md", config: RagConfig = RagConfig()) -> DataFrame:
    """(key, drafts) of each document: its chunks in order, none for a document without text."""
    rows = draft_rows(block_rows(df, key, text, form), key, config)
    each = F.struct("seq_no", "content", "section_path", "page_no", "chunk_type")
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(each)), lambda d: F.struct(d["content"].alias("content"), d["section_path"].alias("section_path"), d["page_no"].alias("page_no"), d["chunk_type"].alias("chunk_type"))).alias("drafts"))
    return df.where(F.col(key).isNotNull()).select(key).join(lists, key, "left").withColumn("drafts", F.coalesce("drafts", F.array().cast(f"array<{DRAFT}>")))
