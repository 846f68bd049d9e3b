"""The block parser and the chunker over Python lists, one document at a time: what the DataFrame ones are compared with."""

from __future__ import annotations

import re

from orrery.operators.chunking import split_text

#: Line forms of Markdown.
FENCE, HEADING, LIST = re.compile(r"^\s*(```|~~~)"), re.compile(r"^(#{1,6})\s+(.*)$"), re.compile(r"^\s*(?:[-*+]|[0-9]+[.)])\s+")
ROW, RULE = re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$")


def _kind(line: str, following: str) -> str:
    if FENCE.match(line):
        return "code"
    if HEADING.match(line):
        return "heading"
    if ROW.match(line) and RULE.match(following):
        return "table"
    if LIST.match(line):
        return "list"
    return "blank" if not line.strip() else "paragraph"


def markdown_blocks(text: str | None) -> list[dict]:
    """Blocks in order. Fences win over headings, tables, lists and paragraphs; an open fence runs to the end."""
    lines = re.sub(r"\r\n?", "\n", text or "").split("\n")
    out, at = [], 0
    while at < len(lines):
        kind, end = _kind(lines[at], lines[at + 1] if at + 1 < len(lines) else ""), at + 1
        if kind == "heading":
            m = HEADING.match(lines[at])
            if m[2].strip():
                out.append({"text": m[2].strip(), "kind": kind, "level": len(m[1])})
            at = end
            continue
        if kind == "code":
            mark = FENCE.match(lines[at])[1]
            while end < len(lines) and not lines[end].strip().startswith(mark):
                end += 1
            end += 1
        elif kind == "table":
            while end < len(lines) and ROW.match(lines[end]):
                end += 1
        elif kind != "blank":
            while end < len(lines):
                now = _kind(lines[end], lines[end + 1] if end + 1 < len(lines) else "")
                if now != kind and not (kind == "list" and now == "paragraph" and lines[end][:1].isspace()):
                    break
                end += 1
        body = "\n".join(lines[at:end]).strip()
        if body and kind != "blank":
            out.append({"text": body, "kind": kind, "level": None})
        at = end
    return [b | {"page_no": None} for b in out]


def split_table(text: str, size: int) -> list[str]:
    """Pieces of a table on row borders, each with its header; a longer row stands alone."""
    rows = text.split("\n")
    head = rows[: 2 if len(rows) > 1 and RULE.match(rows[1]) else 1]
    out, held = [], []
    for row in rows[len(head) :]:
        if held and len("\n".join([*head, *held, row])) > size:
            out.append("\n".join([*head, *held]))
            held = []
        held.append(row)
    return [*out, "\n".join([*head, *held])] if held or not out else out


def chunk(blocks: list[dict], size: int, overlap: int) -> list[dict]:
    """Chunk drafts. A heading opens a chunk, a new page or a full buffer closes it; headings alone make none.

    The length of a buffer counts its blocks, not the blank lines between them.
    """
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    held: list[dict] = []
    path = ""

    def flush() -> None:
        if any(b["kind"] != "heading" for b in held):
            out.extend(_drafts(held, path, size, overlap))
        held.clear()

    for b in blocks:
        alone = all(x["kind"] == "heading" for x in held)
        if b["kind"] == "heading":
            flush()
            while stack and stack[-1][0] >= b["level"]:
                stack.pop()
            stack.append((b["level"], b["text"]))
            path = " > ".join(t for _, t in stack)
        elif held and (b["page_no"] != held[-1]["page_no"] or (not alone and sum(len(x["text"]) for x in held) + len(b["text"]) > size)):
            flush()
        held.append(b)
    flush()
    return out


def _drafts(held: list[dict], path: str, size: int, overlap: int) -> list[dict]:
    kinds = {b["kind"] for b in held if b["kind"] != "heading"}
    kind = "text" if "table" not in kinds else "table" if kinds == {"table"} and len(held) == len([b for b in held if b["kind"] == "table"]) else "mixed"
    page = next((b["page_no"] for b in held if b["page_no"] is not None), None)
    draft = lambda content, kind: {"content": content, "section_path": path or None, "page_no": page, "chunk_type": kind}
    whole = "\n\n".join(b["text"] for b in held)
    if len(whole) <= size:
        return [draft(whole, kind)]
    if kind == "text":
        return [draft(p, kind) for p in split_text(whole, size, overlap)]
    # all tables are one, behind all that isn't a table
    lead = "\n\n".join(b["text"] for b in held if b["kind"] != "table").strip()
    pieces = split_table("\n".join(b["text"] for b in held if b["kind"] == "table"), max(1, size))
    first = f"{lead}\n\n{pieces[0]}" if lead else pieces[0]
    return [draft(first, kind), *(draft(p, "table") for p in pieces[1:])]
