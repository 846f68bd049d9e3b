"""Scalar text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What counts as an identifier, a word, a number.
IDENTIFIER = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+"
LATIN, DIGITS, CJK = r"[A-Za-z]{2,}", r"[0-9]{2,}", r"[一-鿿]{2,}"


def like_escaped(keyword: str) -> str:
    """A LIKE pattern that matches the keyword literally."""
    for c in ("\\", "%", "_"):
        keyword = keyword.replace(c, "\\" + c)
    return f"%{keyword}%"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, blank ones dropped."""
    parts = F.split(F.regexp_replace(c, r"\r\n?", "\n"), r"\n[ \t]*\n(?:[ \t]*\n)*")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once a row, however often it is used; within a lambda it would be for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def keywords(c: Column, limit: int = 8) -> Column:
    """Search terms by priority: identifiers, Latin words, numbers, CJK pairs; each once whatever its case."""
    if limit <= 0:
        return F.array().cast("array<string>")
    text = F.coalesce(c, F.lit(""))
    rest = F.regexp_replace(text, IDENTIFIER, " ")
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    pairs = F.flatten(F.transform(every(rest, CJK), lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda k: F.substring(run, k, F.lit(2)))))
    terms = F.concat(every(text, IDENTIFIER), every(rest, LATIN), every(rest, DIGITS), pairs)
    first = lambda t, low: F.transform(F.slice(F.array_distinct(low), 1, limit), lambda x: F.get(t, F.array_position(low, x).cast("int") - 1))
    return once(terms, lambda t: once(F.transform(t, F.lower), lambda low: first(t, low)))


def embedding_text(path: Column, content: Column) -> Column:
    return F.when(F.length(path) > 0, F.concat(path, F.lit("\n"), content)).otherwise(content)


def clipped(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def table_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))


def title(c: Column, default: str = "New conversation") -> Column:
    return F.coalesce(F.nullif(F.substring(c, 1, 50), F.lit("")), F.lit(default))


def extension(c: Column) -> Column:
    """What follows the last dot of the last path segment, in lower case."""
    return F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))


def fusion_key(vector_id: Column, own_id: Column) -> Column:
    return F.lower(F.replace(F.coalesce(F.nullif(vector_id, F.lit("")), own_id), F.lit("-"), F.lit("")))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of name, as 32 hexadecimal digits."""
    digits = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(digits, 1, 12), F.lit("5"), F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
