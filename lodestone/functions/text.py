"""Text functions as column expressions. Offsets are 0-based code points and spans half-open, as everywhere in this library."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The chunks that literal search works on, and the lengths of a literal.
CHUNK, OVERLAP, SHORTEST, LONGEST = 8000, 200, 3, 200


def mask(text: Column) -> Column:
    """Every character but line ends as a space; the length stays."""
    return F.regexp_replace(text, "[^\\r\\n  ]", " ")


def mask_matches(text: Column, opening: str, pattern: str) -> Column:
    """text with the matches of a pattern masked, where each begins with the literal `opening`. The length stays."""
    first = re.escape(opening[0])
    parts = F.regexp_extract_all(text, F.lit(f"(?s){pattern}|[^{first}]+|{first}"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith(opening) & (F.length(x) > len(opening)), mask(x)).otherwise(x)), "")


def markdown_escape(text: Column) -> Column:
    """Markup characters as character references, line ends as spaces."""
    for c in "&<>|[]`\\":
        text = F.replace(text, F.lit(c), F.lit(f"&#{ord(c)};"))
    return F.translate(text, "\r\n", "  ")


def canonical(*parts: Column) -> Column:
    """A SHA-256 over parts that no choice of values can make ambiguous: each has its length before it, null has none."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]), 256)


def lines(text: Column) -> Column:
    """array<struct<line, start, end>>: 1-based numbers and spans of the lines, without their ends."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.length(x))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda done, n: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)) + 1, F.lit(0)) + n))
    return F.zip_with(F.transform(ends, lambda e, i: F.struct((i + 1).alias("line"), e.alias("end"))), sizes, lambda e, n: F.struct(e["line"].alias("line"), (e["end"] - n).alias("start"), e["end"].alias("end")))


def occurrences(text: Column, literal: Column) -> Column:
    """array<int>: where a literal occurs, from the left and without overlap. Case counts. An empty literal occurs nowhere."""
    quoted = F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    sizes = F.transform(F.split(text, quoted, -1), lambda x: F.length(x))
    found = F.aggregate(
        F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))),
        F.array().cast("array<int>"),
        lambda done, n: F.array_append(done, n + F.coalesce(F.try_element_at(done, F.lit(-1)) + F.length(literal), F.lit(0))),
    )
    return F.when((F.length(literal) > 0) & F.contains(text, literal), found).otherwise(F.array().cast("array<int>"))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<struct<start, text>>: parts from every `size` characters, each `overlap` longer. An empty text has one."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size + overlap)).alias("text")))


def owned(chunk_text: Column, literal: Column, size: int = CHUNK) -> Column:
    """Occurrences that a chunk owns: those that begin in its first `size` characters."""
    return F.filter(occurrences(chunk_text, literal), lambda at: at < size)


def fixed3(x: Column) -> Column:
    """A number with three decimals."""
    return F.format_string("%.3f", x)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of an offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """The 1-based column of an offset in its line."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def clamped(end: Column, text: Column) -> Column:
    """A span's end, inside its text."""
    return F.least(end, F.length(text))


def remaining(deadline: Column, now: Column) -> Column:
    """What is left of a budget, never below zero."""
    return F.greatest(F.lit(0), deadline - now)


def truncated(items: Column, most: int = 100) -> Column:
    """struct<items, reason>: the first `most` items, and page_budget where there were more."""
    return F.struct(F.slice(items, 1, most).alias("items"), F.when(F.size(items) > most, "page_budget").alias("reason"))
