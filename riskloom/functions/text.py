"""Text expressions: decoding, lines, stripping, package specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WHITE = "[\\s\x1c-\x1f]+"


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; malformed ones become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def lines(text: Column) -> Column:
    """Array of (line_no, line), from 1; an empty text has none, and a final break opens no line."""
    parts = F.split(F.regexp_replace(text, f"(?:{LINE_BREAKS})\\z", ""), LINE_BREAKS)
    numbered = F.transform(parts, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    return F.when(text != "", numbered).otherwise(F.array().cast("array<struct<line_no:int,line:string>>"))


def stripped(text: Column) -> Column:
    """Without white space at either end, by the Unicode property and the separators 1C to 1F."""
    return F.regexp_replace(F.regexp_replace(text, f"(?U)^{WHITE}", ""), f"(?U){WHITE}$", "")


def specifier_name(spec: Column) -> Column:
    """Package name of ``name==version``; other operators stay in the name."""
    return F.lower(F.trim(F.get(F.split(spec, "==", 2), F.lit(0))))


def specifier_version(spec: Column) -> Column:
    return F.trim(F.get(F.split(spec, "==", 2), F.lit(1)))


def folded_name(name: Column) -> Column:
    """Lower case, with ``-`` for ``_``."""
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))
