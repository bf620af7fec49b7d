"""Regular-expression rules over source files, folded into literal expressions: no join with the catalogue."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import MAX_FILE_BYTES, PRIORITY_FILES, REGEX_SUFFIXES, file_name, has_suffix, regex_severity
from ..functions.text import decoded, lines, stripped
from ..sources.rules import Rule, java_pattern

#: Patterns that are folded into one expression; more would not be compiled.
FOLDED_PATTERNS = 100

#: Anchors and lookarounds see line ends, so a test of the whole text first would miss matches.
LINE_BOUND = re.compile(r"[\^$]|\\[AZzbB]|\(\?[=!<]")


def readable(files: DataFrame, suffixes: tuple[str, ...], most_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Source files by suffix and size, as package_id, package_name, rel_path and text.

    ``files`` has package_id, package_name, rel_path and content (binary or string).
    ``most_bytes`` None takes files of any size.
    """
    kept = files.where(has_suffix(F.col("rel_path"), suffixes))
    kept = kept if most_bytes is None else kept.where(F.octet_length("content") <= most_bytes)
    return kept.select("package_id", "package_name", "rel_path", decoded(F.col("content")).alias("text"))


def applies(rule: Rule, package_name: Column, rel_path: Column) -> Column:
    """Not expected for the package, and the file's name is in scope if there is one."""
    out = F.lit(True)
    if rule.expected_for:
        out = out & ~F.coalesce(F.lower(package_name).isin(*(n.lower() for n in rule.expected_for)), F.lit(False))
    if rule.file_scope:
        out = out & file_name(rel_path).isin(*rule.file_scope)
    return out


def python_match(rows: Column, pattern: str) -> Column:
    """(line_no, line) of the first line that Python's expression finds, for patterns that Java's cannot say."""

    @F.pandas_udf("struct<line_no:int,line:string>")
    def match(own: pd.Series) -> pd.DataFrame:
        search = re.compile(pattern, re.IGNORECASE).search
        hits = [next(((x["line_no"], x["line"]) for x in (r if r is not None else ()) if search(x["line"])), (None, None)) for r in own]
        return pd.DataFrame(hits, columns=["line_no", "line"])

    return match(rows)


def first_match(patterns: list[tuple[str, str | None]], text: Column) -> Column:
    """(line_no, line) of the first pattern that matches anywhere, in its first line: pattern order before line order.

    A text is cut into lines only once a pattern is known to match somewhere in it.
    """
    tried = []
    for python, java in patterns:
        if java is None:
            hit = python_match(lines(text), python)
            tried.append(F.when(hit["line_no"].isNotNull(), hit))
            continue
        hit = F.get(F.filter(lines(text), has(java)), F.lit(0))
        tried.append(hit if LINE_BOUND.search(python.replace(r"\b", "")) else F.when(text.rlike(java), hit))
    return F.coalesce(*tried)


def has(java: str):
    return lambda x: x["line"].rlike(java)


def scan(files: DataFrame, rules: list[Rule], most_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Findings of regex rules: at most one for each rule and file. Large catalogues go through an automaton (``literal_scan``)."""
    spark = files.sparkSession
    active = [r for r in rules if r.type == "regex" and r.target == "source"]
    if sum(len(r.rules) for r in active) > FOLDED_PATTERNS:
        from . import literal_scan

        return literal_scan.scan(files, rules, most_bytes)
    parts = []
    for ordinal, rule in enumerate(active):
        patterns = []
        for p in (x.get("pattern") for x in rule.rules):
            try:
                patterns += [(p, java_pattern(p, spark))] if p else []
            except ValueError:
                continue  # an invalid expression takes only itself out
        if not patterns:
            continue
        hit = F.when(applies(rule, F.col("package_name"), F.col("rel_path")), first_match(patterns, F.col("text")))

        # an array of one: so the match is looked for once, however many of its fields are read
        parts.append(F.transform(F.array_compact(F.array(hit)), finding_of(rule, ordinal)))
    source = readable(files, REGEX_SUFFIXES, most_bytes)
    if not parts:
        parts = [F.array().cast("array<struct<ordinal:bigint,pattern_id:string,category:string,severity:int,description:string,evidence:string,line_number:int>>")]
    found = source.select("package_id", "rel_path", F.inline(F.flatten(F.array(*parts))))
    return found.select(
        "package_id", scan_order(F.col("rel_path"), F.col("ordinal")).alias("finding_seq"), "pattern_id", "category", "severity", "description", "evidence",
        F.col("rel_path").alias("source_file"), "line_number", F.lit("static").alias("layer"),
    )


def finding_of(rule: Rule, ordinal: int):
    """The finding of a rule, from the (line_no, line) that it matches."""
    return lambda h: F.struct(
        F.lit(ordinal).cast("long").alias("ordinal"), F.lit(rule.pattern_id).alias("pattern_id"), F.lit(rule.category).alias("category"),
        regex_severity(F.lit(rule.severity), F.col("rel_path")).alias("severity"), F.lit(rule.description).alias("description"),
        stripped(h["line"]).alias("evidence"), h["line_no"].cast("int").alias("line_number"),
    )


def scan_order(rel_path: Column, ordinal: Column) -> Column:
    """A sequence number that puts files that matter most first, then catalogue order; only for listing."""
    first = file_name(rel_path).isin(*PRIORITY_FILES)
    return F.when(first, F.lit(0)).otherwise(F.lit(1)).cast("long") * 1_000_000 + ordinal
