"""The rule catalogue: TOML files, checked on the driver, later ones over earlier ones of the same id.

Catalogues are small configuration, so they live on the driver and become literal
expressions; ``catalogue_table`` shows one as a DataFrame.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import SEVERITIES

BUILTIN = Path(__file__).parent.parent / "rules"

#: Where a user keeps rules; the command reads it if it is there.
USER_RULES = Path.home() / ".riskloom" / "rules"
REQUIRED = ("id", "category", "severity", "description", "detection")


@dataclass(frozen=True)
class Rule:
    pattern_id: str
    category: str
    severity: int
    description: str
    type: str = "regex"
    target: str = "source"
    rules: tuple[dict, ...] = ()
    file_scope: tuple[str, ...] = ()
    expected_for: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


@dataclass
class Catalogue:
    rules: list[Rule] = field(default_factory=list)
    rejects: list[tuple[str, str]] = field(default_factory=list)


def scope_of(raw) -> tuple[str, ...]:
    if isinstance(raw, str):
        return (raw,) if raw else ()
    return tuple(str(x) for x in raw) if isinstance(raw, list) else ()


def rule_of(raw: dict) -> Rule:
    """A checked rule; ValueError says what is wrong with it."""
    if missing := [k for k in REQUIRED if k not in raw]:
        raise ValueError(f"without {', '.join(missing)}")
    detection = raw["detection"]
    if not isinstance(detection, dict):
        raise ValueError("detection is no table")
    weight = SEVERITIES.get(str(raw["severity"]).strip().upper())
    if weight is None:
        raise ValueError(f"unknown severity {raw['severity']}")
    return Rule(
        str(raw["id"]), str(raw["category"]), weight, str(raw["description"]), detection.get("type", "regex"), detection.get("target", "source"),
        tuple(detection.get("rules", [])), scope_of(detection.get("file_scope")), tuple(raw.get("expected_for", [])), tuple(raw.get("tags", [])),
    )


def load(extra: Iterable[str | Path] = (), builtin: bool = True) -> Catalogue:
    """Rules of the built-in folder, then of ``extra`` ones. The last of an id counts, at the place of the first."""
    found, kept = Catalogue(), {}
    for folder in (*([BUILTIN] if builtin else []), *map(Path, extra)):
        for path in sorted(p for p in folder.rglob("*") if p.suffix.lower() == ".toml" and p.is_file()):
            try:
                rule = rule_of(tomllib.loads(path.read_text("utf-8")))
            except ValueError as wrong:  # TOML and UTF-8 errors are ValueErrors too
                found.rejects.append((str(path), str(wrong)))
            else:
                kept[rule.pattern_id] = rule
    found.rules = list(kept.values())
    return found


def last_wins(rules: DataFrame) -> DataFrame:
    """The same for a table of rules with load_seq: the last row of each pattern_id, and ``ordinal``, its first load_seq."""
    order = Window.partitionBy("pattern_id")
    ranked = rules.withColumns({"rank": F.row_number().over(order.orderBy(F.desc("load_seq"))), "ordinal": F.min("load_seq").over(order)})
    return ranked.where("rank = 1").drop("rank", "load_seq")


def catalogue_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.pattern_id, r.category, r.severity, r.description, r.type, r.target, list(r.file_scope), list(r.expected_for), list(r.tags), [x.get("pattern") for x in r.rules]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ordinal int, pattern_id string, category string, severity int, description string, type string, target string, file_scope array<string>, expected_for array<string>, tags array<string>, patterns array<string>")


# What Java's expressions and Python's mean alike, once names of groups are respelt.
ELSEWHERE = re.compile(r"\(\?P=|\(\?\(|\\Z|\(\?<[=!]")


def java_pattern(pattern: str, spark: SparkSession) -> str | None:
    """The pattern for Spark's regular expressions, or None if only Python's have it. ValueError: it is invalid."""
    try:
        re.compile(pattern)
    except re.error as wrong:
        raise ValueError(str(wrong)) from None
    if ELSEWHERE.search(pattern):
        return None
    java = "(?iu)" + pattern.replace("(?P<", "(?<")
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # Java's own syntax error
        return None
    return java
