"""Findings from registry metadata: age, description, maintainers, links, look-alike names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.schema import FINDING, SEVERITIES
from ..functions.text import stripped
from .similarity import lookalike_findings

# Fixed values.
NEW_DAYS, VERY_NEW_DAYS, MIN_SUMMARY = 30, 7, 10
IDENTITY = ("author", "author_email", "maintainer", "maintainer_email")


def age_days(created: Column, as_of: Column) -> Column:
    """Whole days between, rounded down, so a moment in the future is -1."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(86_400_000_000)).cast("long")


def created_at(text: Column) -> Column:
    """ISO 8601 moment; without an offset it is UTC, and anything else is null."""
    plain = F.regexp_replace(text, "Z$", "+00:00")
    return F.try_to_timestamp(F.when(plain.rlike(r"[+-]\d\d:?\d\d$"), plain).otherwise(F.concat(plain, F.lit("+00:00"))))


def age_severity(days: Column) -> Column:
    return F.when(days <= VERY_NEW_DAYS, F.lit(SEVERITIES["HIGH"])).when(days <= NEW_DAYS, F.lit(SEVERITIES["MEDIUM"]))


def blank(text: Column) -> Column:
    return stripped(F.coalesce(text, F.lit(""))) == ""


def poor_summary(summary: Column) -> Column:
    return F.char_length(stripped(F.coalesce(summary, F.lit("")))) < MIN_SUMMARY


def no_links(project_urls: Column, home_page: Column) -> Column:
    return (F.coalesce(F.size(project_urls), F.lit(0)) <= 0) & blank(home_page)


def checks(packages: DataFrame, as_of: datetime) -> DataFrame:
    """Findings of every package (package_id, metadata struct); a null struct has none.

    ``metadata`` has summary, the four identity fields, home_page, upload_time and project_urls (a map).
    """
    m = lambda f: F.col(f"metadata.{f}")
    days = age_days(created_at(m("upload_time")), F.lit(as_of))
    made = F.concat(F.lit("first published "), F.substr(m("upload_time"), F.lit(1), F.lit(10)))

    def finding(seq: int, when: Column, pattern: str, severity, description: str, evidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(seq).cast("long").alias("finding_seq"), F.lit(pattern).alias("pattern_id"), severity.alias("severity"), F.lit(description).alias("description"), evidence.alias("evidence")))

    fixed = lambda s: F.lit(SEVERITIES[s])
    found = F.array_compact(F.array(
        finding(1, age_severity(days).isNotNull(), "new_package", age_severity(days), "Published only lately", made),
        finding(2, poor_summary(m("summary")), "empty_description", fixed("LOW"), "Hardly any description", F.coalesce(m("summary"), F.lit(""))),
        finding(3, ~F.exists(F.array(*map(m, IDENTITY)), lambda x: ~blank(x)), "no_maintainer", fixed("MEDIUM"), "Nobody is named as author or maintainer", F.lit("")),
        finding(4, no_links(m("project_urls"), m("home_page")), "no_project_urls", fixed("LOW"), "No home page and no project links", F.lit("")),
    ))
    rows = packages.where(F.col("metadata").isNotNull()).select("package_id", F.inline(found))
    return rows.select(
        "package_id", "finding_seq", "pattern_id", F.lit("metadata").alias("category"), "severity", "description", "evidence",
        F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("int").alias("line_number"), F.lit("metadata").alias("layer"),
    )


def analyze(packages: DataFrame, popular: DataFrame, as_of: datetime) -> DataFrame:
    """All metadata findings; packages (package_id, name, metadata) without metadata have none, look-alikes included."""
    known = packages.where(F.col("metadata").isNotNull())
    return lookalike_findings(known.select("package_id", "name"), popular).unionByName(checks(known, as_of)).to(StructType.fromDDL(FINDING))
