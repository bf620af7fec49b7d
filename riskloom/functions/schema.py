"""Types, thresholds and small expressions that every part of the engine shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities (their gaps matter, since weights are summed) and decisions.
SEVERITIES = {"LOW": 10, "MEDIUM": 20, "HIGH": 40, "CRITICAL": 80}
DECISIONS = ("SAFE", "CAUTION", "DANGER", "BLOCKED")

# Highest score of each decision but the last.
DECISION_BOUNDS = (15, 35, 60)

# Fixed values of the score.
BREADTH_FACTOR, BREADTH_CAP = 0.15, 2.0
DIMINISH, COUNTED_PER_CATEGORY = 0.3, 3
NON_CRITICAL_CAP = 60

# Fixed values of the scans.
MAX_FILE_BYTES = 1_048_576
REGEX_SUFFIXES = (".py", ".pyx", ".pyi")
AST_SUFFIXES = (".py", ".pyx")
TEST_FOLDERS = ("tests", "test", "testing", "test_utils", "testutils")
PRIORITY_FILES = ("setup.py", "setup.cfg", "__init__.py", "conftest.py")

FINDING = (
    "package_id string, finding_seq long, pattern_id string, category string, severity int, description string, "
    "evidence string, source_file string, line_number int, layer string"
)


def severity_of(name: Column) -> Column:
    """Weight of a severity name, whatever its case and outer space; null if there is no such name."""
    clean = F.lower(F.trim(name))
    return F.coalesce(*(F.when(clean == k.lower(), F.lit(v)) for k, v in SEVERITIES.items()))


def severity_name(weight: Column) -> Column:
    return F.coalesce(*(F.when(weight == v, F.lit(k)) for k, v in SEVERITIES.items()))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def decision_of(score: Column) -> Column:
    """0 to 3, from a score within 0 to 100."""
    out = F.lit(len(DECISION_BOUNDS))
    for rank, bound in reversed([*enumerate(DECISION_BOUNDS)]):
        out = F.when(score <= bound, F.lit(rank)).otherwise(out)
    return out


def decision_name(decision: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DECISIONS)), decision + 1)


def demoted(weight: Column) -> Column:
    """One severity lower, LOW at least."""
    order = list(SEVERITIES.values())
    out = F.lit(order[0])
    for low, high in zip(order, order[1:], strict=False):
        out = F.when(weight == high, F.lit(low)).otherwise(out)
    return out


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)).isin(*suffixes)


def regex_severity(weight: Column, path: Column) -> Column:
    """Severity in its place: lower in test folders, doubled (80 at most) in setup.py."""
    in_setup = (file_name(path) == "setup.py") & (weight < SEVERITIES["CRITICAL"])
    return F.when(is_test_path(path), demoted(weight)).when(in_setup, F.least(weight * 2, F.lit(80))).otherwise(weight)


def ast_severity(weight: Column, path: Column) -> Column:
    return F.when(is_test_path(path), demoted(weight)).otherwise(weight)
