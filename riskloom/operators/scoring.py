"""Findings to verdicts: deduplication, scores, decisions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import (
    BREADTH_CAP, BREADTH_FACTOR, COUNTED_PER_CATEGORY, DIMINISH, NON_CRITICAL_CAP, SEVERITIES, clamp, decision_name, decision_of,
)


def dedup_static(findings: DataFrame) -> DataFrame:
    """One finding of each package, pattern and file: the most severe, of equals the first; its place is the group's first.

    An aggregate, not a window: partial results leave a hot group one row from each task.
    """
    best = F.max_by(F.struct(*(c for c in findings.columns if c != "finding_seq")), F.struct("severity", (-F.col("finding_seq")).alias("early")))
    grouped = findings.groupBy(F.col("package_id").alias("p"), F.col("pattern_id").alias("k"), F.col("source_file").alias("f"))
    out = grouped.agg(best.alias("x"), F.min("finding_seq").alias("finding_seq"))
    return out.select(*(F.col("finding_seq") if c == "finding_seq" else F.col(f"x.{c}") for c in findings.columns))


def category_sums(findings: DataFrame) -> DataFrame:
    """package_id, category, base (the first finding whole, the next two diminished), n and n_critical.

    Findings are counted by severity first, so even a package with a third of all rows shuffles a few.
    """
    counted = findings.groupBy("package_id", "category", "severity").agg(F.count("*").alias("n"))
    tops = F.sort_array(F.collect_list(F.struct("severity", "n")), asc=False)
    grouped = counted.groupBy("package_id", "category").agg(
        tops.alias("tops"), F.max("severity").alias("top"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("severity") == SEVERITIES["CRITICAL"], F.col("n"))), F.lit(0)).alias("n_critical")
    )

    def take(acc, x):
        n = F.least(acc["left"], x["n"])
        return F.struct((acc["left"] - n).alias("left"), (acc["total"] + n * x["severity"]).alias("total"))

    start = F.struct(F.lit(COUNTED_PER_CATEGORY).cast("long").alias("left"), F.lit(0).cast("long").alias("total"))
    counted_sum = F.aggregate("tops", start, take, lambda acc: acc["total"])
    return grouped.select("package_id", "category", (F.col("top") + (counted_sum - F.col("top")) * DIMINISH).alias("base"), "n", "n_critical")


def summary_of(decision: Column, n: Column, n_critical: Column) -> Column:
    several = F.when(n == 1, F.lit(" finding")).otherwise(F.lit(" findings"))
    counted = F.concat(n.cast("string"), several, F.lit(", "), n_critical.cast("string"), F.lit(" critical"))
    return (
        F.when(n == 0, F.lit("Nothing suspicious was found."))
        .when(decision == 0, F.concat(F.lit("Minor traits only: "), counted, F.lit(".")))
        .when(decision == 1, F.concat(F.lit("Look before you install: "), counted, F.lit(".")))
        .when(decision == 2, F.concat(F.lit("Likely harmful: "), counted, F.lit(".")))
        .otherwise(F.concat(F.lit("Keep it out: "), counted, F.lit(".")))
    )


def verdicts(findings: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """package_id, score, decision, decision_name, n_findings, n_critical, n_categories and summary.

    With ``packages`` (package_id), those without findings are SAFE with score 0.
    """
    grouped = category_sums(findings).groupBy("package_id").agg(
        F.sum("base").alias("base"), F.count("*").alias("n_categories"), F.sum("n").alias("n_findings"), F.sum("n_critical").alias("n_critical")
    )
    if packages is not None:
        grouped = packages.select("package_id").distinct().join(grouped, "package_id", "left")
        grouped = grouped.na.fill(0, ["n_categories", "n_findings", "n_critical"]).na.fill(0.0, ["base"])
    raw = F.col("base") * F.least(F.lit(1.0) + F.col("n_categories") * BREADTH_FACTOR, F.lit(BREADTH_CAP))
    capped = F.when(F.col("n_critical") == 0, F.least(raw, F.lit(float(NON_CRITICAL_CAP)))).otherwise(raw)
    out = grouped.withColumn("score", clamp(F.bround(capped).cast("int"))).withColumn("decision", decision_of(F.col("score")))
    return out.select(
        "package_id", "score", "decision", decision_name(F.col("decision")).alias("decision_name"), "n_findings", "n_critical", "n_categories",
        summary_of(F.col("decision"), F.col("n_findings"), F.col("n_critical")).alias("summary"),
    )


def worst_decision(found: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: the worst decision of a batch, SAFE if it is empty, and the exit code.

    Packages that could not be judged make the exit code 2 unless a verdict is worse; they never count as safe.
    """
    out = found.agg(F.coalesce(F.max("decision"), F.lit(0)).alias("decision"), F.count("*").alias("n_packages"))
    failed = errors.agg(F.count("*").alias("n_errors")) if errors is not None else out.select(F.lit(0).cast("long").alias("n_errors")).limit(1)
    code = F.when(F.col("decision") >= 2, F.lit(1)).when(F.col("n_errors") > 0, F.lit(2)).otherwise(F.lit(0))
    return out.crossJoin(failed).select("decision", decision_name(F.col("decision")).alias("decision_name"), "n_packages", "n_errors", code.alias("exit_code"))


def meets(expected: Column, actual: Column) -> Column:
    """SAFE must be exact; anything else must be reached."""
    return F.when(expected == 0, actual == 0).otherwise(actual >= expected)


def regression(found: DataFrame, expected: DataFrame) -> DataFrame:
    """package_id, expected_decision, decision, passed; only packages of both sides."""
    both = expected.select("package_id", "expected_decision").join(found.select("package_id", "decision"), "package_id")
    return both.withColumn("passed", meets(F.col("expected_decision"), F.col("decision")))
