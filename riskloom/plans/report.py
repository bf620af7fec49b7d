"""Findings and verdicts as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import decision_name, severity_name
from ..operators.order import numbered

#: Findings in one part of a report that is written in parts.
PART_LINES = 1000

ADVICE = {2: "Read the code before you use it.", 3: "Do not install it."}


def location(source_file: Column, line_number: Column, layer: Column) -> Column:
    """``file:line``, ``file`` (no line, or line 0), or the layer."""
    named = F.coalesce(source_file, F.lit("")) != ""
    return F.when(named & (F.coalesce(line_number, F.lit(0)) != 0), F.concat(source_file, F.lit(":"), line_number.cast("string"))).when(named, source_file).otherwise(layer)


def finding_line(f) -> Column:
    return F.concat(F.lit("["), severity_name(f["severity"]), F.lit("] "), f["pattern_id"], F.lit(" at "), location(f["source_file"], f["line_number"], f["layer"]))


def closing() -> Column:
    """Score, summary and advice of a verdict."""
    advice = F.coalesce(*(F.when(F.col("decision") == k, F.lit("\n" + v)) for k, v in ADVICE.items()), F.lit(""))
    return F.concat(F.lit("score "), F.col("score").cast("string"), F.lit("/100 "), F.col("decision_name"), F.lit("\n"), F.col("summary"), advice)


def reports(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """package_id and report: head, findings from the most severe down, score, summary, advice.

    A package's own report lists all its findings, so it is as long as they are; ``report_parts`` writes long ones in pieces.
    """
    rows = findings.select("package_id", F.struct((-F.col("severity")).alias("rank"), "finding_seq", finding_line({c: F.col(c) for c in findings.columns}).alias("line")).alias("x"))
    listed = rows.groupBy("package_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    both = verdicts.join(listed, "package_id", "left")
    body = F.coalesce(F.array_join(F.transform("x", lambda f: f["line"]), "\n"), F.lit("no findings"))
    text = F.concat(F.lit("== "), F.col("package_id").cast("string"), F.lit("\n"), body, F.lit("\n"), closing())
    return both.select("package_id", text.alias("report"))


def report_parts(verdicts: DataFrame, findings: DataFrame, lines: int = PART_LINES) -> DataFrame:
    """package_id, part and text: a package's report in pieces of at most ``lines`` findings, which many tasks write.

    Joined by line breaks in order of ``part``, they are the text of ``reports``: part 0 is the head,
    then come the findings, and the last part has score, summary and advice. No task holds
    more than one part of a package, however many findings it has.
    """
    order = [F.col("package_id"), F.desc("severity"), F.col("finding_seq"), F.col("pattern_id"), F.col("source_file"), F.col("line_number")]
    placed = numbered(findings, order)
    first = placed.groupBy("package_id").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    rows = placed.join(first, "package_id").select("package_id", F.floor((F.col("position") - F.col("first")) / lines + 1).cast("long").alias("part"), "position", finding_line({c: F.col(c) for c in findings.columns}).alias("line"))
    listed = rows.groupBy("package_id", "part").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("x"))  # ``lines`` rows
    body = listed.select("package_id", "part", F.array_join(F.transform("x", lambda f: f["line"]), "\n").alias("text"))
    known = verdicts.join(first.select("package_id", "n"), "package_id", "left")
    bare = F.when(F.col("n").isNull(), F.lit("\nno findings")).otherwise(F.lit(""))
    head = known.select("package_id", F.lit(0).cast("long").alias("part"), F.concat(F.lit("== "), F.col("package_id").cast("string"), bare).alias("text"))
    last = known.select("package_id", F.ceil(F.coalesce("n", F.lit(0)) / lines + 1).cast("long").alias("part"), closing().alias("text"))
    return head.unionByName(body).unionByName(last)


def skipped(errors: DataFrame) -> DataFrame:
    """A notice for each package that could not be judged (package_id, error)."""
    return errors.select("package_id", F.concat(F.lit("skipped "), F.col("package_id").cast("string"), F.lit(": "), F.col("error")).alias("notice"))


def regression_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_total"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


def playbook_table(results: DataFrame) -> DataFrame:
    """package_id and line: one line of the table of results for each package."""
    mark = F.when(F.col("passed"), F.lit("pass")).otherwise(F.lit("FAIL"))
    got = F.coalesce(decision_name(F.col("decision")), F.lit("not judged"))
    return results.select("package_id", F.concat(mark, F.lit("  "), F.rpad("package_id", 24, " "), F.lit("expected "), decision_name(F.col("expected_decision")), F.lit(", got "), got).alias("line"))
