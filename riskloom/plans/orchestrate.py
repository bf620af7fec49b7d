"""Whole scans: static, metadata and trace findings of many packages in one plan."""

from __future__ import annotations

import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.schema import FINDING
from ..operators import ast_scan, metadata, regex_scan, scoring, trace
from ..operators.similarity import POPULAR
from ..sources.files import CANARIES
from ..sources.rules import Rule, load
from ..sources.shared import written


def static_findings(files: DataFrame, rules: list[Rule]) -> DataFrame:
    return scoring.dedup_static(regex_scan.scan(files, rules).unionByName(ast_scan.scan(files, rules)))


def all_findings(files: DataFrame, rules: list[Rule], packages: DataFrame | None = None, lines: DataFrame | None = None, as_of: datetime | None = None, popular: DataFrame | None = None) -> DataFrame:
    """Findings of all layers that there is input for: static, then metadata, then sandbox."""
    layers, kind = [static_findings(files, rules)], StructType.fromDDL(FINDING)
    if packages is not None and "metadata" in packages.columns:
        if as_of is None:
            raise ValueError("metadata checks need as_of")
        if popular is None:
            popular = files.sparkSession.createDataFrame([(n,) for n in POPULAR], "name string")
        layers.append(metadata.analyze(packages, popular, as_of))
    if lines is not None:
        layers.append(trace.parse(lines, list(CANARIES)))
    out = None
    for rank, layer in enumerate(layers):
        ordered = layer.withColumns({"package_id": F.col("package_id").cast("string"), "finding_seq": F.col("finding_seq") + rank * 10_000_000}).to(kind)
        out = ordered if out is None else out.unionByName(ordered)
    return out


def scan(files: DataFrame, rules: list[Rule] | None = None, **inputs) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts of all packages that ``files`` or ``packages`` name."""
    found = all_findings(files, rules or load().rules, **inputs)
    known = files.select(F.col("package_id").cast("string"))
    if inputs.get("packages") is not None:
        known = known.unionByName(inputs["packages"].select(F.col("package_id").cast("string")))
    return found, scoring.verdicts(found, known)


def layer_status(packages: DataFrame, files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """package_id and whether each layer had any input: what was never looked at is not the same as clean."""
    ids = lambda df, name: df.select(F.col("package_id").cast("string")).distinct().withColumn(name, F.lit(True))
    out = packages.select(F.col("package_id").cast("string"), F.col("metadata").isNotNull().alias("has_metadata") if "metadata" in packages.columns else F.lit(False).alias("has_metadata"))
    out = out.join(ids(files, "has_source"), "package_id", "left")
    out = out.join(ids(lines, "has_trace"), "package_id", "left") if lines is not None else out.withColumn("has_trace", F.lit(False))
    return out.na.fill(False, ["has_source", "has_trace"])


def main(spark: SparkSession, root: str, name: str = "", version: str = "unknown", each: bool = False, rules: list[Rule] | None = None, traces: str | None = None) -> int:
    """Scan a folder, print the reports and what could not be read, and give the exit code.

    All of the folder is one package of this name (the folder's own by default); with
    ``each``, every folder in it is a package. ``traces`` has logs of recorded runs, named
    by package. Findings of one severity are listed by path.
    """
    from ..operators.order import in_order
    from ..sources.files import read_traces, read_tree
    from .report import reports

    name = name or os.path.basename(os.path.abspath(root.removeprefix("file://")))
    files = written(read_tree(spark, root, package=None if each else name))
    for row in files.where("error is not null").orderBy("package_id", "rel_path").toLocalIterator():
        print(f"Warning: {row.package_id}: {row.rel_path} was not read: {row.error}", file=sys.stderr)
    sound = files.where("error is null")
    known = sound.select("package_id") if each else spark.createDataFrame([(name,)], "package_id string")
    found = in_order(all_findings(sound, rules or load().rules, lines=read_traces(spark, traces) if traces else None))
    judged = written(scoring.verdicts(found, known))
    found = found.join(judged, "package_id", "left_semi")  # logs of other packages are not asked for
    if not each:
        print(f"{name} {version}")
    for row in reports(judged, found).orderBy("package_id").toLocalIterator():
        print(row.report)
    return scoring.worst_decision(judged).first().exit_code


def check(spark: SparkSession, specs: list[str], registry_root: str, limit: int, as_of: datetime | None = None, rules: list[Rule] | None = None) -> int:
    """Judge packages from a copy of a registry (``registry.read_answers``, ``registry.read_archives``), print reports in the order of requests, and give the exit code."""
    from ..sources.registry import read_answers, read_archives
    from . import batch
    from .report import reports

    requests = spark.createDataFrame(list(enumerate(specs)), "request_ordinal long, spec string")
    names = [r.name for r in batch.requested(requests).select("name").distinct().collect()]  # as many as were typed
    answers = read_answers(spark, registry_root).where(F.col("name").isin(names))
    done = batch.check(requests, answers, read_archives(spark, registry_root), rules or load().rules, as_of or datetime.now(UTC), limit)
    results = written(done.results)
    texts = reports(done.verdicts, done.findings)
    for row in results.join(texts, "package_id", "left").orderBy("request_ordinal").toLocalIterator():
        print(f"skipped {row.spec}: {row.error}" if row.error else row.report)
    return scoring.worst_decision(results.where("decision is not null"), results.where("error is not null")).first().exit_code


def run_playbooks(spark: SparkSession, root: str, skip_sandbox: bool = False) -> int:
    """Scan the folders that ``root/expected.csv`` (package_id, expected_decision) names, print the table of results; 0 if all pass.

    Logs of recorded runs in ``root/traces`` count too, unless ``skip_sandbox``.
    """
    from ..sources.files import read_traces, read_tree
    from .report import playbook_table, regression_summary

    expected = spark.read.csv(f"{root}/expected.csv", header=True, schema="package_id string, expected_decision int")
    lines = read_traces(spark, f"{root}/traces") if os.path.isdir(f"{root.removeprefix('file://')}/traces") and not skip_sandbox else None
    files = written(read_tree(spark, root).where("error is null"))
    results = written(scoring.regression(scan(files, lines=lines)[1], expected))
    for row in playbook_table(results).orderBy("package_id").toLocalIterator():
        print(row.line)
    total = regression_summary(results).first()
    print(f"{total.n_passed} of {total.n_total} passed")
    return 0 if total.all_passed else 1
