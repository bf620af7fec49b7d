"""Requests for packages, from specifier to verdict: one plan in which every row knows how far it came.

Stages: ``answer`` (the registry's), ``choice`` (of a distribution), ``size``, ``download``
(the archive), ``digest``, ``expand``; ``done`` for what was judged. A request that fails in a
stage keeps that stage and an error, and does not reach the next: its archive is not
joined, its digest not computed, nothing of it expanded or scanned. Requests of the same
name and version are fetched once, and each has its row in the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import specifier_name, specifier_version
from ..operators import scoring
from ..sources import registry
from ..sources.rules import Rule
from ..sources.shared import written
from . import orchestrate


@dataclass(frozen=True)
class Batch:
    """``results``: a row for each request; ``errors``: those that failed, with a notice; ``findings`` and ``verdicts`` by package_id."""

    results: DataFrame
    errors: DataFrame
    findings: DataFrame
    verdicts: DataFrame


def failing(df: DataFrame, stage: str, error: Column) -> DataFrame:
    """``df`` with stage and error set where ``error`` says why a row that was sound so far fails."""
    sound = F.col("error").isNull()
    told = df.withColumn("_new", F.when(sound, error))
    return told.withColumns({"stage": F.when(F.col("_new").isNotNull(), F.lit(stage)).otherwise(F.col("stage")), "error": F.coalesce("error", "_new")}).drop("_new")


def requested(requests: DataFrame) -> DataFrame:
    """request_ordinal, spec, name and wanted (the version; null for the latest)."""
    version = specifier_version(F.col("spec"))
    return requests.select("request_ordinal", "spec", specifier_name(F.col("spec")).alias("name"), F.when(version != "", version).alias("wanted"))


def answered(keys: DataFrame, answers: DataFrame) -> DataFrame:
    """``keys`` (name, wanted) with the registry's answer; of several answers to one question the first in order of status and text."""
    own = answers.groupBy(F.lower(F.trim("name")).alias("_name"), F.col("version").alias("_version")).agg(F.min(F.struct("status", "body")).alias("a"))
    found = keys.join(own, (F.col("name") == F.col("_name")) & F.col("wanted").eqNullSafe(F.col("_version")), "left")
    status = F.col("a.status")
    found = registry.answers(found.select("name", "wanted", status.alias("status"), F.when(status < 400, F.col("a.body")).alias("body"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error")))
    refused = registry.fetch_error(F.struct(F.lit(0).alias("size")), F.col("status"))
    found = failing(found, "answer", F.when(F.col("status").isNull(), F.lit("no answer is recorded")).otherwise(refused))
    found = failing(found, "answer", F.when(F.col("answer.info.version").isNull(), F.lit("unreadable answer")))
    return found.withColumn("info", F.col("answer.info")).withColumn("version", F.coalesce("info.version", "wanted"))


def fetched(keys: DataFrame, answers: DataFrame, archives: DataFrame, limit: int = registry.MAX_DOWNLOAD) -> DataFrame:
    """``keys`` with package_id, version, info, file_name, content, stage and error; content only where all is sound."""
    chosen = registry.chosen_file(F.col("answer.urls"), F.col("answer.releases"), F.col("answer.info.version"))
    found = answered(keys, answers).withColumn("file", F.when(F.col("error").isNull(), chosen))
    found = failing(found, "choice", F.when(F.col("file").isNull(), F.lit("no distribution")))
    found = failing(found, "size", registry.fetch_error(F.col("file"), F.lit(200), limit))
    found = found.withColumn("url", F.when(F.col("error").isNull(), F.col("file.url")))
    stored = archives.select(F.col("url").alias("_url"), "content").dropDuplicates(["_url"])
    found = found.join(stored, F.col("url") == F.col("_url"), "left")
    found = failing(found, "download", F.when(F.col("content").isNull(), F.lit("the archive is not there")))
    found = failing(found, "download", F.when(F.octet_length("content") > limit, F.lit("too large; raise the limit to fetch it")))
    found = failing(found, "digest", F.when(~registry.intact(F.col("content"), F.col("file.digests.sha256")), F.lit("the digest differs")))
    package = F.concat("name", F.lit("=="), F.coalesce("wanted", F.lit("")))
    return found.select("name", "wanted", package.alias("package_id"), "version", "info", F.col("file.filename").alias("file_name"), F.when(F.col("error").isNull(), F.col("content")).alias("content"), "stage", "error")


def check(requests: DataFrame, answers: DataFrame, archives: DataFrame, rules: list[Rule], as_of: datetime, limit: int = registry.MAX_DOWNLOAD, popular: DataFrame | None = None) -> Batch:
    """Fetch, expand and judge what is requested.

    ``requests`` has request_ordinal and spec; ``answers`` name, version (null: what the
    registry says of the latest), status and body; ``archives`` url and content.
    """
    wanted = requested(requests)
    packages = written(fetched(wanted.select("name", "wanted").distinct(), answers, archives, limit))
    sound = packages.where("error is null")
    files = written(registry.expand(sound.select("package_id", F.col("name").alias("package_name"), "file_name", "content")))
    refused = files.where("error is not null").select("package_id", F.col("error").alias("refused"))
    outcome = packages.drop("content").join(refused, "package_id", "left")
    outcome = written(failing(outcome, "expand", F.col("refused")).withColumn("stage", F.coalesce("stage", F.lit("done"))).drop("refused"))

    judged_packages = outcome.where("error is null").select("package_id", "name", F.col("info").alias("metadata"))
    findings, verdicts = orchestrate.scan(files.where("error is null"), rules, packages=judged_packages, as_of=as_of, popular=popular)
    own = verdicts.select("package_id", "score", "decision", "decision_name", "n_findings", "n_critical", "summary")
    named = outcome.select("name", "wanted", "package_id", "version", "stage", "error").join(own, "package_id", "left").withColumnRenamed("name", "_name").withColumnRenamed("wanted", "_wanted")
    results = wanted.join(named, (F.col("name") == F.col("_name")) & F.col("wanted").eqNullSafe(F.col("_wanted"))).drop("_name", "_wanted", "wanted")
    failed = results.where("error is not null").select("request_ordinal", "spec", "stage", "error", F.concat(F.lit("skipped "), F.col("spec"), F.lit(": "), F.col("error")).alias("notice"))
    return Batch(results, failed, findings, verdicts)


def worst(batch: Batch) -> DataFrame:
    """One row: the worst decision over all requests, and the exit code."""
    return scoring.worst_decision(batch.results.where("decision is not null"), batch.errors)
