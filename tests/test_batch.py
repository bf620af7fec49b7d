"""Batches of requests: each failure in its stage, order kept, and nothing done for what failed."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from riskloom.plans import batch, made, orchestrate
from riskloom.sources import registry, rules

AS_OF = datetime(2024, 6, 30, tzinfo=UTC)


def tables(spark, kinds):
    rows = spark.createDataFrame([(k, k, "1.0") for k in kinds], "key long, kind int, version string")
    return made.registry_of(rows)


def judged(spark, specs, answers, archives, **more):
    requests = spark.createDataFrame(list(enumerate(specs)), "request_ordinal long, spec string")
    return batch.check(requests, answers, archives, rules.load().rules, AS_OF, **more)


def test_each_error_once_in_the_order_of_requests(spark):
    specs = [f"examplepackage-{k}" for k in range(12, -1, -1)] + ["nobody", "examplepackage-10==7", "EXAMPLEPACKAGE-10 == 1.0 ", "examplepackage-12"]
    done = judged(spark, specs, *tables(spark, range(13)))
    rows = done.results.orderBy("request_ordinal").collect()
    assert [r.spec for r in rows] == specs
    assert [(r.stage, r.error) for r in rows] == [
        ("done", None), ("done", None), ("done", None), ("expand", "unknown kind of archive"), ("expand", "damaged: BadZipFile"), ("expand", "a member leaves the archive"), ("digest", "the digest differs"),
        ("download", "the archive is not there"), ("size", "too large; raise the limit to fetch it"), ("choice", "no distribution"), ("answer", "unreadable answer"), ("answer", "registry answered 503"), ("answer", "not found"),
        ("answer", "no answer is recorded"), ("answer", "no answer is recorded"), ("done", None), ("done", None),
    ]
    assert [r.decision_name for r in rows if r.error is None] == ["BLOCKED", "CAUTION", "SAFE", "SAFE", "BLOCKED"]
    assert all((r.score is None) == (r.error is not None) for r in rows)
    errors = {r.request_ordinal: r.notice for r in done.errors.collect()}
    assert set(errors) == set(range(3, 15)) and errors[13] == "skipped nobody: no answer is recorded"
    assert batch.worst(done).first().asDict() == {"decision": 3, "decision_name": "BLOCKED", "n_packages": 5, "n_errors": 12, "exit_code": 1}


def test_limits_and_empty_batches(spark):
    answers, archives = tables(spark, [10, 4])
    done = judged(spark, ["examplepackage-10", "examplepackage-4", ""], answers, archives, limit=100)
    assert {r.error for r in done.results.collect()} == {"too large; raise the limit to fetch it", "no answer is recorded"}
    raised = judged(spark, ["examplepackage-4"], answers, archives, limit=1 << 30).results.first()
    assert raised.error is None and raised.score == 0
    none = judged(spark, ["x"], answers, archives)
    assert batch.worst(none).first().exit_code == 2  # unknown is not safe
    empty = batch.check(spark.createDataFrame([], "request_ordinal long, spec string"), answers, archives, rules.load().rules, AS_OF)
    assert empty.results.count() == 0 and batch.worst(empty).first().exit_code == 0


def test_a_larger_archive_than_stated_and_doubled_rows(spark):
    answers, archives = tables(spark, [10])
    size = archives.first()
    small = answers.withColumn("body", F.regexp_replace("body", '"size":\\d+', '"size":1'))
    got = judged(spark, ["examplepackage-10"], small, archives, limit=len(size.content) - 1).results.first()
    assert (got.stage, got.error) == ("download", "too large; raise the limit to fetch it")
    doubled = judged(spark, ["examplepackage-10"] * 3, answers.unionByName(answers), archives.unionByName(archives)).results.collect()
    assert [(r.error, r.n_findings) for r in doubled] == [(None, 0)] * 3


def test_nothing_is_done_for_what_failed(spark, monkeypatch):
    answers, archives = tables(spark, range(13))
    keys = batch.requested(spark.createDataFrame([(k, f"examplepackage-{k}") for k in range(13)], "request_ordinal long, spec string")).select("name", "wanted")
    rows = batch.fetched(keys, answers, archives).collect()
    assert {r.name[15:] for r in rows if r.content is not None} == {"7", "8", "9", "10", "11", "12"}
    assert all((r.content is None) == (r.error is not None) for r in rows)


def test_metadata_counts_too(spark):
    answers, archives = tables(spark, [10])
    new = answers.withColumn("body", F.replace("body", F.lit("1990-01-01"), F.lit("2024-06-25")))
    done = judged(spark, ["examplepackage-10"], new, archives)
    assert [r.pattern_id for r in done.findings.collect()] == ["new_package"] and done.results.first().decision_name == "DANGER"


@pytest.fixture
def kept_registry(spark, tmp_path):
    answers, archives = tables(spark, [0, 10, 11, 12])
    for r in answers.collect():
        folder = tmp_path / "answers" / r.name
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{r.version or 'latest'}.{'json' if r.status == 200 else r.status}").write_text(r.body)
    for r in archives.collect():
        path = tmp_path / "archives" / r.url
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(r.content)
    return tmp_path


def test_check_from_the_command(spark, kept_registry, capsys):
    root = str(kept_registry)
    assert orchestrate.check(spark, ["examplepackage-12==1.0", "examplepackage-0", "examplepackage-10"], root, registry.MAX_DOWNLOAD) == 1
    said = capsys.readouterr().out
    assert said.index("== examplepackage-12==1.0") < said.index("skipped examplepackage-0: not found") < said.index("== examplepackage-10==")
    assert "BLOCKED" in said and "SAFE" in said
    assert orchestrate.check(spark, ["examplepackage-10"], root, registry.MAX_DOWNLOAD) == 0
    assert orchestrate.check(spark, ["examplepackage-0"], root, registry.MAX_DOWNLOAD) == 2
    body = json.loads((kept_registry / "answers" / "examplepackage-10" / "latest.json").read_text())
    assert body["urls"][0]["digests"]["sha256"]
