"""Trees with files that cannot be read, damaged archives, split logs, and a registry's answers."""

import io
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators import ast_scan
from riskloom.plans import made, orchestrate
from riskloom.sources import files, registry, rules

STARTS = "import subprocess\nsubprocess.run(x)\n"


@pytest.fixture
def hostile(tmp_path):
    """A package whose setup.py matters, among things that cannot be read."""
    root = tmp_path / "acme"
    (root / "pkg").mkdir(parents=True)
    (root / "setup.py").write_text(STARTS)
    (root / "pkg" / "fine.py").write_text("value = 1\n")
    (root / "pkg" / "gone.py").symlink_to(root / "nothing.py")
    (root / "pkg" / "out.py").symlink_to("/etc/hostname")
    os.mkfifo(root / "pkg" / "pipe.py")
    (root / "pkg" / "large.py").write_text("x = 1\n" * 200_000)
    return root


@pytest.mark.parametrize("name", ["", "acme"])
def test_scan_finds_top_level_files_and_goes_on_after_bad_ones(spark, hostile, capsys, name):
    assert orchestrate.main(spark, str(hostile), name) == 1
    said = capsys.readouterr()
    assert said.out.startswith("acme unknown") and "setup_py_exec at setup.py:1" in said.out and "BLOCKED" in said.out
    for path in ("pkg/gone.py", "pkg/out.py", "pkg/pipe.py"):
        assert f"{path} was not read: not a regular file" in said.err
    assert "large" not in said.err and "fine" not in said.err


def test_findings_of_one_severity_are_listed_by_path_and_traces_count(spark, tmp_path, capsys):
    for path in ("z.py", "b/__init__.py", "a.py", "b/c.py"):
        target = tmp_path / "acme" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("subprocess.run(x)\n")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "acme.log").write_text('execve("/opt/bad", ["bad"]) = 0\n')
    (tmp_path / "logs" / "other.log").write_text('execve("/opt/worse", ["bad"]) = 0\n')
    orchestrate.main(spark, str(tmp_path / "acme"), traces=str(tmp_path / "logs"))
    said = capsys.readouterr().out.splitlines()
    assert [x.rsplit(" ", 1)[-1] for x in said if "subprocess_spawn" in x] == ["b/__init__.py:1", "a.py:1", "b/c.py:1", "z.py:1"]
    assert sum("runtime_subprocess" in x for x in said) == 1 and not any(x.startswith("== other") for x in said)


def test_playbooks_with_recorded_runs(spark, tmp_path, capsys):
    (tmp_path / "acme").mkdir()
    (tmp_path / "acme" / "__init__.py").write_text("value = 1\n")
    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "acme.log").write_text('openat(AT_FDCWD, "/tmp/h/.ssh/id_rsa", O_RDONLY) = 3\n')
    (tmp_path / "expected.csv").write_text("package_id,expected_decision\nacme,3\n")
    assert orchestrate.run_playbooks(spark, str(tmp_path)) == 0
    assert orchestrate.run_playbooks(spark, str(tmp_path), skip_sandbox=True) == 1


def test_each_folder_as_a_package(spark, hostile, capsys):
    assert orchestrate.main(spark, str(hostile.parent), each=True) == 1
    assert "== acme" in capsys.readouterr().out
    (hostile.parent / "loose.py").write_text("value = 1")
    got = {(r.package_id, r.rel_path, r.error) for r in files.read_tree(spark, str(hostile.parent)).collect()}
    assert got >= {(files.LOOSE, "loose.py", None), ("acme", "setup.py", None), ("acme", "pkg/pipe.py", "not a regular file")} and len(got) == 6


def test_a_clean_package_without_files_is_judged(spark, tmp_path, capsys):
    assert orchestrate.main(spark, str(tmp_path), "nothing") == 0
    assert "== nothing\nno findings\nscore 0/100 SAFE" in capsys.readouterr().out


def test_files_that_go_or_grow_after_they_were_listed(tmp_path):
    path = tmp_path / "a.py"
    path.write_text("x = 1")
    reader = files.TreeReader(str(tmp_path), files.SUFFIXES, "p")
    (part,) = reader.partitions()
    path.write_bytes(b"x" * (files.MAX_FILE_BYTES + 1))
    assert list(reader.read(part)) == [("p", "p", "a.py", None, "grew beyond the limit")]
    path.unlink()
    assert list(reader.read(part)) == [("p", "p", "a.py", None, "No such file or directory")]
    path.symlink_to("/etc/hostname")
    assert next(iter(reader.read(part)))[3] is None


def test_user_rules_from_the_command(spark, tmp_path, capsys, monkeypatch):
    from riskloom import __main__ as command

    own = tmp_path / "rules"
    own.mkdir()
    (own / "x.toml").write_text('id = "own"\ncategory = "x"\nseverity = "critical"\ndescription = "d"\n[detection]\n[[detection.rules]]\npattern = "value = 1"\n')
    (own / "bad.toml").write_text("nonsense")
    monkeypatch.setattr(command, "USER_RULES", tmp_path / "none")
    found = command.catalogue([str(own)])
    assert found[-1].pattern_id == "own" and len(found) == len(rules.load().rules) + 1 and "bad.toml is no rule" in capsys.readouterr().err
    monkeypatch.setattr(command, "USER_RULES", own)
    assert command.catalogue([])[-1].pattern_id == "own"


def expanded(spark, rows):
    archives = spark.createDataFrame([(i, i, n, None if c is None else bytearray(c)) for i, n, c in rows], "package_id string, package_name string, file_name string, content binary")
    return {(r.package_id, r.rel_path, None if r.content is None else bytes(r.content), r.size, r.error) for r in registry.expand(archives).collect()}


def test_every_damage_to_an_archive_is_told(spark):
    rng = random.Random(5)
    data = rng.randbytes(3000)
    rows = []
    for kind, name in (("zip", "a.zip"), ("tar", "a.tar.gz")):
        out = io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("pkg/a.py", data)
        else:
            with tarfile.open(fileobj=out, mode="w:gz") as t:
                info = tarfile.TarInfo("pkg/a.py")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        whole = out.getvalue()
        rows.append((f"{kind} whole", name, whole))
        for k in range(150):
            at = rng.randrange(len(whole))
            rows.append((f"{kind} {k}", name, whole[:at] + bytes([whole[at] ^ (1 << rng.randrange(8))]) + whole[at + 1 :]))
        rows += [(f"{kind} cut {k}", name, whole[: len(whole) * k // 10]) for k in range(10)]
    got = expanded(spark, rows)
    # a changed bit may lie where it does not matter, such as a time; what is given is then the content itself
    assert {c for i, _, c, _, e in got if e is None} == {data} and {i for i, *_ in got} == {i for i, *_ in rows}
    assert sum(e is not None for *_, e in got) > 250 and all(e is None for i, *_, e in got if "whole" in i)
    assert all(e is not None for i, *_, e in got if "cut" in i)


def test_files_come_in_bounded_batches_and_bombs_are_refused(spark, monkeypatch):
    many = made.packed("a.tar.gz", [(f"top/pkg/m{k}.py", b"x = 1\n" * 50) for k in range(400)])
    large = made.packed("a.zip", [("pkg/large.py", b"x" * (files.MAX_FILE_BYTES + 1)), ("small.py", b"y")])
    monkeypatch.setattr(registry, "BATCH_BYTES", 4000)
    got = expanded(spark, [("many", "a.tgz", many), ("large", "a.whl", large), ("null", "a.zip", None)])
    assert len([r for r in got if r[0] == "many"]) == 400 and ("many", "pkg/m399.py", b"x = 1\n" * 50, 300, None) in got
    assert {r[1:4] for r in got if r[0] == "large"} == {("pkg/large.py", None, files.MAX_FILE_BYTES + 1), ("small.py", b"y", 1)}
    monkeypatch.setattr(registry, "MAX_EXPANDED", 10_000)
    assert registry.examined("a.tgz", many) == (None, "too much inside")
    monkeypatch.setattr(registry, "MAX_MEMBERS", 3)
    assert registry.examined("a.zip", made.packed("a.zip", [(f"m{k}.py", b"") for k in range(4)]))[1] == "too much inside"


LINES = ["", "x", "é line", "connect(3, ...)", "a long line " * 9, " "]


def test_line_numbers_of_split_logs(spark, tmp_path):
    rng = random.Random(3)
    known = {}
    for name in ("one", "two+x y", "short", "empty"):
        n = {"short": 3, "empty": 0}.get(name, 2500)
        known[name] = [rng.choice(LINES) for _ in range(n)]
        (tmp_path / f"{name}.log").write_bytes("".join(x + rng.choice(["\n", "\r\n"]) for x in known[name]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = files.read_traces(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r.package_id, r.line_no, r.line) for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == {(p, i, x) for p, own in known.items() for i, x in enumerate(own, 1) if x}


def test_logs_in_folders_of_packages(spark, tmp_path):
    rows = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c")], "package_id long, line string")
    rows.coalesce(1).write.partitionBy("package_id").text(str(tmp_path / "logs"))
    assert sorted((r.package_id, r.line_no, r.line) for r in files.read_traces(spark, str(tmp_path / "logs")).collect()) == [("7", 1, "a"), ("7", 2, "b"), ("8", 1, "c")]


@pytest.fixture
def answers(tmp_path):
    for name in ("alpha", "beta", "gamma"):
        folder = tmp_path / "answers" / name
        folder.mkdir(parents=True)
        for version in ("latest", "1.0", "2.0"):
            (folder / f"{version}.json").write_text(f'{{"info": {{"version": "{version}"}}}}')
    (tmp_path / "answers" / "delta").mkdir()
    (tmp_path / "answers" / "delta" / "latest.404").write_text("")
    return str(tmp_path)


def test_answers_and_filters(spark, answers, tmp_path):
    every = registry.read_answers(spark, answers)
    assert every.count() == 10
    assert {(r.version, r.status) for r in every.where("name = 'delta'").collect()} == {(None, 404)}
    assert {r.version for r in every.where("name in ('alpha', 'beta') and version = '1.0'").collect()} == {"1.0"}
    assert every.where("name = 'alpha' and name = 'beta'").count() == 0 and every.where("name = '../answers/alpha'").count() == 0
    assert every.where("name = 'alpha' and status = 404").count() == 0 and every.where("version is null").count() == 4
    with pytest.raises(NotADirectoryError):
        registry.read_answers(spark, str(tmp_path / "answers"))


def test_filters_reach_the_listing(answers):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = registry.AnswerReader(answers)
    assert len(list(reader.listed())) == 10
    assert list(reader.pushFilters([In(("name",), ("alpha", "nobody")), GreaterThan(("status",), 3)])) == [GreaterThan(("status",), 3)]
    assert len(list(reader.listed())) == 3
    assert list(reader.pushFilters([EqualTo(("version",), "2.0")])) == []
    assert [x[:2] for x in reader.listed()] == [("alpha", "2.0")] and len(reader.partitions()) == 1


def test_evidence_comes_with_the_issue():
    found, error = ast_scan.issues_of("if x:\r\n\n   exec(y)  # run\n")
    assert error is None and [(i["line"], i["evidence"]) for i in found] == [(3, "exec(y)  # run")]


def test_evidence_crosses_without_lines(spark):
    source = spark.createDataFrame([("p", "acme", "a.py", "exec(x)\n" + "y = 1\n" * 1000)], "package_id string, package_name string, rel_path string, content string")
    found = ast_scan.issues(source)
    assert found.columns == ["package_id", "package_name", "rel_path", "issues", "error"]
    assert found.select(F.col("issues")[0]["evidence"]).first()[0] == "exec(x)"
