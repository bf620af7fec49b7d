import io
import tarfile
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from riskloom.functions import schema as S
from riskloom.functions import text as T
from riskloom.operators import ast_scan, metadata, regex_scan, scoring, similarity, trace
from riskloom.plans import orchestrate, report
from riskloom.sources import files, registry, rules
from riskloom.streaming.traces import stream_accesses

AS_OF = datetime(2024, 6, 30, tzinfo=UTC)


def findings(spark, rows):
    data = [(p, i, f"k{i}", c, s, "", "", None, None, "static") for i, (p, c, s) in enumerate(rows)]
    return spark.createDataFrame(data, S.FINDING)


@pytest.mark.parametrize("value, score, decision", [(0, 0, 0), (15, 15, 0), (16, 16, 1), (35, 35, 1), (36, 36, 2), (60, 60, 2), (61, 61, 3), (100, 100, 3), (150, 100, 3), (-5, 0, 0)])
def test_score_bounds(spark, value, score, decision):
    clamped = S.clamp(F.lit(value))
    assert tuple(spark.range(1).select(clamped, S.decision_of(clamped)).first()) == (score, decision)


def test_scores_half_even_caps_and_empty_packages(spark):
    rows = [("one", "a", 80), ("cap", "a", 40), ("cap", "b", 40), ("cap", "c", 40), ("half", "a", 20), ("half", "b", 20), ("many", "a", 10), ("many", "a", 10), ("many", "a", 10), ("many", "a", 10)]
    packages = spark.createDataFrame([("one",), ("cap",), ("half",), ("many",), ("none",)], "package_id string")
    got = {r.package_id: r for r in scoring.verdicts(findings(spark, rows), packages).collect()}
    assert got["one"].score == 92 and got["one"].decision_name == "BLOCKED"
    assert got["cap"].score == 60  # nothing critical
    assert got["half"].score == round(40 * 1.3) == 52
    assert got["many"].score == round(16 * 1.15)  # the fourth counts for nothing
    assert got["none"].score == 0 and got["none"].summary == "Nothing suspicious was found."
    assert scoring.verdicts(findings(spark, [("x", "a", 20), ("x", "b", 20), ("x", "b", 10), ("x", "b", 10), ("x", "a", 10)][:4])).first().score == round(46 * 1.3)


def test_worst_of_an_empty_batch_and_errors(spark):
    none = scoring.verdicts(findings(spark, []))
    assert scoring.worst_decision(none).first().decision == 0
    failed = spark.createDataFrame([("a", "not found")], "package_id string, error string")
    assert scoring.worst_decision(none, failed).first().exit_code == 2  # unknown is not safe
    assert report.skipped(failed).first().notice == "skipped a: not found"


def test_dedup_keeps_most_severe_at_first_place(spark):
    rows = [("p", 5, "k", "c", 20, "", "later", "f", 1, "static"), ("p", 3, "k", "c", 20, "", "first", "f", 2, "static"), ("p", 9, "k", "c", 40, "", "worst", "f", 3, "static"), ("p", 4, "k", "c", 10, "", "no file", None, None, "static")]
    got = {r.evidence: r.finding_seq for r in scoring.dedup_static(spark.createDataFrame(rows, S.FINDING)).collect()}
    assert got == {"worst": 3, "no file": 4}


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc\n\n", "a\x0bb\x0cc\x1cd\x85e f ", "\n"])
def test_lines_as_python_splits_them(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.lines(F.col("t")).alias("l")).first().l
    assert [x.line for x in got] == text.splitlines() and [x.line_no for x in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("data", [b"plain", "é".encode(), b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98\x80!"])
def test_decoding_replaces_bad_bytes(spark, data):
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(T.decoded(F.col("b")).alias("t")).first().t
    assert got == data.decode("utf-8", "replace")


def test_strip_and_specifiers(spark):
    got = spark.createDataFrame([("  \tx y\x1c\n", " Name == 1.0 ")], "a string, b string").select(T.stripped(F.col("a")), T.specifier_name(F.col("b")), T.specifier_version(F.col("b"))).first()
    assert tuple(got) == ("x y", "name", "1.0")


def source(spark, name, path, text, package="acme"):
    return spark.createDataFrame([("p", package, path, bytearray(text.encode()))], "package_id string, package_name string, rel_path string, content binary")


def test_regex_rules(spark):
    catalogue = rules.load().rules
    found = lambda *a, **k: [(r.pattern_id, r.severity, r.line_number) for r in regex_scan.scan(source(spark, *a, **k), catalogue).collect()]
    assert found("p", "pkg/a.py", "x\nsubprocess.run(a)\n") == [("subprocess_spawn", 20, 2)]
    assert found("p", "pkg/tests/a.py", "subprocess.run(a)") == [("subprocess_spawn", 10, 1)]
    assert sorted(found("p", "setup.py", "subprocess.run(a)")) == [("setup_py_exec", 80, 1), ("subprocess_spawn", 40, 1)]
    assert found("p", "pkg/a.py", "requests.post(u)", package="Requests") == []
    assert found("p", "pkg/a.txt", "subprocess.run(a)") == [] and found("p", "pkg/a.py", "x = 1") == []
    # an earlier pattern in a later line comes before a later pattern
    assert found("p", "pkg/a.py", "os.system(a)\nsubprocess.run(a)") == [("subprocess_spawn", 20, 2)]


def test_patterns_that_only_python_has(spark):
    own = [rules.Rule("twice", "c", 20, "", rules=({"pattern": r"(?P<w>\w+) (?P=w)\Z"}, {"pattern": "("}))]
    assert [r.line_number for r in regex_scan.scan(source(spark, "p", "a.py", "one two\ntwo two\n"), own).collect()] == [2]


def test_catalogue_overrides_and_rejects(spark, tmp_path):
    good = 'id = "dns_exfiltration"\ncategory = "x"\nseverity = " Low "\ndescription = "d"\n[detection]\nfile_scope = "a.py"\nrules = []\n'
    (tmp_path / "a.TOML").write_text(good)
    (tmp_path / "b.toml").write_text("not toml")
    (tmp_path / "c.toml").write_text(good.replace("Low", "dreadful"))
    (tmp_path / "d.toml").mkdir()
    built, own = rules.load(), rules.load([tmp_path])
    assert len(own.rejects) == 2 and [r.pattern_id for r in own.rules] == [r.pattern_id for r in built.rules]
    changed = next(r for r in own.rules if r.pattern_id == "dns_exfiltration")
    assert (changed.severity, changed.file_scope, changed.type) == (10, ("a.py",), "regex")
    assert rules.catalogue_table(spark, built.rules).count() == len(built.rules) >= 10


@pytest.mark.parametrize("text, expected", [
    ("exec(x)", [("dynamic_exec", "exec")]), ("exec('x')", []), ("exec(f'{x}')", []), ("exec(code=x)", []), ("a[0].compile(x)", [("dynamic_exec", "compile")]), ("re.compile(x)", []),
    ("b64decode('x')", []), ("exec('x'); b64decode('y')", [("decode_exec_chain", "b64decode")]), ("base64.b64decode(x); exec('')", []), ("__import__(x)", [("dynamic_import", "__import__")]), ("def (", []), ("\0", []),
])
def test_syntax_trees(text, expected):
    assert [(i["type"], i["function"]) for i in ast_scan.issues_of(text)[0]] == expected


def test_metadata(spark):
    kind = "struct<summary:string,author:string,author_email:string,maintainer:string,maintainer_email:string,home_page:string,upload_time:string,project_urls:map<string,string>>"
    good = ("a good summary", "me", None, None, None, "https://example.org", "2020-01-01T00:00:00Z", None)
    rows = [("good", "quite-unlike", good), ("none", "requestss", None), ("typo", "reqests", good), ("new", "unlike-too", (*good[:6], "2024-06-25T00:00:00+02:00", None)), ("future", "unlike-three", (*good[:6], "2024-07-09T00:00:00", None)), ("poor", "unlike-four", ("  ", "", " ", None, "", " ", "nonsense", {}))]
    packages = spark.createDataFrame(rows, f"package_id string, name string, metadata {kind}")
    popular = spark.createDataFrame([(n,) for n in similarity.POPULAR], "name string")
    got = {(r.package_id, r.pattern_id, r.severity) for r in metadata.analyze(packages, popular, AS_OF).collect()}
    assert got == {("typo", "typosquatting", 80), ("new", "new_package", 40), ("future", "new_package", 40), ("poor", "empty_description", 10), ("poor", "no_maintainer", 20), ("poor", "no_project_urls", 10)}


def test_lookalikes_on_both_paths(spark, monkeypatch):
    names = spark.createDataFrame([(n,) for n in ["numpi", "nump", "NumPy", "nunpi", "abc", "numpyxyz", "py_yaml", "django1", None]], "name string")
    popular = spark.createDataFrame([(n,) for n in ["numpy", "numpi2", "pyyaml", "django"]], "name string")
    near = {r.name: (r.similar, r.distance) for r in similarity.closest_popular(names, popular).collect()}
    assert near == {"numpi": ("numpi2", 1), "nump": ("numpy", 1), "nunpi": ("numpi2", 2), "py_yaml": ("pyyaml", 1), "django1": ("django", 1)}
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 0)
    assert {r.name: (r.similar, r.distance) for r in similarity.closest_popular(names, popular).collect()} == near


LOG = '''openat(AT_FDCWD, "/tmp/h/.aws/credentials", O_RDONLY) = 3
openat(AT_FDCWD, "/tmp/h/.aws/credentials", O_RDONLY) = 3
connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("10.1.2.3")}, 16) = -1
connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("127.0.0.1")}, 16) = 0
execve("/usr/bin/python3", ["python3"]) = 0
execve("/opt/bad", ["bad"]) = 0
open("/etc/hosts") = 3'''


def test_traces_from_files_and_streams(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "acme.log").write_text(LOG)
    lines = files.read_traces(spark, str(tmp_path / "logs"))
    got = [(r.package_id, r.pattern_id, r.evidence, r.line_number) for r in trace.parse(lines, list(files.CANARIES)).orderBy("line_number").collect()]
    assert got == [("acme", "honeypot_access", ".aws/credentials", 1), ("acme", "runtime_network_connect", "10.1.2.3:443", 3), ("acme", "runtime_subprocess", "/opt/bad", 6)]
    lines.select("package_id", F.lit(AS_OF).alias("ts"), "line").write.parquet(str(tmp_path / "stream"))
    streamed = spark.readStream.schema("package_id string, ts timestamp, line string").parquet(str(tmp_path / "stream"))
    q = stream_accesses(streamed).writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.value for r in spark.table("seen").collect()} == {x[2] for x in got}


def tar(names):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = 3
            t.addfile(info, io.BytesIO(b"x=1"))
    return out.getvalue()


def zipped(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x=1")
    return out.getvalue()


def test_archives(spark):
    rows = [("a", "a.tar.gz", tar(["a-1/setup.py", "a-1/a/__init__.py"])), ("b", "b.whl", zipped(["b/x.py", "meta/y"])), ("c", "c.tgz", tar(["c/../../x"])), ("d", "d.zip", zipped(["/etc/x"])), ("e", "e.rar", b""), ("f", "f.zip", b"broken")]
    archives = spark.createDataFrame([(i, i, n, bytearray(c)) for i, n, c in rows], "package_id string, package_name string, file_name string, content binary")
    got = {(r.package_id, r.rel_path, r.error is not None) for r in registry.expand(archives).collect()}
    assert got == {("a", "setup.py", False), ("a", "a/__init__.py", False), ("b", "b/x.py", False), ("b", "meta/y", False), ("c", None, True), ("d", None, True), ("e", None, True), ("f", None, True)}


PLAYBOOKS = {  # inert texts of our own, and the least decision for each
    "clean": ("clean/__init__.py", "value = 1\n", 0),
    "sends": ("sends/__init__.py", "import requests\nrequests.post(url, data=everything)\n", 1),
    "spawns": ("spawns/__init__.py", "import subprocess\nsubprocess.run(cmd)\n", 1),
    "hides": ("hides/__init__.py", "import subprocess\nexec(blob)\nsubprocess.call(x)\n", 2),
    "steals": ("steals/__init__.py", "key = open(home + '/.ssh/id_rsa').read()\n", 3),
    "installs": ("setup.py", "import subprocess\nsubprocess.run(['x'])\n", 3),
}


def test_playbooks_from_a_folder(spark, tmp_path):
    for name, (path, text, _) in PLAYBOOKS.items():
        target = tmp_path / "tree" / name / path
        target.parent.mkdir(parents=True)
        target.write_text(text)
        (target.parent / "notes.txt").write_text("subprocess.run(x)")
    tree = files.read_tree(spark, str(tmp_path / "tree"))
    assert sorted(r.rel_path for r in tree.collect()) == sorted(p for p, _, _ in PLAYBOOKS.values())
    _, judged = orchestrate.scan(tree)
    expected = spark.createDataFrame([(n, d) for n, (_, _, d) in PLAYBOOKS.items()], "package_id string, expected_decision int")
    results = scoring.regression(judged, expected)
    assert report.regression_summary(results).first().asDict() == {"n_passed": 6, "n_total": 6, "all_passed": True}
    assert orchestrate.main(spark, str(tmp_path / "tree")) == 1
    with pytest.raises(NotADirectoryError):
        orchestrate.main(spark, str(tmp_path / "nothing"))


def test_playbook_runner_and_one_package(spark, tmp_path, capsys):
    for name, (path, text, _) in PLAYBOOKS.items():
        target = tmp_path / name / path
        target.parent.mkdir(parents=True)
        target.write_text(text)
    rows = "".join(f"{n},{d}\n" for n, (_, _, d) in PLAYBOOKS.items())
    (tmp_path / "expected.csv").write_text("package_id,expected_decision\n" + rows)
    assert orchestrate.run_playbooks(spark, str(tmp_path)) == 0
    said = capsys.readouterr().out
    assert said.count("pass") == 7 and "6 of 6 passed" in said
    (tmp_path / "expected.csv").write_text("package_id,expected_decision\nclean,3\n")
    assert orchestrate.run_playbooks(spark, str(tmp_path)) == 1
    assert "FAIL" in capsys.readouterr().out
    assert orchestrate.main(spark, str(tmp_path / "clean"), "clean", "1.0") == 0
    assert capsys.readouterr().out.startswith("clean 1.0")


def test_command_line(capsys):
    from riskloom.__main__ import run

    assert run(["version"]) == 0 and run([]) == 0
    assert capsys.readouterr().out.startswith("riskloom ")


def test_many_files_in_several_parts(spark, tmp_path, monkeypatch):
    for k in range(40):
        target = tmp_path / f"p{k % 7}" / "_inner" / f"_f{k}.PY"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"x = {k}\n")
    (tmp_path / "loose.py").write_text("")
    monkeypatch.setattr(files, "PART_BYTES", 200_000)
    reader = files.TreeReader(str(tmp_path), files.SUFFIXES)
    assert len(reader.partitions()) > 5
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 41 and {r[0] for r in rows} == {files.LOOSE, *(f"p{k}" for k in range(7))} and {r[2][:9] for r in rows} == {"loose.py", "_inner/_f"}
    assert files.read_tree(spark, str(tmp_path)).count() == 41
    assert [r[:3] for r in files.TreeReader(str(tmp_path), (".py",), "one").read(reader.partitions()[0])][0] == ("one", "one", "loose.py")
    (tmp_path / "empty").mkdir()
    assert files.TreeReader(str(tmp_path / "empty"), files.SUFFIXES).partitions()[0].value == []


def test_layers_that_had_no_input(spark):
    packages = spark.createDataFrame([("p", None), ("q", "m")], "package_id string, metadata string")
    got = {r.package_id: (r.has_metadata, r.has_source, r.has_trace) for r in orchestrate.layer_status(packages, source(spark, "p", "a.py", "x")).collect()}
    assert got == {"p": (False, True, False), "q": (True, False, False)}


def test_canaries(spark):
    assert [r.ordinal for r in files.canaries(spark).orderBy("ordinal").collect()] == list(range(len(files.CANARIES)))
