"""Large catalogues, distributed ranks, reports in parts, and layers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import schema as S
from riskloom.operators import literal_scan, order, regex_scan, scoring
from riskloom.plans import layers, report
from riskloom.sources import rules

PATTERNS = [
    r"subprocess\.(run|call)", r"ab+c", r"a?bcd", r"(ab|cd)ef", r"(?:ab|c)?xyz", r"[abc]de", r"ab{2,3}c", r"ab{0,3}cd", r"ab{,2}cd", r"x{y", r"a{}b", r"\bkey\s*=", r"^ab$", r"a.c", r"(?P<q>['\"])ab(?P=q)", r"(ab)\1cd", r"(?i)ABC", r"ab(?#no)*cd",
    r"(?=ab)abc", r"(?<!x)abc", r"(?!ab)xcd", r"\x61\x62cd", r"abcd", r"s[^]]k", r"[]a]bc", r"[\]a]bc", r"(((ab))|((cd)))+", r"(ab|)cd", r"|ab", r"ab|cd|", r"Éab", r"is{1}k", r"\.env", r"a\|b", r"(ab){0}cd", r"(?:a(?:b|c)d){2}", r"a\Zb|ks", r"a*?bc", r"a++bc", r"(?>ab)c",
    r"\N{LATIN SMALL LETTER A}bc", r"\141bc", r"a\
b",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_hold_a_literal(pattern):
    found = literal_scan.literals_of(pattern)
    rng = random.Random(pattern)
    parts = [*"abcdxyzk sS=.'\"|]{}éÉKſıİ", *re.findall(r"[A-Za-z.]+", pattern), *"abcd", "ef", "ab", "cd", "run", *pattern]
    search = re.compile(pattern, re.IGNORECASE).search
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        if search(text):
            assert found is None or any(x in literal_scan.folded(text) for x in found)


def test_literals_are_found_where_there_are_some():
    of = lambda p: set(literal_scan.literals_of(p) or ())
    assert of(r"subprocess\.(run|call)\s*\(") == {"subprocess."} and of(r"(load_dotenv|dotenv_values)\s*\(") == {"load_dotenv", "dotenv_values"}
    assert of(r"a?bcd") == {"bcd"} and of(r"x(?:one|three)?y.") == set() and of("(?x) a b") == set() and of("KKab") == {"ab"}
    assert all(of(x["pattern"]) for r in rules.load().rules for x in r.rules if "pattern" in x)


def made_files(spark, n=60):
    rng = random.Random(4)
    lines = ["import subprocess", "  subprocess.run(cmd)", "OS.SYSTEM(x)", "key = open(home + '/.ſsh/id_rsa')", "with open('.env') as f:", "requests.post(u, data=d)", "x = 1", "", "dns.resolver.query(n)", "ctypes.CDLL(x)", "İmport socKet", "one two two"]
    rows = [(str(k), rng.choice(["acme", "Requests", None]), rng.choice(["pkg/a.py", "setup.py", "tests/b.pyx", "notes.txt", "pkg/c.pyi"]), rng.choice(["\n", "\r\n", "\x0c"]).join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(n)]
    return spark.createDataFrame([*rows, ("null", "acme", "a.py", None), ("empty", "acme", "a.py", "")], "package_id string, package_name string, rel_path string, content string").repartition(3)


def test_the_automaton_finds_what_expressions_find(spark):
    own = [rules.Rule("twice", "c", 20, "", rules=({"pattern": r"(?P<w>\w+) (?P=w)"}, {"pattern": "("})), rules.Rule("any", "c", 10, "", rules=({"pattern": "."},)), rules.Rule("none", "c", 10, ""), rules.Rule("ast", "c", 10, "", type="ast")]
    catalogue, files = [*rules.load().rules, *own], made_files(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    expected = rows(regex_scan.scan(files, catalogue))
    assert rows(literal_scan.scan(files, catalogue)) == expected and len({r[2] for r in expected}) >= 8
    assert regex_scan.scan(files, catalogue).columns == literal_scan.scan(files, catalogue).columns


def test_plans_do_not_grow_with_the_catalogue(spark):
    many = lambda n: [rules.Rule(f"r{k}", "c", 20, "", rules=({"pattern": rf"\bname{k}\b"}, {"pattern": rf"other_{k}\("})) for k in range(n)]
    files = made_files(spark, 5).unionByName(spark.createDataFrame([("p", "acme", "a.py", "x\nname77 name7\nOTHER_1999(\nname1999")], "package_id string, package_name string, rel_path string, content string"))
    plan = lambda n: len(regex_scan.scan(files, many(n))._jdf.queryExecution().toString())
    assert abs(plan(2000) - plan(200)) < 200
    got = {(r.pattern_id, r.line_number) for r in regex_scan.scan(files, many(2000)).collect()}
    assert got == {("r77", 2), ("r7", 2), ("r1999", 4)}  # its first pattern, though in a later line
    with pytest.raises(ValueError):
        literal_scan.scan(files, many(1) * (literal_scan.MOST_RULES + 1))


def test_ranks_over_ranges_and_ties(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(50)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = order.numbered(frame, [F.col("k"), F.desc("v")]).collect()
    assert sorted(r.position for r in got) == list(range(1, 3001)) and "_range" not in got[0].asDict()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.position)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert order.numbered(frame.where("false"), [F.col("k")]).count() == 0


def findings(spark, rows):
    data = [(p, i, f"k{i}", "c", s, "", "", f, 1, layer) for i, (p, s, f, layer) in enumerate(rows)]
    return spark.createDataFrame(data, S.FINDING)


def test_reading_order_of_paths_and_layers(spark):
    rows = [("p", 20, "z.py", "static"), ("p", 20, None, "sandbox"), ("p", 20, "a.py", "static"), ("p", 20, "pkg/setup.py", "static"), ("p", 20, None, "metadata"), ("a", 20, "q.py", "static")]
    got = order.in_order(findings(spark, rows)).orderBy("finding_seq").collect()
    assert [r.pattern_id for r in got] == ["k5", "k3", "k2", "k0", "k4", "k1"] and [r.finding_seq for r in got] == [1, 2, 3, 4, 5, 6]


def test_reports_of_hot_packages_in_parts(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "b", "c"]), rng.choice([10, 20, 40, 80]), rng.choice([None, "a.py"]), "static") for _ in range(500)]
    found = findings(spark, rows).repartition(4)
    verdicts = scoring.verdicts(found, spark.createDataFrame([("hot",), ("b",), ("c",), ("none",)], "package_id string"))
    whole = {r.package_id: r.report for r in report.reports(verdicts, found).collect()}
    for lines in (1, 7, 1000):
        parts = report.report_parts(verdicts, found, lines).collect()
        texts = {}
        for r in sorted(parts, key=lambda r: r.part):
            texts.setdefault(r.package_id, []).append(r.text)
            assert r.text.count("\n[") < lines
        assert {p: "\n".join(t) for p, t in texts.items()} == whole


def test_users_and_failing_layers(spark):
    files = made_files(spark, 10)
    packages = files.select("package_id").distinct()
    own = lambda files: files.select(F.lit(5).alias("finding_seq"), "package_id", F.lit("mine").alias("pattern_id"), F.lit("own").alias("category"), F.lit(80).alias("severity"), *(F.lit("").alias(c) for c in ("description", "evidence", "source_file")), F.lit(None).cast("int").alias("line_number"), F.lit("own").alias("layer"))

    def breaks(files):
        return own(files).withColumn("evidence", F.raise_error(F.lit("no")))

    known = layers.standard().register(layers.Layer("own", ("files",), own)).register(layers.Layer("breaks", ("files",), breaks))
    known.register(layers.Layer("shapeless", ("files",), lambda files: files.select("package_id"))).register(layers.Layer("raises", (), lambda: 1 / 0))
    found, verdicts, status = known.judge(spark, packages, {"files": files, "packages": packages.withColumn("metadata", F.lit(None))})
    told = {r.layer: r.status for r in status.collect()}
    assert told == {"static": "ran", "metadata": "failed: ValueError", "sandbox": "no input", "own": "ran", "breaks": told["breaks"], "shapeless": "failed: ValueError", "raises": "failed: ZeroDivisionError"}
    assert told["breaks"].startswith("failed: ")
    assert {r.layer for r in found.select("layer").distinct().collect()} == {"static", "own"}
    assert verdicts.count() == 12 and {r.decision_name for r in verdicts.collect()} == {"BLOCKED"}
    known.register(layers.Layer("own", ("lines",), own))
    assert [x.name for x in known.layers] == ["static", "metadata", "sandbox", "own", "breaks", "shapeless", "raises"]
