"""First accesses of streamed runs, against the batch parser."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from riskloom.operators import trace
from riskloom.sources.files import CANARIES
from riskloom.streaming import traces

START = datetime(2024, 6, 30, tzinfo=UTC)
LINES = [
    'openat(AT_FDCWD, "/tmp/h/.ssh/id_rsa", O_RDONLY) = 3', 'openat(AT_FDCWD, "/tmp/h/.env", O_RDONLY) = 3', 'connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("10.0.0.1")}, 16) = 0',
    'connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("127.0.0.1")}, 16) = 0', 'execve("/bin/sh", ["sh"]) = 0', 'execve("/usr/bin/python3", ["python3"]) = 0', "close(3) = 0",
]
KIND = "package_id string, run_id string, line_no long, ts timestamp, line string"


@pytest.fixture
def stream(spark, tmp_path):
    """Run batches of rows through the stream; gives what is told and how many rows state holds after each."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    traces.use_state_store(spark)

    def run(batches):
        source = tmp_path / "in"
        source.mkdir()
        rows = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = traces.first_accesses(rows, "10 minutes").writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        held = []
        try:
            for k, b in enumerate(batches):
                spark.createDataFrame(b, KIND).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
                (part,) = (tmp_path / f"b{k}").glob("*.parquet")
                part.rename(source / f"{k}.parquet")
                q.processAllAvailable()
                held.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
        finally:
            q.stop()
        return [tuple(r) for r in spark.table("told").select("package_id", "run_id", "kind", "value").collect()], held

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_repeated_late_and_replayed_lines(spark, stream):
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(3)}", rng.choice("ab"), k, START + timedelta(minutes=2 * k), rng.choice(LINES)) for k in range(80)]
    batches = [rows[lo : lo + 20] for lo in range(0, 80, 20)]
    for b in batches[1:]:  # some lines come again, some come late but within the watermark
        b.extend(rng.sample(batches[0][-4:] if b is batches[1] else b, 3))
        rng.shuffle(b)
    told, _ = stream(batches)
    frame = spark.createDataFrame([(f"{p}/{r}", n, x) for p, r, n, _, x in rows], "package_id string, line_no long, line string")
    expected = sorted((*r.package_id.split("/"), r.pattern_id, r.evidence) for r in trace.parse(frame, list(CANARIES)).collect())
    assert sorted(told) == expected


def test_state_goes_when_a_run_ends_and_not_before(stream):
    at = lambda m: START + timedelta(minutes=m)
    opened, ended = LINES[0], "+++ exited with 0 +++"
    told, held = stream([
        [("p", "one", 1, at(0), opened), ("p", "two", 1, at(0), opened)],
        [("p", "one", 2, at(600), opened), ("p", "two", 2, at(600), ended)],  # much later than any delay
        [("q", "x", 1, at(700), "close(3) = 0"), ("q", "x", 2, at(700), opened)],
        [("q", "x", 3, at(800), LINES[4])],
        [("p", "two", 3, at(605), opened), ("p", "one", 3, at(810), opened)],  # later than the watermark; still the same run
    ])
    assert sorted(told) == [("p", "one", "honeypot_access", ".ssh/id_rsa"), ("p", "two", "honeypot_access", ".ssh/id_rsa"), ("q", "x", "honeypot_access", ".ssh/id_rsa"), ("q", "x", "runtime_subprocess", "/bin/sh")]
    assert held[1] == 3 and held[-1] == 3  # at last one value of p's first run and two of q's: the run that ended is forgotten
