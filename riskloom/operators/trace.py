"""Findings from recorded system-call traces. Logs are data here; nothing is ever run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import SEVERITIES

# Addresses that are no finding, what the programs begin with that an import may start, and the layout of lines.
LOCAL_ADDRESSES = ("127.0.0.1", "::1", "0.0.0.0")
EXPECTED_BINARIES = ("/usr/bin/python", "/bin/python", "/usr/bin/strace", "/bin/strace", "/usr/lib/python", "/lib/ld-linux", "/lib64/ld-linux")
OPENED = r'openat\(.*?"([^"]+)"'
CONNECTED = r'connect\(\d+,\s*\{sa_family=AF_INET6?,\s*sin6?_port=htons\((\d+)\),\s*sin6?_addr=inet_(?:addr|pton)\((?:AF_INET6?,\s*)?"([^"]+)'
STARTED = r'execve\("([^"]+)"'


def canary_of(line: Column, canaries: list[str]) -> Column:
    """The first canary path that the opened path contains, or whose base name it ends with; else null."""
    path = F.regexp_extract(line, OPENED, 1)
    hits = (F.when(path.contains(c) | path.endswith(c.rsplit("/", 1)[-1]), F.lit(c)) for c in canaries)
    return F.when(F.contains(line, F.lit("openat(")) & (path != ""), F.coalesce(*hits, F.lit(None).cast("string")))


def endpoint_of(line: Column) -> Column:
    """``address:port`` of a connect call to anywhere but this machine, failed calls included; else null."""
    port, address = F.regexp_extract(line, CONNECTED, 1), F.regexp_extract(line, CONNECTED, 2)
    outside = F.contains(line, F.lit("connect(")) & (address != "") & ~address.isin(*LOCAL_ADDRESSES)
    return F.when(outside, F.concat(address, F.lit(":"), port))


def binary_of(line: Column) -> Column:
    """The program of an exec call, unless it is expected; else null."""
    binary = F.regexp_extract(line, STARTED, 1)
    expected = F.exists(F.array(*map(F.lit, EXPECTED_BINARIES)), lambda p: F.startswith(binary, p))
    return F.when(F.contains(line, F.lit("execve(")) & (binary != "") & ~expected, binary)


def first_seen(lines: DataFrame, kind: str, value: Column) -> DataFrame:
    """package_id, line_no, kind and value of the first line of each value."""
    own = lines.select("package_id", "line_no", value.alias("value")).where("value is not null")
    return own.groupBy("package_id", "value").agg(F.min("line_no").alias("line_no")).select("package_id", "line_no", F.lit(kind).alias("kind"), "value")


KINDS = {
    "honeypot_access": ("credential_theft", "CRITICAL", "A planted credential file was opened"),
    "runtime_network_connect": ("network", "HIGH", "The import connected to another host"),
    "runtime_subprocess": ("code_execution", "HIGH", "The import started another program"),
}


def parse(lines: DataFrame, canaries: list[str]) -> DataFrame:
    """Findings of trace lines (package_id, line_no, line): one for each canary, endpoint and program, where first seen."""
    hits = F.array_compact(F.array(*(
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value")))
        for k, v in zip(KINDS, (canary_of(F.col("line"), canaries), endpoint_of(F.col("line")), binary_of(F.col("line"))), strict=True)
    )))
    rows = lines.select("package_id", "line_no", F.inline(hits)).groupBy("package_id", "kind", "value").agg(F.min("line_no").alias("line_no"))
    pick = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.lit(SEVERITIES[v[1]] if i == 1 else v[i])) for k, v in KINDS.items()))
    return rows.select(
        "package_id", F.col("line_no").cast("long").alias("finding_seq"), F.col("kind").alias("pattern_id"), pick(0).alias("category"), pick(1).alias("severity"),
        pick(2).alias("description"), F.col("value").alias("evidence"), F.lit(None).cast("string").alias("source_file"), F.col("line_no").cast("int").alias("line_number"), F.lit("sandbox").alias("layer"),
    )
