"""Calls that matter in Python sources, found in their syntax trees. Sources are parsed, never run."""

from __future__ import annotations

import ast
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import AST_SUFFIXES, ast_severity
from ..sources.rules import Rule
from .regex_scan import readable

# Calls that execute, and bare names of calls that decode.
EXECUTING = ("eval", "exec", "compile")
DECODING = ("b64decode", "b32decode", "b16decode", "loads", "decompress")

ISSUES = "array<struct<seq:int,type:string,function:string,line:int,detail:string,evidence:string>>"


def call_name(call: ast.Call) -> str:
    """Dotted name of what is called; below anything but a name, the attributes alone."""
    parts, node = [], call.func
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def dynamic(call: ast.Call) -> bool:
    return any(not isinstance(a, ast.Constant | ast.JoinedStr) for a in call.args)


def calls_in_breadth(tree: ast.AST) -> list[ast.Call]:
    found, waiting = [], deque([tree])
    while waiting:
        node = waiting.popleft()
        waiting.extend(ast.iter_child_nodes(node))
        if isinstance(node, ast.Call):
            found.append(node)
    return found


def issues_of(text: str) -> tuple[list[dict], str | None]:
    """Issues in breadth-first order, and why there are none if the source cannot be parsed."""
    try:
        calls = calls_in_breadth(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as wrong:
        return [], type(wrong).__name__
    names = [call_name(c) for c in calls]
    executes = sorted(set(names).intersection(EXECUTING))
    found, lines = [], text.splitlines()

    def add(kind: str, name: str, line: int, detail: str) -> None:
        evidence = lines[line - 1].strip() if 0 < line <= len(lines) else ""
        found.append({"seq": len(found), "type": kind, "function": name, "line": line, "detail": detail, "evidence": evidence})

    for call, name in zip(calls, names, strict=True):
        if name in EXECUTING and dynamic(call):
            add("dynamic_exec", name, call.lineno, "called with what is made at run time")
        if name in DECODING and executes:
            add("decode_exec_chain", name, call.lineno, "decoded where " + ", ".join(executes) + " is called")
        if name == "__import__" and dynamic(call):
            add("dynamic_import", name, call.lineno, "imports what is named at run time")
    return found, None


def issues(files: DataFrame) -> DataFrame:
    """Source files with their issues, each with its line's text, and error: the one step that needs Python."""

    def run(batches):
        fields = [("seq", pa.int32()), ("type", pa.string()), ("function", pa.string()), ("line", pa.int32()), ("detail", pa.string()), ("evidence", pa.string())]
        for batch in batches:
            found = [issues_of(t) for t in batch.column(3).to_pylist()]
            columns = [*(batch.column(c) for c in range(3)), pa.array([x for x, _ in found], pa.list_(pa.struct(fields))), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["package_id", "package_name", "rel_path", "issues", "error"])

    kept = readable(files, AST_SUFFIXES).select(F.col("package_id").cast("string"), F.col("package_name").cast("string"), "rel_path", "text")
    return kept.mapInArrow(run, f"package_id string, package_name string, rel_path string, issues {ISSUES}, error string")


def matches(rule: dict, issue: Column) -> Column:
    names = rule.get("function_names", [])
    named = issue["function"].isin(*names) if names else F.lit(False)
    dynamic_call = (issue["type"] == "dynamic_exec") & named if rule.get("require_dynamic_args") else F.lit(False)
    chained = F.lit(False)
    for chain in rule.get("call_chains", []):
        chained = chained | (issue["function"] == chain) | issue["function"].endswith(chain)
    return dynamic_call | ((issue["type"] == "decode_exec_chain") & chained) | ((issue["type"] == "dynamic_import") & named)


def scan(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of AST rules: each issue goes to the first rule in catalogue order that it matches."""
    active = [r for r in rules if r.type == "ast" and r.target == "source"]
    rows = issues(files).select("package_id", "package_name", "rel_path", F.explode("issues").alias("issue"))
    chosen = F.lit(None).cast("struct<pattern_id:string,category:string,severity:int,description:string>")
    for rule in reversed(active):
        own = F.struct(F.lit(rule.pattern_id).alias("pattern_id"), F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"), F.lit(rule.description).alias("description"))
        hit = F.lit(False)
        for r in rule.rules:
            hit = hit | matches(r, F.col("issue"))
        if rule.expected_for:
            hit = hit & ~F.coalesce(F.lower("package_name").isin(*(n.lower() for n in rule.expected_for)), F.lit(False))
        chosen = F.when(hit, own).otherwise(chosen)
    found = rows.withColumn("rule", chosen).where("rule is not null")
    return found.select(
        "package_id", (F.col("issue.seq").cast("long") + 2_000_000).alias("finding_seq"), "rule.pattern_id", "rule.category", ast_severity(F.col("rule.severity"), F.col("rel_path")).alias("severity"),
        "rule.description", F.col("issue.evidence").alias("evidence"), F.col("rel_path").alias("source_file"), F.col("issue.line").alias("line_number"), F.lit("static").alias("layer"),
    )
