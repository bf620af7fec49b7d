"""``python -m riskloom scan FOLDER``, ``check SPEC...``, ``test-playbooks FOLDER`` or ``version``.

Names of commands, options and their defaults are fixed values, except ``--each``, ``--rules``, ``--registry`` and ``--traces``.
"""

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import orchestrate
from .sources.rules import USER_RULES, Rule, load

VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="riskloom", description="Judge software packages without running them")
    commands = out.add_subparsers(dest="command")
    scan = commands.add_parser("scan", help="judge the package in FOLDER")
    scan.add_argument("folder")
    scan.add_argument("--name", "-n", default="", help="the package's name; the folder's by default")
    scan.add_argument("--each", action="store_true", help="take every folder in FOLDER for a package")
    scan.add_argument("--traces", help="a folder of recorded runs, NAME.log each")
    scan.add_argument("--rules", action="append", default=[], help="a further folder of rules")
    scan.add_argument("--version", "-v", default="unknown", dest="package_version")
    scan.add_argument("--verbose", action="store_true", help="show Spark's log")
    check = commands.add_parser("check", help="judge packages from a copy of a registry; nothing is installed")
    check.add_argument("packages", nargs="+", help="names, with ==version or without")
    check.add_argument("--registry", required=True, help="a folder with answers/ and archives/")
    check.add_argument("--max-size", type=int, default=50, help="the largest archive, in MB")
    check.add_argument("--rules", action="append", default=[], help="a further folder of rules")
    check.add_argument("--verbose", action="store_true")
    books = commands.add_parser("test-playbooks", help="judge the packages that FOLDER/expected.csv names and compare")
    books.add_argument("folder")
    books.add_argument("--skip-sandbox", action="store_true", help="leave out the recorded runs in FOLDER/traces")
    books.add_argument("--verbose", action="store_true")
    commands.add_parser("version")
    return out


def catalogue(folders: list[str]) -> list[Rule]:
    """Built-in rules, then the user's own, then those of ``folders``; rule files that are left out are told."""
    found = load([USER_RULES, *folders])
    for path, why in found.rejects:
        print(f"Warning: {path} is no rule: {why}", file=sys.stderr)
    return found.rules


def run(args: list[str]) -> int:
    given = parser().parse_args(args)
    if given.command is None:
        parser().print_help()
        return 0
    if given.command == "version":
        print(f"riskloom {VERSION}")
        return 0
    spark = SparkSession.builder.appName("riskloom").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if given.verbose else "ERROR")
    try:
        if given.command == "scan":
            return orchestrate.main(spark, given.folder, given.name, given.package_version, given.each, catalogue(given.rules), given.traces)
        if given.command == "check":
            return orchestrate.check(spark, given.packages, given.registry, given.max_size << 20, rules=catalogue(given.rules))
        return orchestrate.run_playbooks(spark, given.folder, given.skip_sandbox)
    except NotADirectoryError as wrong:
        print(f"Error: {wrong}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
