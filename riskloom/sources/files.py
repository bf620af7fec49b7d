"""Source files and traces as tables."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.schema import MAX_FILE_BYTES

#: Bytes of files that one task reads, and what opening one counts as.
PART_BYTES, OPEN_COST = 32 << 20, 64 << 10

# Planted credential files, in the order in which an access is told apart.
CANARIES = (".ssh/id_rsa", ".ssh/id_ed25519", ".aws/credentials", ".env", ".git-credentials")

# Fixed values.
NO_MODULE_FOLDERS = ("tests", "test", "docs", "doc", "examples", "benchmarks")


SUFFIXES = (".py", ".pyx", ".pyi")

TREE = "package_id string, package_name string, rel_path string, content binary, error string"

#: Package of files that lie in no package's folder.
LOOSE = "."


class TreeSource(DataSource):
    """Files of a folder that driver and executors share, hidden names included.

    Option ``package`` names the one package that the folder is; without it, packages are the
    folders in it. The driver lists names and sizes; tasks read the contents. What cannot be
    read (links, pipes, files and folders without permission, files that went or grew) gives a
    row with an error and no content.
    """

    @classmethod
    def name(cls) -> str:
        return "riskloom_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], tuple(self.options["suffixes"].split(",")), self.options.get("package") or None)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, suffixes: tuple[str, ...], package: str | None = None):
        self.root, self.suffixes, self.package = root, suffixes, package

    def listed(self) -> Iterator[tuple[str, int, str | None]]:
        """Path below the root, size, and error of source files in order, and of folders that cannot be listed."""
        shut: list[OSError] = []
        for folder, folders, names in os.walk(self.root, onerror=shut.append):
            folders.sort()
            for name in sorted(names):
                if os.path.splitext(name)[1].lower() not in self.suffixes:
                    continue
                path = os.path.join(folder, name)
                below = os.path.relpath(path, self.root)
                try:
                    info = os.lstat(path)
                except OSError as wrong:
                    yield below, 0, wrong.strerror
                    continue
                if not stat.S_ISREG(info.st_mode):
                    yield below, 0, "not a regular file"
                elif info.st_size <= MAX_FILE_BYTES:
                    yield below, info.st_size, None
        for wrong in shut:
            yield os.path.relpath(wrong.filename, self.root), 0, wrong.strerror

    def partitions(self) -> list[InputPartition]:
        parts, own, total = [], [], 0
        for below, size, error in self.listed():
            if own and total + size > PART_BYTES:
                parts.append(InputPartition(own))
                own, total = [], 0
            own.append((below, error))
            total += size + OPEN_COST
        parts.append(InputPartition(own))
        return parts

    def read(self, partition: InputPartition):
        for below, error in partition.value:
            parts = below.split(os.sep)
            if self.package is not None:
                package = self.package
            else:
                package, parts = (parts[0], parts[1:]) if len(parts) > 1 else (LOOSE, parts)
            content = None
            if error is None:
                content, error = content_of(os.path.join(self.root, below))
            yield package, package, "/".join(parts), content, error


def content_of(path: str) -> tuple[bytes | None, str | None]:
    """Content of a regular file within the limit, or why there is none. Links are not followed and pipes not waited for."""
    try:
        with open(os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as f:
            if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
                return None, "not a regular file"
            content = f.read(MAX_FILE_BYTES + 1)
    except OSError as wrong:
        return None, wrong.strerror
    return (content, None) if len(content) <= MAX_FILE_BYTES else (None, "grew beyond the limit")


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, package: str | None = None) -> DataFrame:
    """Source files as package_id, package_name, rel_path, content and error (why a file could not be read).

    With ``package``, all of ``root`` is that package; else the folders in it are packages, and
    files beside them the package LOOSE. A plain path is a folder that all executors see
    (``TreeSource``). A path with another scheme than ``file`` is read by Spark's own source,
    which passes over names that begin with ``_`` or ``.``: such trees come as archives
    (``registry.expand``) or as a table.
    """
    if "://" not in root or root.startswith("file://"):
        folder = root.removeprefix("file://").rstrip("/") or "/"
        if not os.path.isdir(folder):
            raise NotADirectoryError(f"{folder} is not a folder")
        spark.dataSource.register(TreeSource)
        return spark.read.format(TreeSource.name()).option("suffixes", ",".join(suffixes)).option("package", package or "").load(folder)
    glob = "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("://", 1)[1].replace(".", r"\.") + "/", "")
    kept = found.where(F.col("length") <= MAX_FILE_BYTES).select(below.alias("below"), "content", F.lit(None).cast("string").alias("error"))
    if package is not None:
        return kept.select(F.lit(package).alias("package_id"), F.lit(package).alias("package_name"), F.col("below").alias("rel_path"), "content", "error")
    inside = F.contains("below", F.lit("/"))
    name = F.when(inside, F.substring_index("below", "/", 1)).otherwise(F.lit(LOOSE))
    path = F.when(inside, F.expr("substring(below, instr(below, '/') + 1)")).otherwise(F.col("below"))
    return kept.select(name.alias("package_id"), name.alias("package_name"), path.alias("rel_path"), "content", "error")


def read_traces(spark: SparkSession, root: str) -> DataFrame:
    """Trace logs ``root/<package_id>.log`` (or ``root/package_id=<id>/...``, as Spark writes them) as package_id, line_no and line.

    Large logs are read in splits, by many tasks. A line's number is its place in its split plus
    the lines of the splits of that file before it, which a first pass counts: one row a split.
    Empty lines count and are left out.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(root)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = rows.select(place.alias("split"), F.monotonically_increasing_id().alias("place"), F.make_valid_utf8("value").alias("line"))
    splits = rows.groupBy("split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("split.path").orderBy("split.start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    path = F.url_decode(F.replace("split.path", F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(path, "/package_id=([^/]*)/[^/]*$", 1)
    package = F.when(folder != "", folder).otherwise(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    numbered = rows.join(splits, "split").select(package.alias("package_id"), (F.col("place") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")
    return numbered.where("line <> ''")


def canaries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*enumerate(CANARIES)], "ordinal int, canary_path string")


def is_source(length: Column, suffix: Column, suffixes: tuple[str, ...]) -> Column:
    """Suffix in lower case, and no larger than the limit."""
    return F.lower(suffix).isin(*suffixes) & (length <= MAX_FILE_BYTES)


def resolve_module(folders: DataFrame) -> DataFrame:
    """package_id and module: of the top folders (package_id, package_name, folder, has_init), the one that is imported.

    The one named like the package (whatever the case, and - or _), else the first in order that is no test or documentation folder; only with __init__.py.
    """
    folded = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit("_"))
    like = folded("folder") == folded("package_name")
    able = folders.where(F.col("has_init") & (like | ~F.lower("folder").isin(*NO_MODULE_FOLDERS)))
    return able.groupBy("package_id").agg(F.min(F.struct((~like).alias("other"), F.col("folder").alias("folder"))).alias("x")).select("package_id", F.col("x.folder").alias("module"))


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")
