"""Registry answers and distributions: parsing, choice, checks, and archives expanded in memory."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.schema import MAX_FILE_BYTES

# Fixed value: the largest download.
MAX_DOWNLOAD = 50 * 1024 * 1024

#: An archive may hold this many members and bytes, expanded; beyond it, it is refused.
MAX_MEMBERS, MAX_EXPANDED = 20_000, 500 * 1024 * 1024

#: Bytes that are read from an archive at once, and bytes of files that leave a task together.
CHUNK, BATCH_BYTES = 1 << 16, 4 << 20

#: Answers that one task reads.
FILES_A_TASK = 256

ESCAPE = "a member leaves the archive"

FILE = "struct<packagetype:string,url:string,filename:string,size:bigint,digests:struct<sha256:string>>"
ANSWER = (
    "struct<info:struct<name:string,version:string,summary:string,author:string,author_email:string,maintainer:string,maintainer_email:string,"
    f"home_page:string,upload_time:string,project_urls:map<string,string>>,urls:array<{FILE}>,releases:map<string,array<{FILE}>>>"
)


class AnswerSource(DataSource):
    """Answers of a registry kept as ``root/answers/<name>/<version>.json``, with ``latest.json`` for the question without a version.

    Filters on name and version are pushed: other names' folders are not even listed. One
    row for each file: name, version (null for the latest), status and body. A file
    ``<version>.<status>`` instead of ``.json`` records an answer of that status.
    """

    @classmethod
    def name(cls) -> str:
        return "riskloom_answers"

    def schema(self) -> str:
        return "name string, version string, status int, body string"

    def reader(self, schema) -> AnswerReader:
        return AnswerReader(self.options["path"])


class AnswerReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.wanted = f"{root}/answers", {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("name",), ("version",)):
                yield f
                continue
            known = self.wanted.get(f.attribute[0])
            self.wanted[f.attribute[0]] = set(values) if known is None else known & set(values)

    def listed(self) -> Iterator[tuple[str, str | None, int, str]]:
        """name, version, status and path of the answers that the filters leave."""
        wanted = self.wanted.get("name")
        names = sorted(os.listdir(self.root)) if wanted is None else sorted(n for n in wanted if n and os.sep not in n and n not in (".", "..") and os.path.isdir(f"{self.root}/{n}"))
        for name in names:
            for file in sorted(os.listdir(f"{self.root}/{name}")):
                stem, _, kind = file.rpartition(".")
                version = None if stem == "latest" else stem
                if (kind == "json" or kind.isdigit()) and ("version" not in self.wanted or (version is not None and version in self.wanted["version"])):
                    yield name, version, 200 if kind == "json" else int(kind), f"{self.root}/{name}/{file}"

    def partitions(self) -> list[InputPartition]:
        files = list(self.listed())
        return [InputPartition(files[lo : lo + FILES_A_TASK]) for lo in range(0, len(files), FILES_A_TASK)] or [InputPartition([])]

    def read(self, partition: InputPartition):
        for name, version, status, path in partition.value:
            with open(path, encoding="utf-8", errors="replace") as f:
                yield name, version, status, f.read()


def read_answers(spark: SparkSession, root: str) -> DataFrame:
    """name, version, status and body of the answers below ``root``, a folder that all executors see (``AnswerSource``)."""
    folder = root.removeprefix("file://").rstrip("/")
    if not os.path.isdir(f"{folder}/answers"):
        raise NotADirectoryError(f"{folder}/answers is not a folder")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnswerSource)
    return spark.read.format(AnswerSource.name()).load(folder)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """url and content of the archives ``root/archives/...``; a url is the path below that folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/archives")
    return found.select(F.regexp_replace("path", "^.*?/archives/", "").alias("url"), "content")


def answers(raw: DataFrame) -> DataFrame:
    """``answer`` parsed from the JSON in column ``body``; unreadable ones are null."""
    return raw.withColumn("answer", F.from_json("body", ANSWER))


def chosen_file(urls: Column, releases: Column, version: Column) -> Column:
    """The source distribution of the files of this version, else its first file; null if it has none."""
    files = F.when(F.coalesce(F.size(urls), F.lit(0)) > 0, urls).otherwise(F.try_element_at(releases, version))
    source = F.filter(files, lambda f: f["packagetype"] == "sdist")
    return F.coalesce(F.get(source, F.lit(0)), F.get(files, F.lit(0)))


def fetch_error(file: Column, status: Column, limit: int = MAX_DOWNLOAD) -> Column:
    """Why a package cannot be fetched, or null."""
    return (
        F.when(status == 404, F.lit("not found"))
        .when(status >= 400, F.concat(F.lit("registry answered "), status.cast("string")))
        .when(file.isNull(), F.lit("no distribution"))
        .when(F.coalesce(file["size"], F.lit(0)) > limit, F.lit("too large; raise the limit to fetch it"))
    )


def intact(content: Column, sha256: Column) -> Column:
    return F.coalesce(F.sha2(content, 256) == sha256, F.lit(False))


def inside(name: str) -> str | None:
    """A member's path without its ``.`` parts, or None if it leaves the archive's root."""
    path = PurePosixPath(name.replace("\\", "/"))
    return None if path.is_absolute() or ".." in path.parts else str(path)


def read_bounded(stream, left: int, keep: int) -> tuple[bytes | None, int]:
    """All of ``stream``, read to its end (where checksums are compared): its bytes unless they exceed ``keep``, and how many."""
    kept, size = bytearray(), 0
    while chunk := stream.read(CHUNK):
        size += len(chunk)
        if size > left:
            raise ValueError("too much inside")
        if size <= keep:
            kept += chunk
    return (bytes(kept) if size <= keep else None), size


def tar_members(content: bytes, keep: int) -> Iterator[tuple[str, bytes | None, int]]:
    left = MAX_EXPANDED
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as unpacked:
        with tarfile.open(fileobj=unpacked, mode="r|") as archive:
            for m in archive:
                data, size = read_bounded(archive.extractfile(m), left, keep) if m.isfile() else (None, 0)
                left -= size
                if m.isfile():
                    yield m.name, data, size
                elif inside(m.name) is None:
                    raise ValueError(ESCAPE)
        read_bounded(unpacked, left, 0)  # what follows the last member, and the checksum


def zip_members(content: bytes, keep: int) -> Iterator[tuple[str, bytes | None, int]]:
    left = MAX_EXPANDED
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for m in archive.infolist():
            if m.is_dir():
                if inside(m.filename) is None:
                    raise ValueError(ESCAPE)
                continue
            with archive.open(m) as stream:
                data, size = read_bounded(stream, left, keep)
            left -= size
            yield m.filename, data, size


def members(file_name: str, content: bytes, keep: int = MAX_FILE_BYTES) -> Iterator[tuple[str, bytes | None, int]]:
    """Path, content (None beyond ``keep`` bytes) and size of one file after the other of a .tar.gz, .tgz, .zip or .whl archive.

    ValueError if the archive is refused; other errors if it is damaged. Nothing touches the disk.
    """
    low = file_name.lower()
    if low.endswith((".tar.gz", ".tgz")):
        found = tar_members(content, keep)
    elif low.endswith((".zip", ".whl")):
        found = zip_members(content, keep)
    else:
        raise ValueError("unknown kind of archive")
    for n, (name, data, size) in enumerate(found):
        path = inside(name)
        if path is None:
            raise ValueError(ESCAPE)
        if n >= MAX_MEMBERS:
            raise ValueError("too much inside")
        yield path, data, size


def examined(file_name: str, content: bytes) -> tuple[str | None, str | None]:
    """The single top folder of all files, if there is one, and why the archive is refused, if it is. Every file is read to its end, none is kept."""
    top, single = None, True
    try:
        for path, _, _ in members(file_name, content, 0):
            first, slash, _ = path.partition("/")
            single = single and bool(slash) and top in (None, first)
            top = first
    except ValueError as wrong:
        return None, str(wrong)
    except Exception as wrong:  # whatever reading hostile bytes raises
        return None, f"damaged: {type(wrong).__name__}"
    return (top if single else None), None


FILES = "package_id string, package_name string, rel_path string, size long, content binary, error string"


def expand(archives: DataFrame) -> DataFrame:
    """Files of archives (package_id, package_name, file_name, content) as rel_path, size and content, or one row with the error.

    Each archive is read twice: first to its end, to know that it is sound, that no file
    leaves its root and whether a single top folder holds all; then its files leave the
    task one after the other, in batches of BATCH_BYTES. A refused archive so gives no file,
    and no list of files is ever held. Files above MAX_FILE_BYTES, which no scan reads, come
    without content. An archive without files gives nothing; a null one is an unknown kind.
    """
    kinds = pa.schema([("package_id", pa.string()), ("package_name", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def rows_of(package, name, file_name, content):
        top, error = examined(file_name, content)
        if error is not None:
            yield package, name, None, None, None, error
            return
        cut = len(top) + 1 if top else 0
        for path, data, size in members(file_name, content):
            yield package, name, path[cut:], size, data, None

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                package, name, file_name, content = (batch.column(k)[i].as_py() for k in range(4))
                for row in rows_of(package, name, file_name or "", content or b""):
                    rows.append(row)
                    held += len(row[4] or b"") + 256
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    columns = archives.select(F.col("package_id").cast("string"), F.col("package_name").cast("string"), "file_name", "content")
    return columns.mapInArrow(run, FILES)
