"""Archives and registry answers made from table rows, as inputs of registered queries and tests. Their texts are inert."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(file_name: str, files: list[tuple[str, bytes]]) -> bytes:
    """An archive of ``files``; its kind follows from the name."""
    out = io.BytesIO()
    if file_name.endswith((".zip", ".whl", ".rar")):
        with zipfile.ZipFile(out, "w") as z:  # stored, not deflated
            for name, data in files:
                z.writestr(zipfile.ZipInfo(name), data)
        return out.getvalue()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as g, tarfile.open(fileobj=g, mode="w") as t:  # the same bytes each time
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def flipped(data: bytes, what: bytes) -> bytes:
    """``data`` with one bit changed in the first ``what``."""
    at = data.index(what)
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def sound_or_not(kind: int, key: int) -> tuple[str, bytes]:
    """Name and content of an archive of one of nine kinds: sound, escaping, damaged, unknown, nested and empty ones."""
    own = f"x = {key}\n".encode()
    match kind:
        case 0:
            return "a.tar.gz", packed("a.tar.gz", [(f"top-{key}/setup.py", own), (f"top-{key}/pkg/__init__.py", b"")])
        case 1:
            return "a.zip", packed("a.zip", [("pkg/a.py", own), ("meta/b.txt", b"text")])
        case 2:
            return "a.tgz", packed("a.tgz", [("pkg/a.py", own), ("pkg/../../evil.py", own)])
        case 3:
            return "A.ZIP", packed("a.zip", [("pkg/a.py", own), ("/etc/x", own)])
        case 4:
            return "a.tar.gz", packed("a.tar.gz", [("pkg/a.py", own)])[:-12]
        case 5:
            return "a.whl", flipped(packed("a.whl", [("pkg/a.py", own)]), own)
        case 6:
            return "a.rar", packed("a.rar", [("pkg/a.py", own)])
        case 7:
            return "a.whl", packed("a.whl", [("inner.zip", packed("inner.zip", [("../x", b"abc")])), ("pkg/__init__.py", own)])
        case _:
            return "a.zip", packed("a.zip", [])


def archive_rows(rows: DataFrame, make=sound_or_not) -> DataFrame:
    """key, file_name and content, from rows of (key, kind)."""

    def run(batches):
        for batch in batches:
            keys, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [make(kind, key) for kind, key in zip(kinds, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=["key", "file_name", "content"])

    return rows.select(F.col("key").cast("long"), F.col("kind").cast("int")).mapInArrow(run, "key long, file_name string, content binary")


def of_registry(kind: int, key: int) -> tuple[str, bytes]:
    """Name and content of the archive of a package of one of thirteen kinds, by how far its fetch comes."""
    clean, spawns, steals = b"value = 1\n", b"import subprocess\nsubprocess.run(cmd)\n", b"key = open(home + '/.ssh/id_rsa').read()\n"
    match kind:
        case 7:
            return f"p{key}.tar.gz", packed("a.tar.gz", [("pkg/a.py", clean), ("../evil.py", steals)])
        case 8:
            return f"p{key}.zip", flipped(packed("a.zip", [("pkg/a.py", steals)]), steals)
        case 9:
            return f"p{key}.rar", packed("a.rar", [("pkg/a.py", steals)])
        case 11:
            return f"p{key}.zip", packed("a.zip", [("pkg/a.py", spawns), ("pkg/b.py", clean)])
        case 12:
            return f"p{key}.whl", packed("a.whl", [("pkg/a.py", steals)])
        case _:
            return f"p{key}.tar.gz", packed("a.tar.gz", [(f"p-{key}/pkg/a.py", clean)])


def registry_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers (name, version, status, body) and archives (url, content) of packages, from rows of (key, kind, version).

    Kinds: 0 not found, 1 registry out of order, 2 no JSON, 3 nothing to download, 4 too large, 5 archive lost,
    6 another digest, 7 escaping, 8 damaged, 9 unknown archive, 10 clean, 11 starts programs, 12 reads a key.
    """
    made = archive_rows(rows, of_registry).join(rows, "key")
    url = F.concat(F.lit("files/"), "file_name")
    digest = F.when(F.col("kind") == 6, F.lit("0" * 64)).otherwise(F.sha2("content", 256))
    size = F.when(F.col("kind") == 4, F.lit(60_000_000)).otherwise(F.octet_length("content"))
    file = F.struct(F.lit("sdist").alias("packagetype"), url.alias("url"), F.col("file_name").alias("filename"), size.cast("long").alias("size"), F.struct(digest.alias("sha256")).alias("digests"))
    listed = F.array(file)
    none = F.filter(listed, lambda f: F.lit(False))
    info = F.struct(
        F.concat(F.lit("examplepackage-"), F.col("key").cast("string")).alias("name"), "version", F.lit("a package of some length").alias("summary"), F.lit("someone").alias("author"),
        F.lit("https://example.org").alias("home_page"), F.lit("1990-01-01T00:00:00Z").alias("upload_time"),
    )
    elsewhere = F.col("kind").isin(3, 12)
    releases = F.when(F.col("kind") == 12, F.create_map("version", listed)).otherwise(F.create_map(F.lit("0"), none))
    body = F.to_json(F.named_struct(F.lit("info"), info, F.lit("urls"), F.when(elsewhere, none).otherwise(listed), F.lit("releases"), releases))
    body = F.when(F.col("kind") == 2, F.lit("not json")).otherwise(body)
    status = F.when(F.col("kind") == 0, F.lit(404)).when(F.col("kind") == 1, F.lit(503)).otherwise(F.lit(200))
    told = made.select(info["name"].alias("name"), F.explode(F.array(F.lit(None).cast("string"), F.col("version"))).alias("version"), status.alias("status"), body.alias("body"))
    return told, made.where("kind <> 5").select(url.alias("url"), "content")
