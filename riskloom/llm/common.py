"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but the six ASCII white-space characters.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

#: Characters that a Python task holds decoded at once; longer texts come alone.
SLICE_CHARS = 1 << 20

#: Bytes of rows that a Python task gets at once.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests), a temporary folder is set for it; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Python gets Arrow batches of BATCH_BYTES at most, unless the session names a lower bound.

    Spark bounds batches by rows alone, so that long texts add up to far more than a task needs at once.
    """
    digits = "".join(filter(str.isdigit, spark.conf.get(BATCH_KEY, None) or ""))
    if not digits or int(digits) == 0 or int(digits) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, so that an executor lost later costs a re-read and
    not a recomputation. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskloom-{uuid.uuid4().hex}"
    bounded_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def slices(lengths: list[int], budget: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into runs [lo, hi) of about ``budget`` summed length."""
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > budget:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def text_slices(batch, column: int = 1, budget: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Runs [lo, hi) of the rows of an Arrow batch with their texts, of about ``budget`` bytes; null counts as empty."""
    texts = batch.column(column)
    for lo, hi in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), budget):
        yield lo, hi, [t or "" for t in texts[lo:hi].to_pylist()]


def with_text(batch, column: int = 1) -> list[str]:
    """The text column of an Arrow batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
