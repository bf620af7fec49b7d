"""Places in a total order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import PRIORITY_FILES, file_name
from ..sources.shared import written


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with the place of each row (from 1) in ``order``, which must tell all rows apart where their places matter.

    Rows go to ranges of the order and are sorted there; a row's place is that in its range
    plus the rows of earlier ranges, one count a range. The ranges are written once, since
    they come from a sample.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = written(sorted_rows.withColumns({"_range": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    counts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(counts, "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def reading_order(findings: DataFrame) -> list[Column]:
    """Package by package: static findings of files that matter most, of other files by path, in a file by rule or place; then the other layers."""
    first = F.when(F.col("source_file").isNotNull() & ~file_name(F.col("source_file")).isin(*PRIORITY_FILES), F.lit(1)).otherwise(F.lit(0))
    static = F.when(F.col("layer") == "static", F.lit(0)).when(F.col("layer") == "metadata", F.lit(1)).otherwise(F.lit(2))
    return [F.col("package_id"), static, first, F.col("source_file"), F.col("finding_seq"), F.col("pattern_id")]


def in_order(findings: DataFrame) -> DataFrame:
    """``findings`` with finding_seq as their places in reading order, over all packages."""
    found = numbered(findings, reading_order(findings))
    return found.withColumn("finding_seq", F.col("position")).drop("position")
