"""Trace lines as a stream. An extension: the batch parser is the one to compare with."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.trace import KINDS, binary_of, canary_of, endpoint_of
from ..sources.files import CANARIES

#: How long after its end lines of a run may still come.
GRACE = timedelta(minutes=10)

#: The last line of a run: its process has ended.
ENDED = r"^\+\+\+ (?:exited with|killed by) .* \+\+\+$"

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hits() -> Column:
    """kind and value of what a line tells; one line tells one thing at most of each kind."""
    values = (canary_of(F.col("line"), list(CANARIES)), endpoint_of(F.col("line")), binary_of(F.col("line")))
    return F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in zip(KINDS, values, strict=True))))


def stream_accesses(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """package_id, kind, value and ts where first seen within the watermark, from streamed (package_id, ts, line).

    State is bounded by the delay: a value that comes again later than that is told again.
    """
    rows = lines.withWatermark("ts", delay).select("package_id", "ts", F.inline(hits()))
    return rows.dropDuplicatesWithinWatermark(["package_id", "kind", "value"])


class FirstOfRun(StatefulProcessor):
    """Tells each value of a run once. What a run has told is forgotten when it has ended and the grace is over."""

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "kind string, value string", "line_no long")
        self.over = handle.getValueState("over", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, ended = timerValues.getCurrentWatermarkInMs(), None
        for row in rows:
            at = int(row.ts.timestamp() * 1000)
            if at <= now:
                continue  # the run may be forgotten by now
            if row.kind is None:
                ended = max(at, ended or 0)
            elif not self.seen.containsKey((row.kind, row.value)):
                self.seen.updateValue((row.kind, row.value), (row.line_no,))
                yield Row(package_id=key[0], run_id=key[1], kind=row.kind, value=row.value, line_no=row.line_no, ts=row.ts)
        if ended is not None:
            before = self.over.get()[0] if self.over.exists() else None
            if before is not None:
                self.handle.deleteTimer(before)
            last = max(ended + self.grace_ms, before or 0)
            self.over.update((last,))
            self.handle.registerTimer(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        self.over.clear()
        return iter(())

    def close(self) -> None:
        pass


OUT = "package_id string, run_id string, kind string, value string, line_no long, ts timestamp"


def use_state_store(spark: SparkSession) -> None:
    """Streams of ``first_accesses`` keep their state in RocksDB, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def first_accesses(lines: DataFrame, delay: str = "10 minutes", grace: timedelta = GRACE) -> DataFrame:
    """package_id, run_id, kind, value, line_no and ts of every value of every run, once, where it first came.

    ``lines`` streams package_id, run_id, line_no, ts and line. A value that comes again is not
    told again, however much later, until its run ends; then state goes after ``grace``. Lines
    later than the watermark are dropped, and told so by Spark's own counts. Only lines that
    tell something or end a run reach the state. The session needs ``use_state_store``.
    """
    end = F.when(F.col("line").rlike(ENDED), F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))))
    told = F.inline(F.coalesce(end, hits()))
    rows = lines.withWatermark("ts", delay).select(F.col("package_id").cast("string"), F.col("run_id").cast("string"), F.col("line_no").cast("long"), "ts", told)
    processor = FirstOfRun(int(grace.total_seconds() * 1000))
    return rows.groupBy("package_id", "run_id").transformWithState(processor, OUT, outputMode="Append", timeMode="EventTime")
