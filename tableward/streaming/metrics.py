"""Counts observed while a stream runs, without a scan of their own."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tableward.operators.bronze import BatchSpec, RowCheck, row_checks

METRICS_DDL = "batch_id bigint, check_name string, failure_code string, field string, affected_count bigint, total_count bigint"


def watch(stream: DataFrame, spec: BatchSpec, name: str = "quality") -> DataFrame:
    """The same stream, with the row checks of ``spec`` counted as each micro-batch passes.

    Checks of whole batches (duplicates, outliers, row count) are no counts over rows and stay with ``validate_stream``.
    """
    counts = [F.count_if(c.violated).alias(f"n{i}") for i, c in enumerate(row_checks(stream, spec))]
    return stream.observe(name, F.count(F.lit(1)).alias("total"), *counts)


def findings(seen: Row, checks: Sequence[RowCheck], batch: int) -> list[tuple]:
    """One micro-batch's counts as rows of ``METRICS_DDL``."""
    return [(batch, c.name, c.code, c.field, seen[f"n{i}"], seen["total"]) for i, c in enumerate(checks)]


class Watcher(StreamingQueryListener):
    """Hands the observed counts of every micro-batch with rows to ``report``, as they come.

    ``report`` gets the rows of ``findings`` and runs on the driver, a few rows a micro-batch.  A micro-batch
    that is repeated after a failure reports its number again: keep one by number.
    """

    def __init__(self, stream: DataFrame, spec: BatchSpec, report: Callable[[list[tuple]], None], name: str = "quality"):
        self.checks, self.report, self.name = row_checks(stream, spec), report, name
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _event(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._event(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and seen["total"]:
            self.report(findings(seen, self.checks, event.progress.batchId))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._event(str(event.runId)).set()

    def drained(self, query: StreamingQuery, seconds: float = 60.0) -> bool:
        """Wait until everything a finished query observed has been reported."""
        return self._event(str(query.runId)).wait(seconds)


def run_watched(spark: SparkSession, stream: DataFrame, spec: BatchSpec, out: str, checkpoint: str) -> DataFrame:
    """Write a stream to ``out`` until it has seen everything, and return what was observed on the way:
    one row per micro-batch and check."""
    rows: dict[int, list[tuple]] = {}
    watcher = Watcher(stream, spec, lambda found: rows.__setitem__(found[0][0], found))
    spark.streams.addListener(watcher)
    try:
        query = watch(stream, spec).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        if not watcher.drained(query):
            raise TimeoutError("the counts of the last micro-batches did not arrive")
    finally:
        spark.streams.removeListener(watcher)
    return spark.createDataFrame([row for found in rows.values() for row in found], METRICS_DDL)
