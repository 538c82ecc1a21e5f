"""Continuous validation of arriving files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tableward.functions.predicates import seconds_between
from tableward.operators.bronze import BatchSpec, quarantine, quarantine_groups, validate_batch, validate_groups


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet",
                pattern: str | None = None, files_per_batch: int | None = None, file_column: str | None = None,
                **options) -> DataFrame:
    """New files of a folder, each taken once; the checkpoint of the query remembers which.

    ``file_column`` names a column that holds the path of each row's file.
    """
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(folder)
    return rows.withColumn(file_column, F.col("_metadata.file_path")) if file_column else rows


def validate_stream(stream: DataFrame, spec: BatchSpec, keys: Sequence[str], out: str, checkpoint: str,
                    prepare: Callable[[DataFrame], DataFrame] = lambda df: df, every: str | None = None,
                    notify: Callable[[DataFrame, int], None] | None = None, by: Sequence[str] = ()) -> StreamingQuery:
    """Run the batch suite on each micro-batch: findings and quarantine, tagged with its number.

    With ``by`` (such as the file column of ``file_stream``) every group of a micro-batch is judged on its
    own: a micro-batch of three files gives three results, as three micro-batches would.
    A batch repeated after a failure overwrites its own folders, so nothing appears twice.
    Without ``every`` the query takes what is there and stops.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = prepare(batch).persist()
        tag = F.lit(number).cast("bigint").alias("batch_id")
        judged = validate_groups(rows, spec, by) if by else validate_batch(rows, spec)
        findings = judged.select(tag, "*")
        findings.drop("batch_id").write.mode("overwrite").parquet(f"{out}/findings/batch_id={number}")
        held = (quarantine_groups(rows, spec, by, keys) if by else quarantine(rows, spec, keys)).withColumn("record", F.to_json("record"))
        held.write.mode("overwrite").parquet(f"{out}/quarantine/batch_id={number}")
        if notify:
            notify(findings, number)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def window_quality(df: DataFrame, ts: str, value: str, length: str, slide: str | None = None,
                   groups: Sequence[str] = (), lateness: str | None = None,
                   outlier: Column | None = None) -> DataFrame:
    """Rows, null share, mean and outlier share per event-time window, batch or streaming.

    On a stream ``lateness`` is the watermark after which a window is final.
    """
    source = df.withWatermark(ts, lateness) if lateness else df
    flag = outlier if outlier is not None else F.lit(False)
    return source.groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), *groups).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(value).isNull().cast("double")).alias("null_rate"),
        F.avg(value).alias("mean"), F.avg(flag.cast("double")).alias("outlier_rate"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
             *groups, "rows", "null_rate", "mean", "outlier_rate")


def sessions(df: DataFrame, ts: str, key: str, gap_seconds: int) -> DataFrame:
    """Activity sessions per key of a table: a pause of ``gap_seconds`` ends one.

    Rows closer than the gap always belong together, so each key is first reduced to one row per
    gap-long slice of time.  What is then ordered per key is bounded by the time span.
    """
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    part = F.floor(seconds_between(F.col(ts).cast("timestamp_ntz"), origin) / gap_seconds)
    slices = df.groupBy(key, part.alias("_part")).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(key).orderBy("_part")
    pause = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))
    fresh = F.coalesce(F.col("_lo") >= F.lag("_hi").over(order) + pause, F.lit(True))
    numbered = slices.withColumn("_fresh", fresh.cast("int")).withColumn(
        "_session", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_session").agg(
        F.min("_lo").alias("session_start"), (F.max("_hi") + pause).alias("session_end"),
        F.sum("_n").alias("rows")).drop("_session")


def stream_sessions(stream: DataFrame, ts: str, key: str, gap: str, lateness: str) -> DataFrame:
    """The same on a stream; a session is final once the watermark has passed its end."""
    return stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key).agg(
        F.count(F.lit(1)).alias("rows")).select(
        key, F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"), "rows")


def last_arrivals(stream: DataFrame, source: str, ts: str) -> DataFrame:
    """Newest arrival and row count per source; partial sums per micro-batch, then state."""
    return stream.groupBy(source).agg(F.max(ts).alias("last_arrival"), F.count(F.lit(1)).alias("arrivals"))
