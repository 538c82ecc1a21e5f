"""Append tables for results, quarantine, audit rows, alerts and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.functions.predicates import row_key
from tableward.operators.bronze import BatchSpec, hit_codes, row_checks


def append_by_day(df: DataFrame, path: str, ts: str) -> None:
    """Append to a table partitioned by date.

    Rows are first gathered per date, in as many tasks as the data needs, so that a day gets few
    files; adaptive execution splits a day too large for one.
    """
    dated = df.withColumn("date", F.to_date(ts))
    dated.hint("rebalance", "date").write.partitionBy("date").mode("append").parquet(path)


def append_audit(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append JSON lines, one folder per day."""
    dated = df.withColumn("date", F.to_date(ts))
    dated.hint("rebalance", "date").write.partitionBy("date").mode("append").json(path)


def append_quarantine(df: DataFrame, path: str) -> None:
    """Quarantined rows by batch; the record travels as JSON so that any table fits."""
    rows = df.withColumn("record", F.to_json("record"))
    rows.hint("rebalance", "batch_id").write.partitionBy("batch_id").mode("append").parquet(path)


def release(spark: SparkSession, path: str, released_path: str, released_keys: DataFrame) -> DataFrame:
    """Move rows out of quarantine by appending them to a table of released rows.

    Nothing is rewritten: what is still held is the quarantine without the released keys.  Keys that
    were released before are left alone, so a repeated call adds nothing.
    """
    held = still_held(spark, path, released_path)
    freed = held.join(released_keys.select("batch_id", "row_key").distinct(), ["batch_id", "row_key"], "left_semi")
    freed.write.mode("append").parquet(released_path)
    return still_held(spark, path, released_path)


def still_held(spark: SparkSession, path: str, released_path: str) -> DataFrame:
    held = spark.read.parquet(path)
    try:
        released = spark.read.parquet(released_path)
    except AnalysisException as e:
        # Nothing released yet: no folder, or one without files.
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return held
    return held.join(released.select("batch_id", "row_key").distinct(), ["batch_id", "row_key"], "left_anti")


def save_baseline(df: DataFrame, path: str, name: str) -> None:
    """Keep a baseline under a name; one that is there under this name is replaced, others stay."""
    df.withColumn("baseline", F.lit(name)).write.partitionBy("baseline").option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A baseline by name.  Numeric and categorical ones may share a store: each keeps its columns."""
    return spark.read.option("basePath", path).parquet(f"{path}/baseline={name}").drop("baseline")


def export_csv(df: DataFrame, path: str) -> None:
    whole = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode("errorifexists").options(
        header=True, timestampFormat=whole + "XXX", timestampNTZFormat=whole).csv(path)


def write_split(df: DataFrame, spec: BatchSpec, keys: Sequence[str], path: str, batch_id: str) -> DataFrame:
    """Write clean and quarantined rows of a batch by one plan and count them as they pass.

    Rows go to ``path``, partitioned by ``batch_id`` and ``held``; writing a batch again replaces it.  Returns
    (batch_id, scope, value, rows): all rows, clean and held ones, held ones per failure code and per check.  The counts are
    observed while the rows are written, after the last shuffle, so they need no further scan.
    """
    marked = hit_codes(df, spec)
    held = F.size("codes") > 0
    rows = marked.select(
        row_key(*keys).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
        F.col("codes").alias("failure_codes"), F.col("reasons").alias("_reasons"),
        F.lit(batch_id).alias("batch_id"), held.alias("held"))
    names = [c.id for c in row_checks(df, spec)] + ["count:*"]
    if spec.duplicates:
        names.append(f"duplicate:{','.join(spec.duplicates.keys) or '*'}")
    codes = sorted({c.code for c in row_checks(df, spec)} | {"DV-001", "DV-006"})
    counts = {("all", "*"): F.count(F.lit(1)), ("clean", "*"): F.count_if(~F.col("held")), ("held", "*"): F.count_if("held")}
    counts |= {("code", c): F.count_if(F.array_contains("failure_codes", c)) for c in codes}
    counts |= {("check", c): F.count_if(F.array_contains("_reasons", c)) for c in names}
    seen = Observation()
    watched = rows.observe(seen, *[count.alias(f"m{i}") for i, count in enumerate(counts.values())])
    made = watched.withColumn("reason", F.array_join("_reasons", "; ")).drop("_reasons")
    made.write.partitionBy("batch_id", "held").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    found = [(batch_id, scope, value, seen.get[f"m{i}"]) for i, (scope, value) in enumerate(counts)]
    kept = [row for row in found if row[3] or row[1] in ("all", "clean", "held")]
    return df.sparkSession.createDataFrame(kept, "batch_id string, scope string, value string, rows bigint")


def split_rows(spark: SparkSession, path: str, held: bool) -> DataFrame:
    """What ``write_split`` wrote: clean rows as they were, or quarantined ones with codes and reason."""
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name not in ("batch_id", "held")]
    # Names of folders are text: a batch 007 is not batch 7.
    whole = T.StructType([*fields, T.StructField("batch_id", T.StringType()), T.StructField("held", T.BooleanType())])
    rows = spark.read.schema(whole).parquet(path).filter(F.col("held") == held)
    return rows.select("batch_id", "row_key", "record", "failure_codes", "reason") if held else rows.select("record.*")
