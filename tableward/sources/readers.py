"""Scans of batches, reference data and history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV with every value a string and empty text null.

    ``multi_line`` allows quoted line breaks; such a file is read by one task.
    """
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="", multiLine=multi_line)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a given schema, or one inferred from the data by an extra pass.

    With a schema, lines that do not fit it keep their text in ``_corrupt_record`` when the
    schema names that column.
    """
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.csv(path, header=True, schema=schema, columnNameOfCorruptRecord="_corrupt_record")


def read_json_batch(spark: SparkSession, path: str, form: str = "json",
                    schema: T.StructType | str | None = None) -> DataFrame:
    """JSON records: bare objects, arrays of them, or objects holding ``records`` or ``data``.

    ``json``: every file is one document, laid out in any way.  ``jsonl``: every line is one; such
    files split across tasks.
    """
    if form not in ("json", "jsonl"):
        raise ValueError(f"json or jsonl, not {form}")
    reader = spark.read.option("multiLine", form == "json")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    for envelope in ("records", "data"):
        if envelope in df.columns and isinstance(df.schema[envelope].dataType, T.ArrayType):
            return df.select(F.inline(envelope))
    return df


def read_reference(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Reference records from CSV, JSON or JSON lines."""
    if kind == "csv":
        return read_csv_text(spark, path)
    return read_json_batch(spark, path, kind)


def read_history(spark: SparkSession, path: str, since: str | None = None, until: str | None = None,
                 where: str | None = None, newest_by: str | None = None, limit: int | None = None) -> DataFrame:
    """A date-partitioned table.  Dates select partitions; ``limit`` keeps the newest rows."""
    df = spark.read.parquet(path)
    if since:
        df = df.filter(F.col("date") >= F.lit(since).cast("date"))
    if until:
        df = df.filter(F.col("date") <= F.lit(until).cast("date"))
    if where:
        df = df.filter(where)
    if newest_by:
        df = df.orderBy(F.col(newest_by).desc())
    return df.limit(limit) if limit else df


def read_audit(spark: SparkSession, path: str, schema: str, kinds: Sequence[str] = ()) -> DataFrame:
    """Day-partitioned JSON lines; unreadable lines are left to ``unreadable_audit``."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.filter(F.col("event_type").isin(*kinds)) if kinds else df


def unreadable_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that ``read_audit`` leaves out, per file: (file, lines)."""
    whole = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # The marker alone cannot be asked of a JSON scan: read with the columns around it.
    marked = whole.select(F.input_file_name().alias("file"), F.struct(*whole.columns).alias("_all"))
    return marked.filter(F.col("_all._corrupt_record").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


_QUOTED = '"(?:[^"]|"")*"'


def read_csv_marked(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """Every line of CSV, good or bad, in one read: (file, record, line, reason).

    A good line has its typed ``record``; ``line`` and ``reason`` are null.  A bad one has its text and why it does
    not fit: ``short`` or ``long`` (cells against columns), ``type:<column>`` for the first cell that is not of its
    type, ``unreadable`` otherwise; its ``record`` is null.  Empty cells are null and fit every type.  Empty lines are
    none.  Without a schema all columns are text, named by the header, so lines can only be short, long or unreadable.
    A quote in a quoted cell is doubled.  Quoted line breaks are not supported, as a line is what splits across tasks.
    Every cell is read whatever columns are asked for later: a line does not become good by looking at part of it.
    """
    if schema is None:
        if not header:
            raise ValueError("without a header the columns need a schema")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in spark.read.csv(path, header=True).columns])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = [f.name for f in schema.fields]
    mark = "_corrupt_record"
    while mark in names:
        mark = f"_{mark}"
    whole = T.StructType([*schema.fields, T.StructField(mark, T.StringType())])
    rows = spark.read.csv(path, header=header, schema=whole, mode="PERMISSIVE", nullValue="", escape='"', columnNameOfCorruptRecord=mark)
    # Always true, but not to the optimizer: it would drop unused columns from the scan, and their faults with them.
    whole_line = F.xxhash64(*[F.col(f"`{c}`") for c in names]) >= -2**63
    held = rows.select(F.col("_metadata.file_path").alias("file"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("record"),
                       F.when(whole_line, F.col(f"`{mark}`")).alias("line"))
    cells = F.size(F.split(F.regexp_replace("line", _QUOTED, ""), ",", -1))
    texts = F.from_csv("line", ", ".join(f"c{i} string" for i in range(len(names))), {"mode": "PERMISSIVE", "nullValue": "", "escape": '"'})
    mistyped = [F.when(F.col("record").getField(f.name).isNull() & texts[f"c{i}"].isNotNull(), F.lit(f"type:{f.name}"))
                for i, f in enumerate(schema.fields) if not isinstance(f.dataType, T.StringType)]
    reason = F.when(cells < len(names), "short").when(cells > len(names), "long").otherwise(
        F.coalesce(*mistyped, F.lit("unreadable")))
    bad = F.col("line").isNotNull()
    return held.select("file", F.when(~bad, F.col("record")).alias("record"), "line", F.when(bad, reason).alias("reason"))


def good_records(marked: DataFrame) -> DataFrame:
    return marked.filter("reason IS NULL").select("record.*")


def bad_records(marked: DataFrame) -> DataFrame:
    return marked.filter("reason IS NOT NULL").select("file", "line", "reason")


def land_csv(spark: SparkSession, path: str, out: str, schema: T.StructType | str | None = None,
             header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Read CSV once and write good records and bad lines side by side; both are read back."""
    marked = read_csv_marked(spark, path, schema, header)
    marked.withColumn("bad", F.col("reason").isNotNull()).write.partitionBy("bad").parquet(out)
    landed = spark.read.schema(T.StructType([*marked.schema.fields, T.StructField("bad", T.BooleanType())])).parquet(out)
    return good_records(landed.filter("NOT bad")), bad_records(landed.filter("bad"))
