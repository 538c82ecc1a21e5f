"""Landing of files and batches: bad lines kept, counts taken while rows are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableward.plans.catalog.bronze import SPEC, SPLIT
from tableward.plans.inputs import dirty_events
from tableward.plans.registry import query
from tableward.sources import readers, sinks
from tableward.sources.folders import scratch_folder

LINE_DDL = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate date, o_orderpriority string"


def order_lines(t):
    """Orders as CSV lines: some cut short, some with a cell too many, some with a cell of another type."""
    k = F.col("o_orderkey")
    date = F.when(k % 19 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(k % 17 == 0, F.lit("n/a")).when(k % 23 == 0, F.lit("")).otherwise(F.col("o_totalprice").cast("string"))
    last = F.when(k % 5 == 0, F.concat(F.lit('"'), "o_orderpriority", F.lit(', as asked"'))).otherwise(F.col("o_orderpriority"))
    cells = [k.cast("string"), F.col("o_custkey").cast("string"), price, date, F.when(k % 11 != 0, last),
             F.when((k % 11 != 0) & (k % 13 == 0), F.lit("more"))]
    return t.orders.select(F.concat_ws(",", *cells).alias("line"))


@query("scan_csv_bad_records", """WITH lines AS (SELECT o_orderkey AS k, o_custkey, o_totalprice, CASE
    WHEN o_orderkey % 11 = 0 THEN 'short' WHEN o_orderkey % 13 = 0 THEN 'long' WHEN o_orderkey % 17 = 0 THEN 'type:o_totalprice'
    WHEN o_orderkey % 19 = 0 THEN 'type:o_orderdate' ELSE 'good' END AS reason FROM orders)
SELECT reason, count(*) AS lines, CAST(sum(k) AS BIGINT) AS keys,
  CASE WHEN reason = 'good' THEN count(*) FILTER (WHERE k % 23 <> 0) END AS priced,
  CASE WHEN reason = 'good' THEN count(*) FILTER (WHERE k % 5 = 0) END AS quoted
FROM lines GROUP BY reason""")
def scan_csv_bad_records(t):
    """Every line of a CSV folder is either a typed record or kept with its file and reason."""
    folder = scratch_folder(t.spark, "lines")
    order_lines(t).write.text(folder)
    good, bad = readers.land_csv(t.spark, folder, scratch_folder(t.spark, "landed"), LINE_DDL, header=False)
    whole = good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("lines"), F.sum("o_orderkey").alias("keys"),
                     F.count("o_totalprice").alias("priced"), F.count_if(F.col("o_orderpriority").endswith(", as asked")).alias("quoted"))
    lost = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.split("line", ",")[0].cast("bigint")).alias("keys"))
    return whole.unionByName(lost, allowMissingColumns=True)


@query("split_metrics", SPLIT + """,
counted AS (
  SELECT 'all' AS scope, '*' AS value, count(*) AS rows FROM flagged
  UNION ALL SELECT 'clean', '*', count(*) FROM flagged WHERE NOT (h1 OR h2 OR h3 OR h4)
  UNION ALL SELECT 'held', '*', count(*) FROM flagged WHERE h1 OR h2 OR h3 OR h4
  UNION ALL SELECT 'code', 'DV-002', count(*) FROM flagged WHERE h1 OR h2
  UNION ALL SELECT 'code', 'DV-003', count(*) FROM flagged WHERE h3
  UNION ALL SELECT 'code', 'DV-004', count(*) FROM flagged WHERE h4
  UNION ALL SELECT 'check', 'null_required:value', count(*) FROM flagged WHERE h1
  UNION ALL SELECT 'check', 'null_required:event_type', count(*) FROM flagged WHERE h2
  UNION ALL SELECT 'check', 'type:value_text', count(*) FROM flagged WHERE h3
  UNION ALL SELECT 'check', 'range:value', count(*) FROM flagged WHERE h4)
SELECT 'batch-1' AS batch_id, scope, value, rows, CASE scope WHEN 'clean' THEN rows WHEN 'held' THEN rows END AS stored FROM counted
WHERE rows > 0 OR scope IN ('all', 'clean', 'held')""")
def split_metrics(t):
    """Counts observed while a batch is split and written, beside what lies in the folder afterwards."""
    folder = scratch_folder(t.spark, "split")
    seen = sinks.write_split(dirty_events(t), SPEC, ["event_id"], folder, "batch-1")
    kept = [sinks.split_rows(t.spark, folder, held).agg(F.lit(scope).alias("scope"), F.count(F.lit(1)).alias("stored"))
            for scope, held in (("clean", False), ("held", True))]
    return seen.join(kept[0].unionByName(kept[1]), "scope", "left").select("batch_id", "scope", "value", "rows", "stored")
