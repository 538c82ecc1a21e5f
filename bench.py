"""Time the headline queries; prints one JSON line.

Each query runs once unmeasured, then ``BENCH_RUNS`` times; the median counts.  Results are
written to the ``noop`` sink, so every row and column is computed and none is fetched.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow.parquet as pq  # noqa: E402

from tableward import build_session  # noqa: E402
from tableward.plans.registry import Tables, load_all  # noqa: E402

# Query -> table whose rows it checks.
HEADLINE = {
    "dq_count": "events", "dq_null": "events", "dq_type": "events", "dq_range": "events",
    "dq_format": "customer", "dq_duplicate": "lineitem", "dq_encoding": "documents",
    "dq_outlier": "events", "validate_batch": "events", "quarantine_split": "events",
    "contract_validate": "orders", "contract_breaking": "lineitem", "rule_crossfield": "lineitem",
    "rule_report": "lineitem", "rule_state_transition": "orders", "rule_child_sum": "lineitem",
    "refint_lineitem_orders": "lineitem", "refint_cascade": "lineitem", "psi_numeric": "events",
    "drift_psi": "events", "drift_ks": "events", "feature_drift": "events",
    "sla_status": "events", "missed_deliveries": "events", "jobrun_stalled": "lineitem",
    "pii_scan": "documents", "pii_mask": "documents", "bias_report": "documents",
    "consent_check": "lineitem", "health_score": "events", "anomaly_stats": "events",
    "timeline_groups": "events", "run_tiers": "orders", "run_models": "events",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    seconds, speed = {}, {}
    for name, table in HEADLINE.items():
        times = []
        for run in range(repeats + 1):
            start = time.perf_counter()
            registry[name].build(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        rows = pq.ParquetFile(f"{folder}/{table}.parquet").metadata.num_rows
        speed[name] = round(rows / seconds[name])
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": speed, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
