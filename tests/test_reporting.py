import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tableward.functions import chains
from tableward.operators import health as H
from tableward.operators import reporting as RP


def brute_groups(times, width):
    left, groups = sorted(times, reverse=True), []
    while left:
        anchor = left[0]
        members = [t for t in left if anchor - t <= width]
        left = left[len(members):]
        if len(members) > 1:
            groups.append((anchor, len(members)))
    return sorted(groups)


@pytest.fixture()
def ranges(spark, request):
    """So many ranges, also for few rows."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(request.param)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, ranges", [(1, 1), (2, 2), (3, 5), (4, 13), (5, 30)], indirect=["ranges"])
def test_event_groups_against_brute_force(spark, seed, ranges):
    rnd, zero = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(b, zero + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 600), rnd.randint(0, 9000)]), microseconds=rnd.randint(0, 1) * 5))
            for b in ("a", "b") for _ in range(150)] + [("", zero), (None, zero)]
    got = RP.event_groups(spark.createDataFrame(rows, "batch_id string, ts timestamp_ntz"), 60)
    for batch in ("a", "b"):
        want = brute_groups([t for b, t in rows if b == batch], dt.timedelta(seconds=60))
        assert sorted((r["group_ts"], r["events"]) for r in got.filter(F.col("batch_id") == batch).collect()) == want
    assert got.filter("batch_id = ''").count() == 0


def test_chain_helper_passes_the_bound_through_an_empty_reach():
    import numpy as np

    steps = chains.transfer(np.array([100, 130]), 160, 60)
    assert chains.enter(steps, 90) == 90 and chains.enter(steps, chains.END) == 70
    assert chains.label(np.array([100, 130]), 110, 60).tolist() == [100, 170]


def test_impact_falls_back_when_a_placeholder_is_unknown(spark):
    rows = [("1", "DV-003", "CRITICAL", 5, {}, "x"), ("2", "DV-003", "INFO", 5, {"expected_type": "int", "actual_type": "text"}, "x"),
            ("3", "BL-001", "WARNING", 500, {}, "cause")]
    df = spark.createDataFrame(rows, "anomaly_id string, failure_code string, severity string, affected_count bigint, details map<string,string>, root_cause string"
                               ).withColumn("affected_fields", F.array(F.lit("f")))
    got = {r["anomaly_id"]: r for r in RP.impact_report(df).collect()}
    assert got["1"]["business_description"] == "Data format does not match expected type." and got["1"]["estimated_impact"] == "High"
    assert got["2"]["business_description"] == "f contains invalid data type in 5 records. Expected int but found text."
    assert got["3"]["business_description"] == "cause" and got["3"]["affected_segments"] == ["Enterprise", "Small Business"]


def test_health_components(spark):
    rows = [("DV-002", "CRITICAL", 50), ("DV-002", "WARNING", 0), ("XX-001", "INFO", 10)]
    df = spark.createDataFrame(rows, "failure_code string, severity string, affected_count bigint")
    row = H.batch_health(df, [], F.lit(100)).first()
    assert row["completeness"] == 100 - (30 * 1.5 + 15) and row["timeliness"] == 100 - 5 * 1.1
    assert row["overall_score"] == pytest.approx(0.25 * 40 + 0.25 * 100 + 0.2 * 100 + 0.15 * 100 + 0.15 * 94.5)


def test_history_reaches_as_far_as_asked(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [("s", now - dt.timedelta(hours=h), float(h)) for h in range(300)] + [("t", now - dt.timedelta(hours=170), 1.0)]
    df = spark.createDataFrame(rows, "scope string, ts timestamp_ntz, score double")
    got = H.recent_history(df, ["scope"], "ts", "score", F.lit(str(now)).cast("timestamp_ntz"), hours=1000)
    assert got.count() == 101 and got.filter("scope = 's'").agg(F.min("ts")).first()[0] == now - dt.timedelta(hours=99)
    week = H.recent_history(df, ["scope"], "ts", "score", F.lit(str(now)).cast("timestamp_ntz"), keep=1000)
    assert week.count() == 169


def test_layers_without_findings_score_full(spark):
    df = spark.createDataFrame([("SC-001", "CRITICAL", "b"), ("ET-001", "INFO", "b")], "failure_code string, severity string, batch_id string")
    row = H.batch_results(df, ["batch_id"]).first()
    assert (row["passed"], row["blocked"], row["silver_health"], row["gold_overall"]) == (False, True, 70.0, 97.0)
    assert row["silver_overall"] == pytest.approx(90.0)
