import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableward.functions import cron
from tableward.operators import freshness as FR

NOW = dt.datetime(2024, 1, 31, 12, 0)


def now():
    return F.lit(str(NOW)).cast("timestamp_ntz")


def test_cron_fields():
    s = cron.parse("*/15 8-10 1,15 * 1-5/2")
    assert (s.minutes, s.hours, s.days, s.weekdays) == ((0, 15, 30, 45), (8, 9, 10), (1, 15), (1, 3, 5))
    assert not s.any_day and not s.any_weekday and cron.parse("0 0 * * 7").weekdays == (0,)
    for bad in ("* * * *", "61 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *"):
        assert cron.parse(bad) is None


def brute_previous(expression):
    s, t = cron.parse(expression), NOW - dt.timedelta(minutes=1)
    while True:
        day, week = t.day in s.days, (t.weekday() + 1) % 7 in s.weekdays
        match = (True if s.any_day and s.any_weekday else week if s.any_day else day if s.any_weekday else day or week)
        if t.minute in s.minutes and t.hour in s.hours and t.month in s.months and match:
            return t
        t -= dt.timedelta(minutes=1)


SCHEDULES = ["0 * * * *", "*/15 * * * *", "0 12 * * *", "0 6 * * *", "30 8-18/2 * * 1-5", "0 0 1,15 * 1", "5 4 29 2 *", "0 0 31 * *"]


def test_previous_tick_against_brute_force(spark):
    slas = FR.sla_table(spark, [FR.Sla(s, s, s) for s in SCHEDULES] + [FR.Sla("bad", "bad", "nonsense")])
    got = {r["source"]: r["t"] for r in slas.select("source", FR.previous_tick(now()).alias("t")).collect()}
    assert got.pop("bad") == NOW - dt.timedelta(hours=1)
    assert got == {s: brute_previous(s) for s in SCHEDULES}


@pytest.mark.parametrize("age, status", [(30, "OK"), (65, "WARNING"), (100, "CRITICAL"), (None, "CRITICAL")])
def test_staleness(spark, age, status):
    slas = FR.sla_table(spark, [FR.Sla("s", "orders")])
    rows = [] if age is None else [("orders", NOW - dt.timedelta(minutes=age))]
    last = FR.last_arrivals(spark.createDataFrame(rows, "source string, ts timestamp_ntz"))
    assert FR.freshness_status(slas, last, now()).first()["status"] == status


def test_misses_in_a_row(spark):
    slas = FR.sla_table(spark, [FR.Sla("s", "orders", "0 * * * *")])
    hours = [0, 1, 4, 7]
    arrivals = spark.createDataFrame([("orders", dt.datetime(2024, 1, 1, h, 10)) for h in hours], "source string, ts timestamp_ntz")
    at = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp_ntz")
    runs = FR.missed_deliveries(FR.arrivals_per_tick(slas, arrivals, at(0), at(8)))
    got = sorted((r["first_missed"].hour, r["consecutive_misses"], r["failure_code"]) for r in runs.collect())
    assert got == [(2, 2, "FR-005"), (5, 2, "FR-005"), (8, 1, None)]


def test_stalled_run_names_the_stage_that_waits(spark):
    t = dt.datetime(2024, 1, 31, 11, 0)
    rows = [("p", "a", 1, t, t, "COMPLETED"), ("p", "b", 2, None, None, "PENDING"), ("p", "c", 3, None, None, "PENDING"),
            ("q", "a", 1, t, NOW - dt.timedelta(minutes=5), "COMPLETED"), ("q", "b", 2, None, None, "PENDING")]
    df = spark.createDataFrame(rows, "pipeline_id string, stage string, seq int, started_at timestamp_ntz, completed_at timestamp_ntz, status string")
    got = FR.stalled_stages(df, ["seq"], now()).collect()
    assert [(r["pipeline_id"], r["after_stage"], r["stalled_stage"]) for r in got] == [("p", "a", "b")]


def test_dependency_gate(spark):
    rows = [("s", "d1", 1, False, "LATE", 60), ("s", "d2", 2, True, "LATE", 60), ("s", "d3", 3, True, "FAILED", 60),
            ("t", "d1", 1, True, "OK", 0)]
    df = spark.createDataFrame(rows, "source string, dependency_id string, seq int, blocking boolean, status string, delay_seconds bigint")
    got = {r["source"]: (r["can_proceed"], r["blocked_by"], r["late"]) for r in FR.dependency_gate(df, ["seq"]).collect()}
    assert got == {"s": (False, "d2", 3), "t": (True, None, 0)}
    assert FR.dependency_score(df).first()["score"] == 50.0


def test_two_deadlines_of_one_source_do_not_share_arrivals(spark):
    slas = FR.sla_table(spark, [FR.Sla("hourly", "s", "0 * * * *"), FR.Sla("daily", "s", "0 0 * * *")])
    at = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp_ntz")
    arrivals = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, h, 5)) for h in (0, 2)], "source string, ts timestamp_ntz")
    got = {(r["sla_id"], r["tick"].hour): r["arrivals"] for r in FR.arrivals_per_tick(slas, arrivals, at(0), at(3)).collect()}
    assert got == {("hourly", 0): 1, ("hourly", 1): 0, ("hourly", 2): 1, ("hourly", 3): 0, ("daily", 0): 2}


def test_leap_days_around_a_century(spark):
    slas = FR.sla_table(spark, [FR.Sla("leap", "s", "0 0 29 2 *")])
    as_of = F.lit("2104-02-01 00:00:00").cast("timestamp_ntz")
    assert slas.select(FR.previous_tick(as_of).alias("t")).first()["t"] == dt.datetime(2096, 2, 29)
