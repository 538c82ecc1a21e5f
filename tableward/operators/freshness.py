"""Freshness, delivery deadlines and pipeline runs (layer 4).

``as_of`` is always given.  Arrivals are reduced per source, or per source and minute, before
anything else, so a source with very many arrivals costs no more than one with few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableward.functions import cron
from tableward.functions import severity as S
from tableward.functions.ordered import exact_percentiles, with_neighbour
from tableward.functions.predicates import seconds_between
from tableward.model import CRITICAL, WARNING


@dataclass(frozen=True)
class Sla:
    id: str
    source: str
    schedule: str = "0 * * * *"
    warning_minutes: int = 60
    critical_minutes: int = 90
    latency_seconds: int = 1800
    expected_count: int | None = None
    enabled: bool = True


SLA_DDL = (
    "sla_id string, source string, schedule string, warning_minutes int, critical_minutes int, "
    "latency_seconds int, expected_count bigint, enabled boolean, valid boolean, "
    "minutes array<int>, hours array<int>, days array<int>, months array<int>, "
    "weekdays array<int>, any_day boolean, any_weekday boolean"
)


def sla_table(spark: SparkSession, slas: Sequence[Sla]) -> DataFrame:
    """Deadline definitions with their schedules taken apart; configuration, so small."""
    rows = []
    for s in slas:
        c = cron.parse(s.schedule)
        parts = (list(c.minutes), list(c.hours), list(c.days), list(c.months), list(c.weekdays),
                 c.any_day, c.any_weekday) if c else (None,) * 7
        rows.append((s.id, s.source, s.schedule, s.warning_minutes, s.critical_minutes,
                     s.latency_seconds, s.expected_count, s.enabled, c is not None, *parts))
    return spark.createDataFrame(rows, SLA_DDL)


def _day_matches(day: Column) -> Column:
    """Month must match; when both day fields are restricted, either may."""
    by_day = F.array_contains("days", F.dayofmonth(day))
    by_week = F.array_contains("weekdays", F.dayofweek(day) - 1)
    either = F.when(F.col("any_day") & F.col("any_weekday"), F.lit(True)).when(
        F.col("any_day"), by_week).when(F.col("any_weekday"), by_day).otherwise(by_day | by_week)
    return F.array_contains("months", F.month(day)) & either


def _tick(day: Column, hour: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)


def calendar(slas: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every expected arrival between two times: matching days, times their hours and minutes."""
    days = F.filter(F.sequence(F.to_date("_start"), F.to_date("_end")), _day_matches)
    return (
        slas.filter("enabled AND valid")
        .withColumns({"_start": start, "_end": end}).withColumn("_day", F.explode(days))
        .withColumn("_hour", F.explode("hours")).withColumn("_minute", F.explode("minutes"))
        .withColumn("tick", _tick(F.col("_day"), F.col("_hour"), F.col("_minute")))
        .filter(F.col("tick").between(F.col("_start"), F.col("_end")))
        .select("sla_id", "source", "tick")
    )


def previous_tick(as_of: Column, years: int = 9) -> Column:
    """Last expected arrival strictly before ``as_of``; an invalid schedule counts as hourly.

    Only the two latest matching days can hold it.  No schedule that ever matches pauses longer than
    the eight years between leap days around a century, so nine years always hold its last day;
    a schedule that never matches (30 February) has no expected arrival.
    """
    back = F.sequence(F.to_date(as_of), F.date_sub(F.to_date(as_of), 366 * years), F.expr("interval -1 day"))
    days = F.slice(F.filter(back, _day_matches), 1, 2)
    ticks = F.flatten(F.transform(days, lambda d: F.flatten(F.transform(
        F.col("hours"), lambda h: F.transform(F.col("minutes"), lambda m: _tick(d, h, m))))))
    last = F.array_max(F.filter(ticks, lambda x: x < as_of))
    return F.when(F.col("valid"), last).otherwise(as_of - F.expr("interval 1 hour"))


def last_arrivals(arrivals: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    return arrivals.groupBy(F.col(source).alias("source")).agg(
        F.max(ts).alias("last_arrival"), F.count(F.lit(1)).alias("arrivals"))


def freshness_status(slas: DataFrame, last: DataFrame, as_of: Column) -> DataFrame:
    """Age of the newest arrival against the thresholds (FR-001); never arrived is critical."""
    joined = slas.join(last, "source", "left").withColumn(
        "age_seconds", seconds_between(as_of, F.col("last_arrival")))
    minutes = F.col("age_seconds") / 60.0
    status = F.when(F.col("last_arrival").isNull() | (minutes >= F.col("critical_minutes")), CRITICAL).when(
        minutes >= F.col("warning_minutes"), WARNING).otherwise("OK")
    return joined.select(
        "source", "sla_id", "warning_minutes", "last_arrival", "age_seconds", status.alias("status"),
        F.when(status != "OK", "FR-001").alias("failure_code"))


def sla_delays(slas: DataFrame, last: DataFrame, as_of: Column, measure: str = "arrival") -> DataFrame:
    """Delay against the previous expected arrival.

    ``arrival`` measures up to the arrival, or up to ``as_of`` while nothing came; ``now``
    always measures up to ``as_of`` and ignores sources that never delivered.
    """
    joined = slas.filter("enabled").withColumn("expected_at", previous_tick(as_of)).join(last, "source", "left")
    reached = F.coalesce(F.col("last_arrival"), as_of) if measure == "arrival" else as_of
    delay = F.greatest(F.lit(0), seconds_between(reached, F.col("expected_at")))
    if measure == "now":
        delay = F.when(F.col("last_arrival").isNull(), 0).otherwise(delay)
    return joined.withColumn("delay_seconds", delay.cast("bigint"))


def sla_status(slas: DataFrame, last: DataFrame, as_of: Column) -> DataFrame:
    """On track, at risk from half the warning threshold, breached from the full one."""
    delays = sla_delays(slas, last, as_of)
    minutes = F.col("delay_seconds") / 60.0
    status = F.when(minutes >= F.col("warning_minutes"), "BREACHED").when(
        minutes >= F.col("warning_minutes") / 2, "AT_RISK").otherwise("ON_TRACK")
    missing = F.col("last_arrival").isNull() & (
        seconds_between(as_of, F.col("expected_at")) > 1800)
    codes = F.array_compact(F.array(
        F.when(status == "BREACHED", "FR-002").when(status == "AT_RISK", "FR-003"),
        F.when(missing, "FR-005")))
    return delays.select("source", "sla_id", "expected_at", "last_arrival", "delay_seconds",
                         status.alias("status"), codes.alias("failure_codes"))


def sla_status_fixed(slas: DataFrame, last: DataFrame, as_of: Column, warning: int = 15,
                     breach: int = 30) -> DataFrame:
    """The watcher's variant: fixed limits on the time since the expected arrival."""
    delays = sla_delays(slas, last, as_of, measure="now")
    minutes = F.col("delay_seconds") / 60.0
    return delays.select(
        "source", "sla_id", "expected_at", "delay_seconds",
        F.when(minutes > breach, "FR-002").when(minutes > warning, "FR-003").alias("failure_code"),
        F.when(minutes > breach, CRITICAL).when(minutes > warning, WARNING).alias("severity"))


def arrivals_per_tick(slas: DataFrame, arrivals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Arrivals in each interval from one expected arrival of a deadline up to its next.

    Arrivals are first counted per source and minute, the resolution of a schedule; what is
    ordered afterwards is bounded by the time span, not by the number of arrivals.
    """
    ticks = calendar(slas, start, end)
    minutes = arrivals.groupBy("source", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at")).agg(
        F.count(F.lit(1)).alias("n"))
    # Every deadline of a source sees all of the source's arrivals.
    minutes = minutes.join(slas.filter("enabled AND valid").select("source", "sla_id"), "source")
    merged = ticks.select("source", "sla_id", F.col("tick").alias("at"), "tick", F.lit(0).cast("bigint").alias("n")).unionByName(
        minutes.select("source", "sla_id", "at", F.lit(None).cast("timestamp_ntz").alias("tick"), "n"))
    open_ticks = W.partitionBy("source", "sla_id").orderBy("at", F.col("tick").isNull()).rowsBetween(W.unboundedPreceding, 0)
    placed = merged.select("source", "sla_id", F.last("tick", ignorenulls=True).over(open_ticks).alias("tick"), "n")
    return placed.filter(F.col("tick").isNotNull()).groupBy("source", "sla_id", "tick").agg(F.sum("n").alias("arrivals"))


def missed_deliveries(per_tick: DataFrame) -> DataFrame:
    """Runs of consecutive expected arrivals that did not come; FR-005 from two in a row."""
    order = W.partitionBy("source", "sla_id").orderBy("tick")
    marked = per_tick.withColumn("_pos", F.row_number().over(order)).filter(F.col("arrivals") == 0)
    island = marked.withColumn("_run", F.col("_pos") - F.row_number().over(order))
    return island.groupBy("source", "sla_id", "_run").agg(
        F.min("tick").alias("first_missed"), F.max("tick").alias("last_missed"),
        F.count(F.lit(1)).alias("consecutive_misses"),
    ).drop("_run").withColumn("failure_code", F.when(F.col("consecutive_misses") >= 2, "FR-005"))


def open_misses(slas: DataFrame, last: DataFrame, as_of: Column, grace_seconds: int = 1800) -> DataFrame:
    """Expected arrivals since the last one that came (FR-005 from two), per deadline.

    A source that never delivered has missed its latest expected arrival, once ``grace_seconds`` have
    passed; how many before it is not known, so its count is null.
    """
    known = last.select("source", "last_arrival")
    open_slas = slas.filter("enabled AND valid").join(known, "source")
    due = calendar(open_slas, F.col("last_arrival"), as_of).join(known, "source")
    missed = due.filter(F.col("tick") > F.col("last_arrival")).groupBy("source", "sla_id").agg(
        F.count(F.lit(1)).alias("consecutive_misses")).filter("consecutive_misses >= 2")
    never = slas.filter("enabled").join(known.filter("last_arrival IS NOT NULL"), "source", "left_anti").filter(
        seconds_between(as_of, previous_tick(as_of)) > grace_seconds).select(
        "source", "sla_id", F.lit(None).cast("bigint").alias("consecutive_misses"))
    return missed.unionByName(never).withColumns({"failure_code": F.lit("FR-005"), "severity": F.lit(CRITICAL)})


def arrival_volume(slas: DataFrame, batches: DataFrame) -> DataFrame:
    """Records per arrived batch against the expected count of its source."""
    wanted = slas.filter("expected_count IS NOT NULL").select("source", "expected_count")
    joined = batches.join(wanted, "source")
    off = F.abs(F.col("records") - F.col("expected_count")) / F.col("expected_count") * 100
    score = S.banded(off, S.COUNT)
    return joined.filter(F.col("records") != F.col("expected_count")).select(
        "source", "batch", "records", "expected_count", off.alias("deviation_pct"),
        score.alias("severity_score"), S.level(score).alias("severity"))


# Pipeline runs --------------------------------------------------------------------------------

def fold_stages(events: DataFrame) -> DataFrame:
    """Lifecycle events (pipeline_id, stage, ts, status) to one row per stage."""
    started, ended = F.col("status") == "RUNNING", F.col("status").isin("COMPLETED", "FAILED")
    return events.groupBy("pipeline_id", "stage").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"),
        F.min(F.when(started, F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("completed_at"))


def runs(stages: DataFrame) -> DataFrame:
    """One row per run: complete once every stage is."""
    done = F.bool_and(F.col("completed_at").isNotNull())
    return stages.groupBy("pipeline_id").agg(
        F.min("started_at").alias("started_at"),
        F.when(done, F.max("completed_at")).alias("completed_at"),
        F.bool_or(F.col("status") == "FAILED").alias("failed"), F.count(F.lit(1)).alias("stages"))


def latency_spikes(pipeline_runs: DataFrame, threshold: Column, as_of: Column) -> DataFrame:
    """Runs beyond the threshold (FR-008): critical from twice the threshold on."""
    timed = pipeline_runs.withColumn(
        "duration_seconds", seconds_between(F.coalesce("completed_at", as_of), F.col("started_at")))
    over = F.col("duration_seconds") - threshold
    return timed.filter(over > 0).select(
        "pipeline_id", "duration_seconds", over.alias("overage_seconds"), F.lit("FR-008").alias("failure_code"),
        F.when(over < threshold, WARNING).otherwise(CRITICAL).alias("severity"))


def end_to_end(stages: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per run: summed stage time and the span from first start to last end."""
    spent = seconds_between(F.col("completed_at"), F.col("started_at"))
    return stages.groupBy(*groups, "pipeline_id").agg(
        F.sum(spent).alias("stage_seconds"), F.max(spent).alias("longest_stage"),
        seconds_between(F.max("completed_at"), F.min("started_at")).alias("span_seconds"))


def latency_baseline(spans: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Runs, mean and exact 95th percentile (the least value that 95 % do not exceed) per group."""
    p95 = exact_percentiles(spans, list(groups), "span_seconds", {"p95_seconds": 0.95})
    return p95.select(*groups, "runs", "mean_seconds", "p95_seconds")


def stalled_stages(stages: DataFrame, order: list[str], as_of: Column, idle_seconds: int = 600) -> DataFrame:
    """First stage of a run that did not start though its predecessor ended long ago (FR-004)."""
    needed = stages.select(*dict.fromkeys(["pipeline_id", "stage", "started_at", "completed_at", *order]))
    ahead = with_neighbour(needed.withColumn("_present", F.lit(True)), ["pipeline_id"], order,
                           {"next_stage": "stage", "_next_start": "started_at", "_next": "_present"}, following=True)
    idle = seconds_between(as_of, F.col("completed_at")) > idle_seconds
    hits = ahead.filter(F.col("completed_at").isNotNull() & F.col("_next") & F.col("_next_start").isNull() & idle)
    return hits.groupBy("pipeline_id").agg(
        F.min_by(F.struct("stage", "next_stage"), F.struct(*order)).alias("s")
    ).select("pipeline_id", F.col("s.stage").alias("after_stage"), F.col("s.next_stage").alias("stalled_stage"),
             F.lit("FR-004").alias("failure_code"), F.lit(WARNING).alias("severity"))


def failed_stages(stages: DataFrame) -> DataFrame:
    spent = F.coalesce(seconds_between(F.col("completed_at"), F.col("started_at")), F.lit(0))
    return stages.filter(F.col("status") == "FAILED").select(
        "pipeline_id", "stage", spent.alias("duration_seconds"), F.lit("FR-006").alias("failure_code"),
        F.lit(CRITICAL).alias("severity"))


# Dependencies ---------------------------------------------------------------------------------

def _late() -> Column:
    return (F.col("delay_seconds") > 0) & (F.col("status") != "OK")


def late_dependencies(dependencies: DataFrame) -> DataFrame:
    """Dependencies that hold their source up (FR-007)."""
    return dependencies.filter(_late()).select(
        "source", "dependency_id", "delay_seconds", F.lit("FR-007").alias("failure_code"),
        F.when(F.col("blocking"), CRITICAL).otherwise(WARNING).alias("severity"))


def dependency_gate(dependencies: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per source whether it may proceed, and the first blocking dependency that is not done."""
    holds = F.col("blocking") & (F.col("status") != "OK")
    return dependencies.groupBy("source").agg(
        (~F.bool_or(holds)).alias("can_proceed"),
        F.min_by(F.when(holds, F.col("dependency_id")), F.when(holds, F.struct(*order))).alias("blocked_by"),
        F.count_if(_late()).alias("late"))


# Scores ---------------------------------------------------------------------------------------

def freshness_score(status: DataFrame) -> DataFrame:
    """100 falling to 50 at the warning threshold, then 50, then 0; averaged over sources."""
    points = F.when(F.col("status") == CRITICAL, 0.0).when(F.col("status") == WARNING, 50.0).otherwise(
        100.0 - 50.0 * (F.col("age_seconds") / 60.0) / F.col("warning_minutes"))
    return status.agg(F.coalesce(F.avg(points), F.lit(100.0)).alias("score"))


def sla_score(status: DataFrame) -> DataFrame:
    """100, 50 or 0 per deadline; a source that never delivered earns nothing."""
    points = F.when(F.col("last_arrival").isNull() | (F.col("status") == "BREACHED"), 0.0).when(
        F.col("status") == "AT_RISK", 50.0).otherwise(100.0)
    return status.agg(F.coalesce(F.avg(points), F.lit(100.0)).alias("score"))


def pipeline_score(pipeline_runs: DataFrame, threshold: Column, as_of: Column) -> DataFrame:
    """0 with a failed stage or beyond twice the threshold, partial in between, else 100."""
    spent = seconds_between(F.coalesce("completed_at", as_of), F.col("started_at"))
    over = (spent - threshold) / threshold
    points = F.when(F.col("failed") | (over > 1), 0.0).when(over > 0, 50.0 * (1 - over)).otherwise(100.0)
    return pipeline_runs.agg(F.coalesce(F.avg(points), F.lit(100.0)).alias("score"))


def dependency_score(dependencies: DataFrame) -> DataFrame:
    """Share of dependencies that do not delay their source, halved when a late one blocks it."""
    fine = (F.col("status") == "OK") | ~_late()
    chains = dependencies.groupBy("source").agg(
        (F.avg(fine.cast("double")) * 100).alias("s"),
        F.bool_or(F.col("blocking") & _late()).alias("blocked"))
    return chains.agg(F.coalesce(F.avg(
        F.when(F.col("blocked"), F.col("s") * 0.5).otherwise(F.col("s"))), F.lit(100.0)).alias("score"))
