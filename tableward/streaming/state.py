"""Keyed state over streams: state transitions, and sources that fall silent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tableward.functions.ordered import with_neighbour
from tableward.operators.rules import disallowed
from tableward.session import cut_lineage


def stream_transitions(stream: DataFrame, key: str, order: str, row_id: str, state: str,
                       allowed: dict[str, list[str]], out: str, checkpoint: str,
                       every: str | None = None) -> StreamingQuery:
    """Invalid transitions of a stream, into ``out/steps``.

    Each micro-batch finds the neighbours of its rows as a table does; the first row of a key takes
    its state from the snapshot that the batch before left in ``out/states``.  Within a batch rows
    are taken by ``order``, then row id; across batches as the stream delivers them.  Folders carry
    the batch number, so a repeated batch overwrites its own.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(batch.select(key, order, row_id, state))
        last = rows.groupBy(key).agg(F.max_by(state, F.struct(order, row_id)).alias("last_state"))
        if number:
            known = spark.read.parquet(f"{out}/states/batch={number - 1}")
        else:
            known = last.limit(0)
        stepped = with_neighbour(rows.withColumn("_seen", F.lit(True)), [key], [order, row_id],
                                 {"_before": state, "_any": "_seen"})
        before = F.when(F.coalesce("_any", F.lit(False)), F.col("_before")).otherwise(F.col("last_state"))
        joined = stepped.join(known, key, "left").withColumn("previous_state", before)
        found = disallowed(joined, state, allowed).select(key, row_id, state, "previous_state", "reason")
        found.write.mode("overwrite").parquet(f"{out}/steps/batch={number}")
        last.unionByName(known.join(last, key, "left_anti")).write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def silence_processor(source: str, ts: str, warning_minutes: int, critical_minutes: int):
    """Keeps the last arrival of each source and reports when it grows too old.

    Timers run on event time: the watermark, not the wall clock, says how late it is.
    """
    schema = f"{source} string, last_arrival timestamp, severity string, failure_code string"

    class Silence(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

        def handleInputRows(self, key, rows, timerValues):
            newest = max(int(pdf[ts].max().timestamp() * 1000) for pdf in rows)
            known = self._last.get()[0] if self._last.exists() else None
            if known is None or newest > known:
                for timer in list(self._handle.listTimers()):
                    self._handle.deleteTimer(timer)
                self._last.update((newest,))
                for minutes in (warning_minutes, critical_minutes):
                    self._handle.registerTimer(newest + minutes * 60_000)
            yield pd.DataFrame(columns=[source, "last_arrival", "severity", "failure_code"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last = self._last.get()[0]
            age = (expiredTimerInfo.getExpiryTimeInMs() - last) / 60_000
            severity = "CRITICAL" if age >= critical_minutes else "WARNING"
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), severity, "FR-001")],
                               columns=[source, "last_arrival", "severity", "failure_code"])

        def close(self) -> None:
            pass

    return Silence(), schema


def stream_silence(stream: DataFrame, source: str, ts: str, warning_minutes: int = 60, critical_minutes: int = 90,
                   lateness: str = "0 seconds") -> DataFrame:
    processor, schema = silence_processor(source, ts, warning_minutes, critical_minutes)
    # A row without a time says nothing about silence.
    return stream.select(source, F.col(ts).cast("timestamp").alias(ts)).filter(F.col(ts).isNotNull()).withWatermark(ts, lateness).groupBy(
        source).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


MISSES = "source string, sla_id string, first_missed timestamp, last_missed timestamp, consecutive_misses long, failure_code string"


def misses_processor(source: str, ts: str):
    """Counts expected arrivals that did not come, one event-time timer a deadline.

    The key is a deadline.  Its state: the schedule, given before the first row; the expected arrivals that
    are still open, each with whether something came; and the run of misses so far.  A timer stands at the
    end of the oldest open one.  When the watermark has passed it, a miss makes the run longer and an
    arrival ends it.
    """
    class Misses(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            many = T.ArrayType(T.LongType())
            self._ticks = handle.getValueState("ticks", T.StructType([T.StructField("ms", many)]))
            self._came = handle.getValueState("came", T.StructType([T.StructField("ms", many)]))
            self._run = handle.getValueState("run", T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "n")]))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            ticks = sorted(int(t) for t in initialState["tick_ms"])
            self._ticks.update((ticks,))
            if len(ticks) > 1:
                self._handle.registerTimer(ticks[1])

        def handleInputRows(self, key, rows, timerValues):
            if self._ticks.exists():
                ticks = np.array(self._ticks.get()[0], np.int64)
                came = set(self._came.get()[0]) if self._came.exists() else set()
                for pdf in rows:
                    at = np.searchsorted(ticks, pdf[ts].astype("datetime64[ms]").astype(np.int64).to_numpy(), "right") - 1
                    came.update(ticks[np.unique(at[at >= 0])].tolist())
                self._came.update((sorted(came),))
            yield self._rows([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now, ticks = timerValues.getCurrentWatermarkInMs(), list(self._ticks.get()[0])
            came = set(self._came.get()[0]) if self._came.exists() else set()
            run, found = tuple(self._run.get()) if self._run.exists() else (0, 0, 0), []
            # All that are over by now: their next one is due.
            while len(ticks) > 1 and ticks[1] <= now:
                tick = ticks.pop(0)
                if tick in came:
                    came.discard(tick)
                    run = (0, 0, 0)
                else:
                    run = (run[0] if run[2] else tick, tick, run[2] + 1)
                    found.append((*key, *run))
            self._ticks.update((ticks,))
            self._came.update((sorted(came),))
            self._run.update(run)
            if len(ticks) > 1:
                self._handle.registerTimer(ticks[1])
            yield self._rows(found)

        def _rows(self, found):
            made = pd.DataFrame(found, columns=["source", "sla_id", "first_missed", "last_missed", "consecutive_misses"])
            for c in ("first_missed", "last_missed"):
                made[c] = pd.to_datetime(made[c], unit="ms")
            made["consecutive_misses"] = made["consecutive_misses"].astype("int64")
            made["failure_code"] = np.where(made["consecutive_misses"] >= 2, "FR-005", None)
            return made

        def close(self) -> None:
            pass

    return Misses()


def stream_misses(stream: DataFrame, slas: DataFrame, ticks: DataFrame, source: str, ts: str, lateness: str = "0 seconds") -> DataFrame:
    """One row per expected arrival that did not come, with the run of misses it belongs to.

    ``ticks`` (sla_id, source, tick) are the expected arrivals of a horizon.  They are the initial state, so
    that a source which never delivers is counted too.  An expected arrival is judged when its next one is
    due; a reset by an arrival starts a new run.  Times are event time.
    """
    rows = stream.select(F.col(source).alias("source"), F.col(ts).cast("timestamp").alias(ts)).filter(F.col(ts).isNotNull())
    # Every deadline of a source sees all of its arrivals.
    placed = rows.withWatermark(ts, lateness).join(F.broadcast(slas.filter("enabled AND valid").select("source", "sla_id")), "source")
    # A written table, as a state is read by every task of the first batch.
    known = cut_lineage(ticks).select("source", "sla_id", F.unix_millis(F.col("tick").cast("timestamp")).alias("tick_ms")).groupBy("source", "sla_id")
    return placed.select("source", "sla_id", ts).groupBy("source", "sla_id").transformWithStateInPandas(
        statefulProcessor=misses_processor(source, ts), outputStructType=MISSES, outputMode="Append", timeMode="EventTime",
        initialState=known)


def steps_processor(key: str, order: str, row_id: str, state: str, allowed: dict[str, list[str]], kinds: T.StructType, ttl_ms: int | None):
    """Keeps the newest row of each key and reports the steps from it that ``allowed`` does not list."""
    step = Row(key, row_id, state, "previous_state", "reason")
    permitted = {(a, b) for a, targets in allowed.items() for b in targets}
    newest = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", kinds[row_id].dataType), T.StructField("state", T.StringType())])

    def place(row: tuple) -> tuple:
        """Where a row (at, id, state) stands among its key's rows; a null id comes last."""
        return row[0], row[1] is None, row[1]

    class Steps(StatefulProcessor):
        """Plain rows: a key has few rows a micro-batch, so a pandas frame per key would cost more than the work."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._last = handle.getValueState("last", newest, ttl_ms) if ttl_ms else handle.getValueState("last", newest)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            row, last = (initialState["_at"], initialState[row_id], initialState[state]), self._last.get()
            if last is None or place(row) >= place(last):
                self._last.update(row)

        def handleInputRows(self, key_, rows, timerValues):
            known = last = self._last.get()
            found = []
            for row in sorted(((r["_at"], r[row_id], r[state]) for r in rows), key=place):
                if known is not None and place(row) < place(known):
                    found.append(step(key_[0], row[1], row[2], None, "late"))
                    continue
                before = None if last is None else last[2]
                if before is not None and (before, row[2]) not in permitted:
                    found.append(step(key_[0], row[1], row[2], before, "not_allowed" if before in allowed else "unknown_state"))
                last = row
            if last is not known:
                self._last.update(last)
            return iter(found)

        def close(self) -> None:
            pass

    schema = T.StructType([kinds[key], kinds[row_id], T.StructField(state, T.StringType()),
                           T.StructField("previous_state", T.StringType()), T.StructField("reason", T.StringType())])
    return Steps(), schema


def stream_steps(stream: DataFrame, key: str, order: str, row_id: str, state: str, allowed: dict[str, list[str]],
                 initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Steps between consecutive states of a key that ``allowed`` does not list, with state in the state store.

    A micro-batch reads and writes the keys it holds and no others.  ``initial`` (the same columns) are rows
    seen before the stream began; with ``ttl_ms`` a key that is silent that long is forgotten.  Rows are
    taken by ``order``, then row id.  A row before its key's newest one of an earlier batch is reported as
    ``late`` and is no step.  Rows without a key or time are left out.  The rows of a key within one micro-batch
    are ordered in memory; ``files_per_batch`` bounds them.
    """
    names = [key, F.unix_micros(F.col(order).cast("timestamp")).alias("_at"), row_id, state]
    present = F.col(key).isNotNull() & F.col("_at").isNotNull()
    rows = stream.select(*names).filter(present)
    processor, schema = steps_processor(key, order, row_id, state, allowed, rows.schema, ttl_ms)
    known = None if initial is None else cut_lineage(initial.select(*names).filter(present)).groupBy(key)
    return rows.groupBy(key).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None", initialState=known)


def newest_states(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, at, id, state) as a query of ``stream_steps`` has them in its state store."""
    return spark.read.format("statestore").option("stateVarName", "last").load(checkpoint).select(
        F.col(f"key.{key}").alias(key), F.timestamp_micros("value.at").alias("at"), F.col("value.id").alias("id"), F.col("value.state").alias("state"))
