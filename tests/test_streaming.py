import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.operators import bronze as B
from tableward.operators import freshness as FR
from tableward.operators import rules as R
from tableward.streaming import state as ST
from tableward.streaming import validate as SV

SPEC = B.BatchSpec(required=("name",), ranges=(B.RangeSpec("amount", 0, 100),))
SCHEMA = "id bigint, name string, amount double"


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def arrive(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / name))


def test_each_file_is_validated_once_across_restarts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    seen = []

    def run():
        stream = SV.file_stream(spark, str(source / "*"), SCHEMA, files_per_batch=1)
        SV.validate_stream(stream, SPEC, ["id"], out, str(tmp_path / "cp"), notify=lambda df, n: seen.append(n)).awaitTermination()
        return spark.read.parquet(f"{out}/findings")

    arrive(spark, source, "a", [(1, "x", 5.0), (2, None, 500.0)], SCHEMA)
    assert run().select("batch_id").distinct().count() == 1
    assert run().select("batch_id").distinct().count() == 1
    arrive(spark, source, "b", [(3, "y", 1.0)], SCHEMA)
    found = run()
    assert found.select("batch_id").distinct().count() == 2 and sorted(seen) == [0, 1]
    assert found.filter("failed").agg(F.sum("affected_count")).first()[0] == 2
    assert [r["row_key"] for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["2"]


def test_transitions_over_batches_equal_the_batch_check(spark, tmp_path):
    schema = "k string, t bigint, id bigint, s string"
    allowed = {"A": ["B"], "B": ["A", "C"]}
    rows = [(f"k{i % 3}" if i % 5 else None, i, i, "ABC"[(i * i + i // 3) % 3]) for i in range(60)]
    out = str(tmp_path / "out")
    for name, part in (("1", rows[:25]), ("2", rows[25:40]), ("3", rows[40:])):
        arrive(spark, tmp_path / "in", name, part, schema)
        stream = SV.file_stream(spark, str(tmp_path / "in" / "*"), schema)
        ST.stream_transitions(stream.filter("k IS NOT NULL"), "k", "t", "id", "s", allowed, out, str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{out}/steps").drop("batch").collect()}
    batch = R.state_transitions(spark.createDataFrame(rows, schema).filter("k IS NOT NULL"), "k", ["t", "id"], "s", allowed)
    assert got == {tuple(r) for r in batch.select("k", "id", "s", "previous_state", "reason").collect()} and got


def test_silent_source_is_reported_when_time_moves_on(spark, tmp_path, rocksdb):
    schema, zero = "source string, ts timestamp", dt.datetime(2024, 1, 1)
    at = lambda m: zero + dt.timedelta(minutes=m)
    for name, rows in (("1", [("quiet", at(0)), ("busy", at(0))]), ("2", [("busy", at(70))]), ("3", [("busy", at(120))]), ("4", [("busy", at(121))])):
        arrive(spark, tmp_path / "in", name, rows, schema)
        stream = SV.file_stream(spark, str(tmp_path / "in" / "*"), schema)
        found = ST.stream_silence(stream, "source", "ts")
        found.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(
            str(tmp_path / "out"), format="parquet").awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).filter("source = 'quiet'").collect()
    assert sorted(r["severity"] for r in got) == ["CRITICAL", "WARNING"]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    schema, zero = "ts timestamp, v double", dt.datetime(2024, 1, 1)
    rows = [(zero + dt.timedelta(minutes=m), float(m) if m % 2 else None) for m in range(0, 240, 10)]
    arrive(spark, tmp_path / "in", "1", rows, schema)
    stream = SV.file_stream(spark, str(tmp_path / "in" / "*"), schema)
    windows = SV.window_quality(stream, "ts", "v", "1 hour", lateness="30 minutes")
    windows.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 3 and all(r["rows"] == 6 for r in got)


def test_a_row_behind_the_watermark_is_left_out(spark, tmp_path):
    schema, zero = "ts timestamp, v double", dt.datetime(2024, 1, 1)
    at = lambda m: (zero + dt.timedelta(minutes=m), 1.0)
    for name, rows in (("1", [at(10), at(130)]), ("2", [at(20), at(140)]), ("3", [at(400)])):
        arrive(spark, tmp_path / "in", name, rows, schema)
        stream = SV.file_stream(spark, str(tmp_path / "in" / "*"), schema)
        windows = SV.window_quality(stream, "ts", "v", "1 hour", lateness="30 minutes")
        windows.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    got = {r["window_start"].hour: r["rows"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 2: 2}


def test_a_running_query_takes_files_as_they_come(spark, tmp_path):
    import time

    source, out = tmp_path / "in", str(tmp_path / "out")
    arrive(spark, source, "a", [(1, "x", 5.0)], SCHEMA)
    seen = []
    query = SV.validate_stream(SV.file_stream(spark, str(source / "*"), SCHEMA), SPEC, ["id"], out, str(tmp_path / "cp"),
                               every="200 milliseconds", notify=lambda _, n: seen.append(n))
    try:
        arrive(spark, source, "b", [(2, None, 500.0)], SCHEMA)
        for _ in range(300):
            if len(seen) >= 2 or query.exception():
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert spark.read.parquet(f"{out}/quarantine").count() == 1


def test_micro_batch_of_several_files_has_a_result_per_file(spark, tmp_path):
    for n, rows in enumerate([[(1, "x", 5.0)] * 3, [(2, None, 500.0), (3, "y", 1.0)], [(4, "z", 7.0)]]):
        arrive(spark, tmp_path / "in", str(n), rows, SCHEMA)
    stream = SV.file_stream(spark, str(tmp_path / "in" / "*"), SCHEMA, file_column="file")
    out = str(tmp_path / "out")
    SV.validate_stream(stream, SPEC, ["id"], out, str(tmp_path / "cp"), by=["file"]).awaitTermination()
    found = spark.read.parquet(f"{out}/findings")
    assert found.select("batch_id").distinct().count() == 1 and found.select("file").distinct().count() == 3
    assert sorted(r.total_count for r in found.filter("check_name = 'range'").collect()) == [1, 2, 3]
    assert [r.row_key for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["2"]


def test_missed_deliveries_are_counted_across_batches(spark, tmp_path, rocksdb):
    """Arrivals end a run, a source that never delivers has one long run, null times do no harm."""
    slas = FR.sla_table(spark, [FR.Sla("s1", "a", "0 * * * *", 60, 90), FR.Sla("s2", "never", "0 */2 * * *", 60, 90)])
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    ticks = FR.calendar(slas, F.lit(at(0)).cast("timestamp_ntz"), F.lit(at(12)).cast("timestamp_ntz"))
    schema = "source string, ts timestamp_ntz"
    for n, rows in enumerate([[("a", at(0, 5)), ("a", None), ("other", at(1))], [("a", at(4, 30)), ("a", at(5))], [("a", at(9))], [("other", at(13))]]):
        arrive(spark, tmp_path / "in", str(n), rows, schema)
        stream = SV.file_stream(spark, str(tmp_path / "in" / "*"), schema)
        # Rows of other sources do not move a deadline's clock: the watermark does, so let one of them pass.
        found = ST.stream_misses(stream.withColumn("source", F.when(F.col("source") == "other", "never").otherwise(F.col("source")))
                                 if n == 3 else stream, slas, ticks, "source", "ts")
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(
            str(tmp_path / "out")).awaitTermination()
    rows = spark.read.schema(ST.MISSES).parquet(str(tmp_path / "out")).collect()
    runs = {}
    for r in rows:
        key = (r.source, r.first_missed)
        runs[key] = max(runs.get(key, 0), r.consecutive_misses)
        assert r.failure_code == ("FR-005" if r.consecutive_misses >= 2 else None)
    assert runs == {("a", at(1)): 3, ("a", at(6)): 3, ("a", at(10)): 2, ("never", at(0)): 6}


def test_rows_without_time_do_not_end_the_silence_query(spark, tmp_path, rocksdb):
    arrive(spark, tmp_path / "in", "1", [("a", None), ("b", dt.datetime(2024, 1, 1))], "s string, ts timestamp")
    stream = SV.file_stream(spark, str(tmp_path / "in" / "*"), "s string, ts timestamp")
    query = ST.stream_silence(stream, "s", "ts").writeStream.format("memory").queryName("quiet").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("quiet").count() == 0


def test_steps_in_the_state_store_equal_the_batch_check(spark, tmp_path, rocksdb):
    """Three batches with a restart between them, states given at the start, and a row that comes late."""
    schema = "k string, t timestamp, id bigint, s string"
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    allowed = {"A": ["B"], "B": ["A", "C"]}
    rows = [(f"k{i % 3}", at(i), i, "ABC"[(i * i + i // 3) % 3]) for i in range(60)]
    known = spark.createDataFrame(rows[:10], schema)
    late, nameless = ("k0", at(0), 900, "A"), (None, at(70), 901, "A")
    for name, part in (("1", rows[10:25]), ("2", rows[25:40]), ("3", [*rows[40:], late, nameless, ("k1", None, 902, "A")])):
        arrive(spark, tmp_path / "in", name, part, schema)
        found = ST.stream_steps(SV.file_stream(spark, str(tmp_path / "in" / "*"), schema), "k", "t", "id", "s", allowed, initial=known)
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(
            str(tmp_path / "out")).awaitTermination()
    got = {tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}
    batch = R.state_transitions(spark.createDataFrame(rows, schema), "k", ["t", "id"], "s", allowed).filter("id >= 10")
    want = {tuple(r) for r in batch.select("k", "id", "s", "previous_state", "reason").collect()}
    assert want and got == want | {("k0", 900, "A", None, "late")}
    states = {r.k: (r.id, r.state) for r in ST.newest_states(spark, str(tmp_path / "cp"), "k").collect()}
    assert states == {f"k{i % 3}": (i, rows[i][3]) for i in (57, 58, 59)}


def test_a_key_costs_two_calls_of_the_state_store():
    """Rows go in and out plainly: late ones, a null state, equal rows and a null id among them."""
    kinds = T.StructType.fromDDL("k string, id bigint, s string")
    calls, kept = [], [(5, 50, "A")]

    class Last:
        def get(self):
            calls.append("get")
            return kept[-1]

        def update(self, row):
            calls.append("update")
            kept.append(row)

    handle = type("Handle", (), {"getValueState": lambda self, name, schema: Last()})()
    processor, _ = ST.steps_processor("k", "t", "id", "s", {"A": ["B"]}, kinds, None)
    processor.init(handle)
    row = Row("_at", "id", "s")
    rows = [row(9, None, "B"), row(9, 3, None), row(6, 1, "B"), row(7, 2, "A"), row(7, 2, "A"), row(1, 9, "A")]
    found = {tuple(r) for r in processor.handleInputRows(("x",), iter(rows), None)}
    assert found == {("x", 9, "A", None, "late"), ("x", 2, "A", "B", "unknown_state"), ("x", 2, "A", "A", "not_allowed"),
                     ("x", 3, None, "A", "not_allowed")}
    assert calls == ["get", "update"] and kept[-1] == (9, None, "B")
    assert not list(processor.handleInputRows(("x",), iter([]), None)) and calls == ["get", "update", "get"]
