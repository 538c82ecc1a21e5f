"""Bad lines kept, counts taken while rows are written, checks of users."""

import pytest
from pyspark.sql import functions as F

from tableward.operators import bronze as B
from tableward.operators import checks as U
from tableward.plans.suite import Suite, run_tiers
from tableward.sources import readers, sinks
from tableward.streaming import metrics as SM
from tableward.streaming.validate import file_stream

LINES = ['1,a,2.5', '2,b', '3,c,1,9', 'x,d,1', '4,"e, f",', '5,"g ""h"", i",7', '6,j,ten', ',,', '7,"k,8']


def test_every_line_is_a_record_or_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,name,v\n" + "\n".join(LINES) + "\n")
    (tmp_path / "in" / "b.csv").write_text("id,name,v\n8,l,1\n")
    (tmp_path / "in" / "empty.csv").write_text("id,name,v\n")
    good, bad = readers.land_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), "id long, name string, v double")
    reasons = {r.line: (r.reason, r.file.rsplit("/", 1)[1]) for r in bad.collect()}
    assert {line: reason for line, (reason, _) in reasons.items()} == {
        "2,b": "short", "3,c,1,9": "long", "x,d,1": "type:id", "6,j,ten": "type:v", '7,"k,8': "unreadable"}
    assert {file for _, file in reasons.values()} == {"a.csv"}
    kept = {r.id: (r.name, r.v) for r in good.collect()}
    assert kept == {1: ("a", 2.5), 4: ("e, f", None), 5: ('g "h", i', 7.0), None: (None, None), 8: ("l", 1.0)}
    marked = readers.read_csv_marked(spark, str(tmp_path / "in"), "id long, name string, v double")
    assert {r.id for r in readers.good_records(marked).select("id").collect()} == set(kept)  # one column asks for all
    assert readers.bad_records(marked).select("reason").count() == 5
    assert good.count() + bad.count() == len(LINES) + 1
    assert dict(good.dtypes) == {"id": "bigint", "name": "string", "v": "double"}


def test_lines_without_a_schema_are_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,_corrupt_record\n1,a\n2\n3,b,c\n")
    marked = readers.read_csv_marked(spark, str(tmp_path))
    assert [tuple(r) for r in readers.good_records(marked).collect()] == [("1", "a")]
    assert {(r.line, r.reason) for r in readers.bad_records(marked).collect()} == {("2", "short"), ("3,b,c", "long")}
    with pytest.raises(ValueError, match="schema"):
        readers.read_csv_marked(spark, str(tmp_path), header=False)


SPEC = B.BatchSpec(required=("name",), ranges=(B.RangeSpec("v", 0, 10),), duplicates=B.DuplicateSpec(("id",)))


def test_counts_of_a_split_are_those_of_its_rows(spark, tmp_path):
    df = spark.range(100).select((F.col("id") - (F.col("id") % 4 == 1).cast("int")).alias("id"), F.when(F.col("id") % 3 > 0, "n").alias("name"),
                                 (F.col("id") / 9).alias("v"), F.lit("own").alias("held"))
    path = str(tmp_path / "split")
    for batch in ("007", "7", "007"):  # a repeated batch replaces itself
        seen = {(r.scope, r.value): r.rows for r in sinks.write_split(df, SPEC, ["id"], path, batch).collect()}
    clean, held = sinks.split_rows(spark, path, False), sinks.split_rows(spark, path, True)
    assert {r.batch_id: r["count"] for r in held.groupBy("batch_id").count().collect()} == {"007": seen["held", "*"], "7": seen["held", "*"]}
    assert clean.columns == df.columns and clean.count() == 2 * seen["clean", "*"]
    alone = B.quarantine(df, SPEC, ["id"])
    assert seen["all", "*"] == 100 and seen["held", "*"] == alone.count() and seen["clean", "*"] == B.clean(df, SPEC).count()
    by_code = {r.code: r["count"] for r in alone.select(F.explode("failure_codes").alias("code")).groupBy("code").count().collect()}
    assert {value: n for (scope, value), n in seen.items() if scope == "code"} == by_code
    none = {(r.scope, r.value): r.rows for r in sinks.write_split(df.limit(0), SPEC, ["id"], path, "none").collect()}
    assert none == {("all", "*"): 0, ("clean", "*"): 0, ("held", "*"): 0}


def test_streams_are_counted_as_they_pass(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select("id", F.when(F.col("id") % 5 > 0, "n").alias("name"), (F.col("id") / 2).alias("v")).coalesce(1).write.parquet(
            str(tmp_path / "in" / str(part)))
    stream = file_stream(spark, str(tmp_path / "in" / "*"), "id long, name string, v double", files_per_batch=1)
    run = [spark, stream, SPEC, str(tmp_path / "out"), str(tmp_path / "checkpoint")]
    seen = SM.run_watched(*run).collect()
    assert len({r.batch_id for r in seen}) == 3 and all(r.total_count == 10 for r in seen)
    assert {c: sum(r.affected_count for r in seen if r.check_name == c) for c in ("null_required", "range")} == {"null_required": 6, "range": 9}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    assert SM.run_watched(*run).count() == 0  # nothing new


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(i, float(i % 5), "a" if i < 9 else "b") for i in range(10)], "id long, v double, _check0 string")


CHECKS = (
    U.Check("ratio", "BL-001", "v", ("v",), rows=lambda df: 6 / F.col("v") > 2, severity="WARNING"),
    U.Check("mean", "DV-004", "v", measure=lambda df: F.col("v"), limits=(0.0, 1.5), score=75.0),
    U.Check("spread", "DV-004", "v", measure=lambda df: F.col("v"), aggregate=F.max, limits=(None, 4.0)),
    U.Check("alone", "BL-001", "_check0", plan=lambda df: df.join(df.groupBy("_check0").count().filter("count = 1"), "_check0", "left_semi"), severity="INFO"),
    U.Check("raises", "BL-001", rows=lambda df: {}["x"]),
    U.Check("unknown_column", "BL-001", rows=lambda df: F.col("nope") > 1),
    U.Check("two", "BL-001", rows=lambda df: F.lit(True), plan=lambda df: df),
    U.Check("needy", "BL-001", needs=("w",), rows=lambda df: F.lit(True)),
    U.Check("layerless", "XX-001", rows=lambda df: F.lit(True)),
    "unheard",
)


def test_checks_of_users(orders):
    found, skipped = U.run_checks(orders, CHECKS)
    assert {r.check_name: (r.affected_count, r.total_count, r.severity, r.failed) for r in found.collect()} == {
        "ratio": (4, 10, "WARNING", True), "mean": (10, 10, "CRITICAL", True), "spread": (0, 10, None, False), "alone": (1, 10, "INFO", True)}
    assert [name for name, _ in skipped] == ["raises", "unknown_column", "two", "needy", "layerless", "unheard"]
    empty, _ = U.run_checks(orders.limit(0), CHECKS)
    assert {r.check_name: (r.affected_count, r.failed) for r in empty.collect()} == {n: (0, False) for n in ("ratio", "mean", "spread", "alone")}
    assert U.run_checks(orders, [])[0].count() == 0


def test_checks_join_the_tiers(orders):
    run = run_tiers(orders, Suite(keys=("id",), bronze=B.BatchSpec(count=B.CountSpec(minimum=1)), checks=CHECKS, personal_data=False), "b", "2024-01-01 00:00:00")
    assert {r.check_name: (r.layer, r.affected_count) for r in run.anomalies.collect()} == {"ratio": (3, 4), "mean": (1, 10), "alone": (3, 1)}
    assert {name for name, _ in run.skipped} == {"raises", "unknown_column", "two", "needy", "layerless", "unheard"}


def test_registered_checks_go_by_name(orders):
    check = U.register(U.Check("test_positive", "DV-004", "v", rows=lambda df: F.col("v") <= 0))
    try:
        assert U.run_checks(orders, ["test_positive"])[0].first().affected_count == 2
        with pytest.raises(ValueError, match="twice"):
            U.register(check)
        with pytest.raises(ValueError, match="limit"):
            U.register(U.Check("test_open", "DV-004", measure=lambda df: F.col("v")))
    finally:
        del U.REGISTRY["test_positive"]
