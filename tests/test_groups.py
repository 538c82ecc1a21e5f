"""Groups judged on their own, keys that stay apart, rows that rules cannot evaluate."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableward.functions.predicates import row_key
from tableward.operators import bronze as B
from tableward.operators import freshness as FR
from tableward.operators import rules as R
from tableward.sources import sinks

SPEC = B.BatchSpec(count=B.CountSpec(minimum=20), required=("name",), ranges=(B.RangeSpec("amount", 0, 100),),
                   duplicates=B.DuplicateSpec(("id",)), outliers=("amount",))


@pytest.fixture
def batches(spark):
    """Five batches of different faults, one without a name for its group."""
    rows = []
    for g, n in (("a", 60), ("b", 40), ("c", 10), (None, 35), ("clean", 30)):
        for i in range(n):
            faulty = g != "clean"
            rows.append((g, i - (i % 4 if g == "b" else 0), None if faulty and i % 3 == 0 and g != "b" else "x",
                         5000.0 if g == "a" and i == 7 else float(i % 50)))
    return spark.createDataFrame(rows, "g string, id long, name string, amount double")


def test_groups_are_judged_as_batches_of_their_own(batches):
    found = {(r.g, r.check_name, r.field): tuple(r)[1:] for r in B.validate_groups(batches, SPEC, ["g"]).collect()}
    held = {(r.g, r.row_key): (r.failure_codes, r.reason) for r in B.quarantine_groups(batches, SPEC, ["g"], ["id", "name"]).collect()}
    for g in ("a", "b", "c", None, "clean"):
        own = batches.filter(F.col("g").eqNullSafe(F.lit(g)))
        assert {k[1:]: v for k, v in found.items() if k[0] == g} == {(r.check_name, r.field): tuple(r) for r in B.validate_batch(own, SPEC).collect()}
        alone = {r.row_key: (r.failure_codes, r.reason) for r in B.quarantine(own, SPEC, ["id", "name"]).collect()}
        assert {k[1]: v for k, v in held.items() if k[0] == g} == alone
    assert B.validate_groups(batches.limit(0), SPEC, ["g"]).count() == 0
    assert held and not [k for k in held if k[0] == "clean"]


def test_whole_rows_repeat_within_their_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "g string, id long")
    found = B.validate_groups(df, B.BatchSpec(duplicates=B.DuplicateSpec()), ["g"]).filter("check_name = 'duplicate'")
    assert {r.g: r.affected_count for r in found.collect()} == {"a": 2, "b": 0}


def test_row_keys_stay_apart(spark):
    rows = [("x", None, "y"), ("x", "y", None), (None, "x", "y"), (None, None, None), ("", "", ""), ("x|y", None, None), ("x", "y", ""),
            ("\\N", None, None), ("x\\", "y", "z"), ("x", "\\y", "z"), ("x\\|y", "z", "")]
    keys = [r.k for r in spark.createDataFrame(rows, "a string, b string, c string").select(row_key("a", "b", "c").alias("k")).collect()]
    assert len(set(keys)) == len(rows)
    assert spark.range(1).select(row_key("id").alias("k")).first().k == "0"


def test_release_twice_stores_once(spark, tmp_path):
    rows = spark.createDataFrame([("b", str(i)) for i in range(6)], "batch_id string, row_key string").withColumn("record", F.struct("row_key"))
    held, released = str(tmp_path / "q"), str(tmp_path / "r")
    sinks.append_quarantine(rows, held)
    assert sinks.still_held(spark, held, released).count() == 6  # nothing released yet
    for wanted in ("row_key < '0'", "row_key < '2'", "row_key < '4'", "row_key < '4'"):
        left = sinks.release(spark, held, released, rows.filter(wanted))
    assert sorted(r.row_key for r in spark.read.parquet(released).collect()) == ["0", "1", "2", "3"]
    assert sorted(r.row_key for r in left.collect()) == ["4", "5"]


def test_rows_that_rules_cannot_evaluate(spark):
    df = spark.createDataFrame([(1, 6.0, 2.0, "3", [1, 2]), (2, 1.0, 0.0, "n/a", []), (3, 1.0, None, None, None)],
                               "id long, a double, b double, t string, xs array<int>")
    rules = [R.Rule("ratio", "crossfield", "a / b > 1"), R.Rule("remainder", "domain", "a % b >= 0"), R.Rule("cast", "domain", "cast(t AS INT) > 1"),
             R.Rule("compared", "domain", "t > 1"), R.Rule("place", "domain", "xs[1] > 0"), R.Rule("element", "domain", "element_at(xs, 2) > 0"),
             R.Rule("date", "domain", "cast(concat('2024-01-0', t) AS date) > date'2020-01-01'"),
             R.Rule("sum", "calculation", "a == a / b * b"), R.Rule("conditional", "domain", "false", condition="a / b > 1")]
    hits = {}
    for r in R.check_rules(df, rules, ["id"]).collect():
        hits.setdefault(r.rule_id, set()).add(r.row_key)
    assert hits == {n: {"2", "3"} for n in ("ratio", "remainder", "cast", "compared", "place", "element", "date")} | {"conditional": {"1"}}
    assert {r.rule_id: r.failed for r in R.rule_report(df, rules).collect()} == {r.id: len(hits.get(r.id, ())) for r in rules}
    assert R.resolve_rules(df, rules)[1] == []
    # The reading ends with the rules: elsewhere such a row is an error.
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.selectExpr("a / b").collect()


def test_sources_that_never_delivered_have_missed(spark):
    slas = FR.sla_table(spark, [FR.Sla("s1", "never", "0 * * * *", 60, 90), FR.Sla("s2", "late", "0 * * * *", 60, 90),
                                FR.Sla("s3", "odd", "no schedule", 60, 90), FR.Sla("s4", "off", "0 * * * *", 60, 90, enabled=False)])
    last = spark.createDataFrame([("late", dt.datetime(2024, 1, 1, 0, 5))], "source string, last_arrival timestamp_ntz")
    missed = lambda at: {(r.source, r.consecutive_misses, r.failure_code, r.severity) for r in FR.open_misses(
        slas, last, F.lit(at).cast("timestamp_ntz")).collect()}
    assert missed("2024-01-01 03:40:00") == {("late", 3, "FR-005", "CRITICAL"), ("never", None, "FR-005", "CRITICAL"), ("odd", None, "FR-005", "CRITICAL")}
    assert missed("2024-01-01 03:20:00") == {("late", 3, "FR-005", "CRITICAL"), ("odd", None, "FR-005", "CRITICAL")}  # within the grace
