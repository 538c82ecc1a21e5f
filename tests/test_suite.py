from pyspark.sql import functions as F

from tableward.model import ANOMALY_DDL
from tableward.operators import bronze as B
from tableward.operators import contracts as C
from tableward.operators import rules as R
from tableward.plans.suite import Suite, run_tiers


def suite(**more):
    return Suite(keys=("id",), bronze=B.BatchSpec(required=("v",)), rules=(R.Rule("positive", "domain", "v > 0"),), **more)


def contract(*columns):
    return C.Contract("c", "1.0.0", "s", columns, additional_properties=True)


def test_blocking_contract_stops_later_layers(spark):
    df = spark.range(100).select("id", (F.col("id") - 50).alias("v"), F.lit("m@x.org").alias("note"))
    blocked = run_tiers(df, suite(contract=contract(C.ContractColumn("gone", required=True))), "b", "2024-01-01")
    assert blocked.blocked
    layers = {r["layer"]: (r["evaluated"], r["score"]) for r in blocked.layers.collect()}
    assert layers[2] == (True, 70.0) and layers[3] == (False, None)
    free = run_tiers(df, suite(contract=contract(C.ContractColumn("id", "integer", required=True))), "b", "2024-01-01")
    assert not free.blocked
    codes = {(r["failure_code"], r["affected_count"]) for r in free.anomalies.collect()}
    assert codes == {("BL-006", 51), ("ET-006", 100)}


def test_anomalies_share_one_shape(spark):
    df = spark.range(10).select("id", F.lit(None).cast("int").alias("v"))
    rows = run_tiers(df, suite(), "b", "2024-01-01").anomalies
    assert rows.schema.simpleString() == spark.createDataFrame([], ANOMALY_DDL).schema.simpleString()
    assert {r["tier"] for r in rows.collect()} == {"bronze", "silver_business"}


def test_sample_rules_run_on_a_matching_table(spark, tmp_path):
    import datetime as dt

    from tableward.sources.definitions import read_rules

    path = tmp_path / "rules.yaml"
    path.write_text("""
rules:
  - {id: limit, type: domain, expression: "discount <= order_total", severity: critical}
  - {id: dates, type: crossfield, expression: "end_date > start_date", severity: critical}
  - {id: customer, type: referential, field: customer_id, reference: customers, severity: critical}
  - {id: status, type: state_transition, field: status, allowed_values: [PENDING, SHIPPED], severity: critical}
  - {id: lines, type: calculation, expression: "sum(line_items.amount) == order_total", tolerance: 0.01}
  - {id: future, type: temporal, field: created_at, rule: not_future}
  - {id: nowhere, type: referential, field: customer_id, reference: suppliers}
""")
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 1.0, 10.0, day(1), day(2), "a", "PENDING", [(4.0,), (6.0,)], day(1)),
            (2, 11.0, 10.0, day(2), day(1), "z", "LOST", [(4.0,)], day(20))]
    df = spark.createDataFrame(rows, "id int, discount double, order_total double, start_date timestamp_ntz, end_date timestamp_ntz, "
                               "customer_id string, status string, line_items array<struct<amount:double>>, created_at timestamp_ntz")
    customers = spark.createDataFrame([("a",)], "id string")
    run = run_tiers(df, Suite(keys=("id",), rules=tuple(read_rules(str(path))), sets={"customers": (customers, "id")},
                              personal_data=False), "b", "2024-01-10 00:00:00")
    found = {r["rule_id"]: (r["failure_code"], r["affected_count"]) for r in run.anomalies.collect() if r["check_name"] == "rule"}
    assert found == {"limit": ("BL-006", 1), "dates": ("BL-001", 1), "customer": ("BL-002", 1), "status": ("BL-004", 1),
                     "lines": ("BL-003", 1), "future": ("BL-005", 1)}
    assert dict(run.skipped) == {"nowhere": "no reference set suppliers"}


def test_contract_sets_block(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "z")], "id int, v int, c string")
    known = spark.createDataFrame([("a",), ("b",)], "key string")
    checked = contract(C.ContractColumn("id", "integer", unique=True), C.ContractColumn("c", foreign_key="known"))
    run = run_tiers(df, suite(contract=checked, foreign={"known": (known, "key")},
                              registered=spark.createDataFrame([("c", "1.0.0", "other")], "contract_id string, version string, contract_hash string"),
                              personal_data=False), "b", "2024-01-01")
    found = {(r["failure_code"], r["affected_fields"][0], r["severity"]) for r in run.anomalies.filter("check_name = 'contract'").collect()}
    assert ("SC-008", "c", "CRITICAL") in found and {f[:2] for f in found} == {("SC-008", "c"), ("SC-005", "id"), ("SC-005", "c")}
    assert run.blocked


def test_personal_data_is_counted_in_the_one_aggregate(spark, monkeypatch):
    from tableward.plans import suite as plans

    df = spark.range(200).select("id", (F.col("id") + 1).alias("v"), F.lit(None).cast("string").alias("email"),
                                 F.when(F.col("id") < 5, "10.0.0.1").otherwise("none").alias("note"), (F.col("id") % 100).alias("age"))
    seen = []
    monkeypatch.setattr(plans.B, "profile", lambda *a, profile=plans.B.profile: seen.append(a) or profile(*a))
    run = run_tiers(df, suite(), "b", "2024-01-01")
    found = {(r.check_name, r.failure_code, r.severity, r.affected_fields[0], r.affected_count) for r in run.anomalies.filter("layer = 6").collect()}
    # A column named like personal data is reported though it holds no value.
    assert found == {("personal_data", "ET-006", "CRITICAL", "email", 0), ("personal_data", "ET-006", "CRITICAL", "note", 5),
                     ("minors", "ET-005", "WARNING", "age", 34), ("imbalance", "ET-001", "WARNING", "age", None)}
    assert len(seen) == 1
