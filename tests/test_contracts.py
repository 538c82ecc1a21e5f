import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tableward.operators import contracts as C
from tableward.sources import definitions

SCHEMA = {
    "id": "orders-contract", "version": "1.0.0", "source": "orders", "additionalProperties": False,
    "properties": {
        "order_id": {"type": "string", "pattern": "^ORD-[0-9]{8}$"}, "customer_id": {"type": "string"},
        "order_total": {"type": "number", "minimum": 0}, "discount": {"type": "number", "minimum": 0},
        "status": {"type": "string", "enum": ["PENDING", "CONFIRMED", "SHIPPED", "DELIVERED"]},
        "created_at": {"type": "string", "format": "date-time"},
    },
    "required": ["order_id", "customer_id", "order_total", "status", "created_at"],
    "x-column-criticality": {"discount": "optional", "order_id": "required", "customer_id": "required",
                             "order_total": "required", "status": "required", "created_at": "required"},
}


@pytest.fixture(scope="module")
def contract():
    return definitions.contract_from(SCHEMA)


def rows(spark, *values):
    return spark.createDataFrame(values, "order_id string, customer_id string, order_total double, discount double, "
                                         "status string, created_at timestamp")


GOOD = ("ORD-00000001", "CUST-001", 100.0, None, "PENDING", dt.datetime(2024, 1, 1))


def test_both_layouts_give_the_same_contract(contract, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(definitions.contract_to(contract)))
    assert definitions.read_contract(str(tmp_path / "c.json")) == contract
    assert [c.type for c in contract.columns][-1] == "datetime" and not contract.columns[3].required


def test_valid_rows_pass(spark, contract):
    assert C.validate_contract(rows(spark, GOOD), contract).count() == 0


def test_missing_extra_type_and_constraint(spark, contract):
    bad = rows(spark, GOOD, ("bad", "C", -1.0, -1.0, "LOST", None)).drop("customer_id").withColumn(
        "extra", F.lit(1)).withColumn("order_total", F.col("order_total").cast("string"))
    found = {(r["failure_code"], r["column_name"]): (r["severity"], r["blocking"], r["affected_count"])
             for r in C.validate_contract(bad, contract).collect()}
    assert found == {
        ("SC-001", "customer_id"): ("CRITICAL", True, 2), ("SC-002", "extra"): ("INFO", False, 2),
        ("SC-005", "order_id"): ("CRITICAL", True, 1), ("SC-005", "order_total"): ("CRITICAL", True, 1),
        ("SC-005", "discount"): ("WARNING", False, 1), ("SC-005", "status"): ("CRITICAL", True, 1),
        ("SC-003", "created_at"): ("CRITICAL", True, 1),
    }


def test_text_must_read_as_declared(spark):
    contract = C.Contract("c", "1.0.0", "s", (C.ContractColumn("n", "integer"), C.ContractColumn("d", "date")))
    df = spark.createDataFrame([("1", "2024-01-31"), ("1.5", "2024-02-31"), (None, None)], "n string, d string")
    assert {r["column_name"]: r["affected_count"] for r in C.validate_contract(df, contract).collect()} == {"n": 1, "d": 1}


@pytest.mark.parametrize("value, lost", [(1.25, False), (1.255, True), (1234.5, False), (12345.5, True), (100.0, False),
                                         (1e20, True), (0.00001, True), (0.0, False), (-999.99, False), (12345678.5, True)])
def test_precision(spark, value, lost):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(C.loses_precision(F.col("v"), 5, 2).alias("x")).first()["x"] is lost


def versions(spark, *columns):
    contract = C.Contract("c", "1.0.0", "s", columns, additional_properties=True)
    return definitions.contract_table(spark, [contract]).withColumnRenamed("x", "x")


def test_changes_between_versions(spark):
    K = C.ContractColumn
    old = versions(spark, K("gone", required=True), K("kind", "integer"), K("wide", "integer", max_length=10, enum=("a", "b")),
                   K("opt", nullable=True), K("req", required=True, min_length=3))
    new = versions(spark, K("kind", "number"), K("wide", "string", max_length=5, minimum=1, pattern="x", enum=("a",)),
                   K("opt", required=True, nullable=False), K("req", nullable=True), K("added"))
    broken = {(r["column_name"], r["change_type"], r["description"]) for r in C.breaking_changes(old, new).collect()}
    assert broken == {
        ("gone", "removed_required_column", "required column removed"),
        ("wide", "breaking_type_change", "type changed from integer to string"),
        ("wide", "constraint_narrowed", "maxLength narrowed from 10 to 5"),
        ("wide", "constraint_narrowed", "minimum increased to 1.0"),
        ("wide", "constraint_narrowed", "pattern constraint added"),
        ("wide", "constraint_narrowed", "enum values removed: b"),
        ("opt", "constraint_narrowed", "nullable changed from true to false"),
        ("opt", "made_required", "changed from optional to required"),
    }
    harmless = {(r["column_name"], r["change_type"]) for r in C.nonbreaking_changes(old, new).collect()}
    assert harmless == {("added", "added_optional_column"), ("req", "made_optional"), ("req", "constraint_widened")}
    assert C.breaking_changes(old, old).count() == 0 and C.nonbreaking_changes(new, new).count() == 0


def test_hash_ignores_column_order_but_not_constraints(spark):
    a, b = C.ContractColumn("a", max_length=3), C.ContractColumn("b", "number", minimum=1)
    hashes = [C.contract_hashes(versions(spark, *cs)).first()["contract_hash"]
              for cs in ((a, b), (b, a), (a, C.ContractColumn("b", "number", minimum=2)))]
    assert hashes[0] == hashes[1] != hashes[2]


def test_version_order_is_numeric(spark):
    df = spark.createDataFrame([("c", "1.9.0"), ("c", "1.10.0"), ("c", "junk")], "contract_id string, version string")
    assert C.latest_versions(df).first()["latest_version"] == "1.10.0"
    pair = spark.createDataFrame([("1.10.0", "1.9.9"), ("2.0.0", "1.0.0"), ("1.0.0", "1.0.1")], "a string, b string")
    got = [(r["direction"], r["is_major"], r["severity"]) for r in C.compare_versions(pair, "a", "b").collect()]
    assert got == [(1, False, "INFO"), (1, True, "WARNING"), (-1, False, "INFO")]


def test_rules_and_deadlines_from_files(tmp_path):
    (tmp_path / "r.yaml").write_text(
        "rules:\n- {id: a, type: domain, expression: 'x > 0', severity: critical, failure_code: BL-006}\n"
        "- {id: b, type: temporal, field: d, rule: no_future}\n"
        "- {id: c, type: temporal, fields: [d, e], parameters: {check_type: sequence}}\n")
    rules = definitions.read_rules(str(tmp_path / "r.yaml"))
    assert [(r.severity, r.failure_code, r.check, r.fields) for r in rules] == [
        ("CRITICAL", "BL-006", "", ()), ("WARNING", "BL-005", "no_future", ("d",)), ("WARNING", "BL-005", "sequence", ("d", "e"))]
    (tmp_path / "s.yaml").write_text("sla_definitions:\n- {id: s, source: o, schedule: '0 6 * * *', latency_threshold: 60, "
                                     "freshness_threshold: {warning_minutes: 5, critical_minutes: 6}}\n")
    sla = definitions.read_slas(str(tmp_path / "s.yaml"))[0]
    assert (sla.warning_minutes, sla.critical_minutes, sla.latency_seconds) == (5, 6, 60)
