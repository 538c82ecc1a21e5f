"""Whole validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableward.operators import bronze as B
from tableward.operators import checks as U
from tableward.operators import contracts as C
from tableward.operators import ethics as E
from tableward.operators import freshness as FR
from tableward.operators import rules as R
from tableward.operators import statistics as D
from tableward.plans.catalog.contracts import CONTRACT_FINDINGS, ORDERS, orders_under_contract
from tableward.plans.catalog.models import CONF, DRIFT, ERR, LAT, LONG, MEANS, PSI, _histogram, log
from tableward.plans.catalog.rules import GOOD, good_customers
from tableward.plans.registry import query
from tableward.plans.suite import ReferenceCheck, Suite, model_layers, run_models, run_tiers

CONTRACT = C.Contract("orders", "1.0.0", "orders", (
    C.ContractColumn("o_orderkey", "integer", required=True, nullable=False),
    C.ContractColumn("o_custkey", "integer", required=True),
    C.ContractColumn("o_orderstatus", "string", enum=("O", "F")),
    C.ContractColumn("o_totalprice", "number", minimum=5000, maximum=450000),
    C.ContractColumn("o_orderdate", "datetime"),
), additional_properties=False)
AS_OF = "2001-08-02 12:00:00"


def suite(t, contract):
    early = t.orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return Suite(
        keys=("o_orderkey",), contract=contract,
        bronze=B.BatchSpec(count=B.CountSpec(minimum=100), required=("o_custkey",),
                           ranges=(B.RangeSpec("o_totalprice", 20000, 400000),), duplicates=B.DuplicateSpec(("o_custkey", "o_orderdate"))),
        rules=(R.Rule("known_status", "domain", "o_orderstatus IN ('O', 'F')", severity="INFO"),
               R.Rule("urgent_is_big", "crossfield", "o_totalprice > 50000", condition="o_orderpriority = '1-URGENT'", severity="WARNING")),
        references=(ReferenceCheck("o_custkey", good_customers(t), "c_custkey"),),
        baselines={"o_orderpriority": D.categorical_baseline(early, "o_orderpriority")},
        slas=FR.sla_table(t.spark, [FR.Sla("sla-orders", "orders", "0 6 * * *", 60, 3000)]),
        arrivals=t.orders.select(F.lit("orders").alias("source"), F.col("o_orderdate").alias("ts")))


def listed(run):
    return run.anomalies.select(
        "layer", "failure_code", "check_name", "severity", F.coalesce("affected_count", F.lit(-1)).cast("bigint").alias("affected_count"))


BRONZE = """
b AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_totalprice < 20000 OR o_totalprice > 400000) AS out, (SELECT sum(m) FROM (SELECT count(*) AS m FROM orders GROUP BY o_custkey, o_orderdate) WHERE m > 1) AS dup,
  (SELECT count(*) FROM (SELECT count(*) AS m FROM orders GROUP BY o_custkey, o_orderdate) WHERE m > 1) AS grp FROM orders),
bronze AS (
  SELECT CAST(1 AS INTEGER) AS layer, 'DV-004' AS failure_code, 'range' AS check_name, CASE WHEN out * 100.0 / total >= 20 THEN 'CRITICAL' WHEN out * 100.0 / total >= 1 THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(out AS BIGINT) AS affected_count FROM b WHERE out > 0
  UNION ALL SELECT 1, 'DV-006', 'duplicate', CASE WHEN s >= 70 THEN 'CRITICAL' WHEN s >= 40 THEN 'WARNING' ELSE 'INFO' END, CAST(dup AS BIGINT) FROM
    (SELECT *, CASE WHEN dup * 100.0 / total >= 20 THEN 70 WHEN dup * 100.0 / total >= 10 THEN 55 WHEN dup * 100.0 / total >= 5 THEN 45 ELSE 35 END + CASE WHEN grp >= 50 THEN 10 WHEN grp >= 20 THEN 5 ELSE 0 END AS s FROM b) WHERE dup * 100.0 / total > 0.5)"""


@query("run_tiers", f"""WITH {BRONZE},
found AS (SELECT * FROM bronze
  UNION ALL SELECT 2, 'SC-002', 'contract', 'INFO', count(*) FROM orders
  UNION ALL SELECT 2, 'SC-005', 'contract', 'WARNING', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') HAVING count(*) > 0
  UNION ALL SELECT 2, 'SC-005', 'contract', 'WARNING', count(*) FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 450000 HAVING count(*) > 0
  UNION ALL SELECT 3, 'BL-006', 'rule', 'INFO', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') HAVING count(*) > 0
  UNION ALL SELECT 3, 'BL-001', 'rule', 'WARNING', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice <= 50000 HAVING count(*) > 0
  UNION ALL SELECT 3, 'BL-002', 'reference', 'CRITICAL', count(*) FROM orders WHERE o_custkey NOT IN {GOOD} HAVING count(*) > 0
  UNION ALL SELECT 4, 'FR-002', 'freshness', 'CRITICAL', -1 FROM orders HAVING count(*) > 0
  UNION ALL SELECT 4, 'FR-005', 'freshness', 'CRITICAL', -1 FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01 06:00:00', TIMESTAMP '{AS_OF}', INTERVAL 1 DAY)) AS tick)
    WHERE tick > (SELECT max(o_orderdate) FROM orders) HAVING count(*) >= 2
  UNION ALL SELECT 4, 'FR-001', 'freshness', CASE WHEN m >= 3000 THEN 'CRITICAL' ELSE 'WARNING' END, -1 FROM (SELECT date_diff('second', max(o_orderdate), TIMESTAMP '{AS_OF}') / 60.0 AS m FROM orders) WHERE m >= 60)
SELECT * FROM found""")
def run_tiers_query(t):
    return listed(run_tiers(t.orders, suite(t, CONTRACT), "orders-1", AS_OF))


@query("run_tiers_blocked", f"""WITH {BRONZE}, {CONTRACT_FINDINGS}
SELECT * FROM bronze UNION ALL SELECT 2, failure_code, 'contract', severity, affected_count FROM contract_findings""")
def run_tiers_blocked(t):
    return listed(run_tiers(orders_under_contract(t), suite(t, ORDERS), "orders-1", AS_OF))


@query("run_tiers_layers", f"""WITH {BRONZE}, {CONTRACT_FINDINGS},
f AS (SELECT layer, severity FROM bronze UNION ALL SELECT 2, severity FROM contract_findings),
l AS (SELECT * FROM (VALUES (1, 'bronze', true), (2, 'schema', true), (3, 'business', false), (4, 'freshness', false), (5, 'model', false), (6, 'ethics', true)) v(layer, name, evaluated))
SELECT CAST(l.layer AS INTEGER) AS layer, name, evaluated, CASE WHEN evaluated THEN greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 10 WHEN 'INFO' THEN 2 END), 0)) END AS score, count(severity) AS anomalies
FROM l LEFT JOIN f ON f.layer = l.layer GROUP BY l.layer, name, evaluated""")
def run_tiers_layers(t):
    return run_tiers(orders_under_contract(t), suite(t, ORDERS), "orders-1", AS_OF).layers


# Every kind of rule, over orders with an array of their lines' prices.
RULED = """
ruled AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  (SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM orders),
steps AS (SELECT o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders)"""
KINDS = (
    R.Rule("r1", "domain", "o_totalprice > 20000", severity="INFO"),
    R.Rule("r2", "crossfield", "o_totalprice > 50000", condition="o_orderpriority = '1-URGENT'"),
    R.Rule("r3", "calculation", "sum(lines.amount) == o_totalprice", tolerance=1000.0),
    R.Rule("r4", "temporal", fields=("o_orderdate",), check="not_future"),
    R.Rule("r5", "state_transition", fields=("o_orderstatus",), allowed=("O", "F"), severity="INFO"),
    R.Rule("r6", "state_transition", fields=("o_orderstatus",), transitions=(("F", ("O",)), ("O", ("P", "F"))),
           entity="o_custkey", order=("o_orderdate", "o_orderkey"), severity="CRITICAL"),
    R.Rule("r7", "referential", fields=("o_custkey",), reference="good", severity="CRITICAL"),
    R.Rule("r8", "orphan", fields=("o_custkey",), reference="good"),
    R.Rule("r9", "referential", fields=("o_custkey",), reference="unknown"),
    R.Rule("r10", "domain", "no_such_column > 1"),
)


@query("run_tiers_rules", f"""WITH {RULED}, found AS (
  SELECT 'r1' AS rule_id, 'BL-006' AS failure_code, 'INFO' AS severity, count(*) AS n FROM ruled WHERE o_totalprice <= 20000
  UNION ALL SELECT 'r2', 'BL-001', 'WARNING', count(*) FROM ruled WHERE o_orderpriority = '1-URGENT' AND o_totalprice <= 50000
  UNION ALL SELECT 'r3', 'BL-003', 'WARNING', count(*) FROM ruled WHERE abs(coalesce(items, 0) - o_totalprice) > 1000 AND items IS NOT NULL
  UNION ALL SELECT 'r4', 'BL-005', 'WARNING', count(*) FROM ruled WHERE o_orderdate > TIMESTAMP '2000-01-01'
  UNION ALL SELECT 'r5', 'BL-004', 'INFO', count(*) FROM ruled WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT 'r6', 'BL-004', 'CRITICAL', count(*) FROM steps WHERE previous IS NOT NULL AND NOT ((previous = 'F' AND o_orderstatus = 'O') OR (previous = 'O' AND o_orderstatus IN ('P', 'F')))
  UNION ALL SELECT 'r7', 'BL-002', 'CRITICAL', count(*) FROM ruled WHERE o_custkey NOT IN {GOOD}
  UNION ALL SELECT 'r8', 'BL-008', 'WARNING', count(*) FROM ruled WHERE o_custkey NOT IN {GOOD})
SELECT rule_id, failure_code, severity, n AS affected_count, false AS skipped FROM found WHERE n > 0
UNION ALL SELECT * FROM (VALUES ('r9', NULL, NULL, NULL, true), ('r10', NULL, NULL, NULL, true))""")
def run_tiers_rules(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("amount"))).alias("lines"))
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    run = run_tiers(orders, Suite(keys=("o_orderkey",), rules=KINDS, sets={"good": (good_customers(t), "c_custkey")},
                                  personal_data=False), "orders-1", "2000-01-01 00:00:00")
    found = run.anomalies.filter("check_name = 'rule'").select(
        "rule_id", "failure_code", "severity", F.col("affected_count").cast("bigint").alias("affected_count"), F.lit(False).alias("skipped"))
    skipped = t.spark.createDataFrame([(r, True) for r, _ in run.skipped], "rule_id string, skipped boolean")
    return found.unionByName(skipped, allowMissingColumns=True)


@query("run_tiers_freshness", f"""WITH last AS (SELECT event_type AS source, max(ts) AS came FROM events GROUP BY 1),
due AS (SELECT source, came, tick FROM last, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 01:20:00', INTERVAL 1 HOUR)) AS tick) WHERE tick > came)
SELECT source, 'FR-001' AS failure_code, CASE WHEN date_diff('microsecond', came, TIMESTAMP '2024-01-31 01:20:00') >= 5400000000 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM last WHERE date_diff('microsecond', came, TIMESTAMP '2024-01-31 01:20:00') >= 3600000000
UNION ALL SELECT source, 'FR-003', 'WARNING' FROM last
UNION ALL SELECT source, 'FR-005', 'CRITICAL' FROM due GROUP BY source HAVING count(*) >= 2""")
def run_tiers_freshness(t):
    slas = FR.sla_table(t.spark, [FR.Sla(f"sla-{s}", s, "0 * * * *", 60, 90) for s in (
        "click", "view", "purchase", "signup", "error")])
    run = run_tiers(t.events, Suite(keys=("event_id",), slas=slas, personal_data=False, arrivals=t.events.select(
        F.col("event_type").alias("source"), "ts")), "events-1", "2024-01-31 01:20:00")
    return run.anomalies.filter("layer = 4").select(F.col("subject").alias("source"), "failure_code", "severity")


@query("run_tiers_ethics", """WITH p AS (SELECT c_custkey, c_custkey % 97 AS age, CASE WHEN c_custkey % 40 = 0 THEN 'x' ELSE 'y' END AS gender,
  CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS email, CASE WHEN c_custkey % 10 = 0 THEN 'mail a.b@c.org' ELSE 'none' END AS note FROM customer)
SELECT 'ET-006' AS failure_code, 'CRITICAL' AS severity, 'email' AS field, count(email) AS affected_count FROM p
UNION ALL SELECT 'ET-006', 'CRITICAL', 'note', count(*) FROM p WHERE note <> 'none'
UNION ALL SELECT 'ET-005', CASE WHEN count(*) < 100 THEN 'WARNING' ELSE 'CRITICAL' END, 'age', count(*) FROM p WHERE age > 0 AND age < 18
UNION ALL SELECT 'ET-001', 'WARNING', 'gender', -1 UNION ALL SELECT 'ET-001', 'WARNING', 'age', -1""")
def run_tiers_ethics(t):
    k = F.col("c_custkey")
    people = t.customer.select(
        k, (k % 97).alias("age"), F.when(k % 40 == 0, "x").otherwise("y").alias("gender"),
        F.when(k % 7 != 0, F.col("c_name")).alias("email"), F.when(k % 10 == 0, "mail a.b@c.org").otherwise("none").alias("note"))
    run = run_tiers(people, Suite(keys=("c_custkey",)), "people-1", AS_OF)
    return run.anomalies.filter("layer = 6").select(
        "failure_code", "severity", F.col("affected_fields")[0].alias("field"),
        F.coalesce("affected_count", F.lit(-1)).cast("bigint").alias("affected_count"))


FEATURES = ["prediction", "confidence", "latency_ms", "f_user"]


MODELS = f"""{DRIFT}, {MEANS}, {LONG},
{_histogram(False, 'long', 'model_id, feature', 'value').replace('st2', 'fst2').replace('st AS', 'fst AS').replace('FROM st)', 'FROM fst)').replace('grid', 'fgrid').replace('placed', 'fplaced').replace(chr(10) + 'h AS', chr(10) + 'fh AS')},
{PSI.format('model_id, feature').replace('psi AS (', 'fpsi AS (', 1).replace('FROM h)', 'FROM fh)')},
fd AS (SELECT model_id, count(*) FILTER (WHERE psi >= 0.25) AS drifted, max(psi) AS max_psi FROM fpsi GROUP BY 1),
conf AS ({CONF}), lat AS ({LAT}), err AS ({ERR}),
stale AS (SELECT model_id, date_diff('second', max(ts), TIMESTAMP '2024-03-31 00:30:00') // 86400 AS age FROM log GROUP BY 1),
found AS (SELECT model_id, 'ML-001' AS failure_code, severity FROM drift
  UNION ALL SELECT model_id, 'ML-002', CASE WHEN drifted > 0 THEN CASE WHEN drifted / 4.0 >= 0.5 OR max_psi >= 0.5 THEN 'CRITICAL' ELSE 'WARNING' END END FROM fd
  UNION ALL SELECT model_id, failure_code, severity FROM conf UNION ALL SELECT model_id, failure_code, severity FROM lat UNION ALL SELECT model_id, failure_code, severity FROM err
  UNION ALL SELECT model_id, 'ML-003', CASE WHEN age >= 90 THEN 'CRITICAL' WHEN age >= 60 THEN 'WARNING' END FROM stale),
sig AS (SELECT f.model_id, (1 - any_value(err_c) < 0.7)::INT + bool_or(failure_code IN ('ML-001', 'ML-002') AND severity IS NOT NULL)::INT + bool_or(failure_code = 'ML-003' AND severity IS NOT NULL)::INT + bool_or(failure_code = 'ML-006' AND severity = 'CRITICAL')::INT AS n
  FROM found f JOIN means m ON f.model_id = m.model_id GROUP BY 1),
every AS (SELECT * FROM found WHERE severity IS NOT NULL UNION ALL SELECT model_id, 'ML-008', CASE WHEN n >= 3 THEN 'CRITICAL' WHEN n = 2 THEN 'WARNING' ELSE 'INFO' END FROM sig WHERE n > 0
  UNION ALL SELECT 'view', 'ML-007', 'CRITICAL' UNION ALL SELECT 'click', 'ML-007', 'WARNING'
  UNION ALL SELECT model_id, 'ET-004', 'CRITICAL' FROM means WHERE model_id IN ('click', 'error') UNION ALL SELECT model_id, 'ET-007', 'CRITICAL' FROM means)"""


def model_findings(t):
    """All checks: one model lacks a feature, one has another type, two explain nothing, none is audited."""
    rows = log(t).drop("cur")
    feature = lambda have: t.spark.createDataFrame(have, "model_id string, feature string, type string")
    models = rows.select("model_id").distinct()
    flags = [F.col("model_id").isin("view", "purchase", "signup").alias(f"has_{n}") for n in (
        "feature_importance", "shap_values", "local_explanations", "model_card")]
    registry = models.select("model_id", F.lit("neural").alias("model_type"), *flags)
    nothing = t.events.limit(0).select(F.lit("").alias("model_id"), F.lit("").alias("kind"), "ts")
    return run_models(
        rows, "2024-03-31 00:30:00", FEATURES, rows.select("model_id", F.col("ts").alias("trained_at")),
        feature([("view", "a", "bigint"), ("view", "b", "bigint"), ("click", "a", "bigint")]),
        feature([("view", "a", "bigint"), ("click", "a", "double")]),
        [E.explainability(registry), E.audit_trail(nothing, registry=models)])


@query("run_models", MODELS + " SELECT * FROM every")
def run_models_query(t):
    return model_findings(t)


@query("run_models_layers", MODELS + """
SELECT model_id, greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'WARNING' THEN 10 ELSE 2 END) FILTER (WHERE failure_code LIKE 'ML-%'), 0)) AS health_score,
  greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 12 ELSE 3 END) FILTER (WHERE failure_code LIKE 'ET-%'), 0)) AS ethics_score,
  count(*) AS findings, coalesce(bool_or(severity = 'CRITICAL' AND failure_code LIKE 'ML-%'), false) AS blocked_by_health, least(health_score, ethics_score) AS overall_score
FROM every GROUP BY model_id""")
def run_models_layers(t):
    return model_layers(model_findings(t), log(t))


def crowded(df):
    """Orders of customers with over 25 orders."""
    busy = df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 25")
    return df.join(busy, "o_custkey", "left_semi")


USER_CHECKS = (
    U.Check("price_per_day", "BL-001", "o_totalprice", ("o_totalprice", "o_orderkey"),
            rows=lambda df: F.col("o_totalprice") / (F.col("o_orderkey") % 10) > 40000, severity="WARNING"),
    U.Check("mean_price", "DV-004", "o_totalprice", ("o_totalprice",), measure=lambda df: F.col("o_totalprice"), limits=(None, 1000.0), score=75.0),
    U.Check("open_share", "DV-004", "o_orderstatus", ("o_orderstatus",), measure=lambda df: (F.col("o_orderstatus") == "O").cast("double"), limits=(0.0, 1.0)),
    U.Check("crowded", "BL-001", "o_custkey", ("o_custkey",), plan=crowded, severity="INFO"),
    U.Check("nowhere", "BL-001", "o_margin", ("o_margin",), rows=lambda df: F.col("o_margin") < 0),
    U.Check("broken", "BL-001", rows=lambda df: 1 / 0),
)


@query("custom_checks", """
WITH c AS (SELECT count(*) AS total, avg(o_totalprice) AS mean, count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_totalprice / (o_orderkey % 10) > 40000) AS dear,
    (SELECT coalesce(sum(m), 0) FROM (SELECT count(*) AS m FROM orders GROUP BY o_custkey) WHERE m > 25) AS crowd FROM orders),
f AS (
  SELECT 'price_per_day' AS check_name, 'BL-001' AS failure_code, dear AS n, total, 'WARNING' AS level FROM c
  UNION ALL SELECT 'mean_price', 'DV-004', CASE WHEN mean > 1000 THEN total ELSE 0 END, total, 'CRITICAL' FROM c
  UNION ALL SELECT 'open_share', 'DV-004', 0, total, NULL FROM c
  UNION ALL SELECT 'crowded', 'BL-001', crowd, total, 'INFO' FROM c)
SELECT check_name, failure_code, CAST(n AS BIGINT) AS affected_count, total AS total_count, CASE WHEN n > 0 THEN level END AS severity, false AS skipped FROM f
UNION ALL SELECT 'nowhere', NULL, NULL, NULL, NULL, true UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, true""")
def custom_checks(t):
    """Checks of a user: a predicate with zero divisors, measures, a plan, and two that cannot run."""
    found, skipped = U.run_checks(t.orders, USER_CHECKS)
    rest = t.spark.createDataFrame([(name, True) for name, _ in skipped], "check_name string, skipped boolean")
    return found.select("check_name", "failure_code", "affected_count", "total_count", "severity", F.lit(False).alias("skipped")).unionByName(
        rest, allowMissingColumns=True)
