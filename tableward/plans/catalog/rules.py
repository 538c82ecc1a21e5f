"""Layer 3: business rules and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableward.operators import references as J
from tableward.operators import rules as R
from tableward.functions import severity as S
from tableward.plans.registry import query

AS_OF = "2001-01-01"


def order_lines(t):
    """Lines with the order they belong to."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


ORDER_LINES = "lines AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

RULES = (
    R.Rule("ship_after_order", "crossfield", "l_shipdate >= o_orderdate", severity="CRITICAL",
           fields=("l_shipdate", "o_orderdate"), priority=10),
    R.Rule("discount_covers_tax", "crossfield", "l_discount >= l_tax", fields=("l_discount", "l_tax")),
    R.Rule("bulk_discount", "domain", "l_discount >= 0.03", condition="l_quantity > 40",
           fields=("l_discount",), priority=5),
    R.Rule("line_price", "calculation", "l_quantity * 1000", fields=("l_extendedprice",),
           tolerance=10000.0, severity="CRITICAL"),
    R.Rule("known_status", "domain", "o_orderstatus IN ('O', 'F')", fields=("o_orderstatus",), severity="INFO"),
    R.Rule("not_shipped_later", "temporal", fields=("l_shipdate",), check="no_future"),
    R.Rule("date_order", "temporal", fields=("o_orderdate", "l_shipdate"), check="sequence", severity="CRITICAL"),
    R.Rule("switched_off", "domain", "false", fields=("l_tax",), enabled=False, priority=1),
)

# The same rules as SQL conditions that are true on violating rows.
BROKEN = {
    "ship_after_order": ("BL-001", "CRITICAL", "l_shipdate < o_orderdate", "l_shipdate,o_orderdate", 10),
    "discount_covers_tax": ("BL-001", "WARNING", "l_discount < l_tax", "l_discount,l_tax", 0),
    "bulk_discount": ("BL-006", "WARNING", "l_quantity > 40 AND l_discount < 0.03", "l_discount", 5),
    "line_price": ("BL-003", "CRITICAL", "abs(l_extendedprice - l_quantity * 1000) > 10000.0", "l_extendedprice", 0),
    "known_status": ("BL-006", "INFO", "o_orderstatus NOT IN ('O', 'F')", "o_orderstatus", 0),
    "not_shipped_later": ("BL-005", "WARNING", f"l_shipdate > TIMESTAMP '{AS_OF}'", "l_shipdate", 0),
    "date_order": ("BL-005", "CRITICAL", "l_shipdate < o_orderdate", "o_orderdate,l_shipdate", 0),
}
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY_SQL = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _violations_sql(*names: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {LINE_KEY_SQL} AS row_key, '{n}' AS rule_id, '{BROKEN[n][0]}' AS failure_code, "
        f"'{BROKEN[n][1]}' AS severity, '{BROKEN[n][3]}' AS fields FROM lines WHERE {BROKEN[n][2]}"
        for n in names)


def _check(t, *names):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return R.check_rules(order_lines(t), [r for r in RULES if r.id in names], LINE_KEY, as_of)


for _name, _ids in {
    "rule_crossfield": ("ship_after_order", "discount_covers_tax"),
    "rule_conditional": ("bulk_discount",),
    "rule_domain": ("bulk_discount", "known_status"),
    "rule_calculation": ("line_price",),
    "rule_allowed_states": ("known_status",),
    "rule_no_future": ("not_shipped_later",),
    "rule_date_sequence": ("date_order",),
}.items():
    query(_name, f"WITH {ORDER_LINES} {_violations_sql(*_ids)}")(lambda t, ids=_ids: _check(t, *ids))


UNDEFINED = (
    R.Rule("unit_price", "crossfield", "l_extendedprice / (l_quantity - l_linenumber) > 500", fields=("l_quantity",), severity="CRITICAL"),
    R.Rule("reads_as_number", "domain", "cast(code AS INT) >= 0", fields=("code",)),
    R.Rule("third_part", "domain", "parts[2] <> ''", fields=("parts",)),
    R.Rule("named_part", "domain", "element_at(parts, l_linenumber) IS NOT NULL", fields=("parts",), severity="INFO"),
    R.Rule("share_of_price", "calculation", "l_tax / l_discount", fields=("l_discount",), tolerance=0.5),
    R.Rule("only_if_ratio", "domain", "false", condition="l_tax / l_discount > 4", fields=("l_tax",)),
)


@query("rule_undefined", f"""
WITH lines AS (
  SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS code,
    CASE WHEN l_partkey % 2 = 0 THEN ['a', 'b'] ELSE ['a', 'b', 'c', 'd'] END AS parts FROM lineitem),
hits AS (
  SELECT *, 'unit_price' AS rule_id, 'BL-001' AS failure_code, 'CRITICAL' AS severity, 'l_quantity' AS fields FROM lines
    WHERE NOT coalesce(CASE WHEN l_quantity <> l_linenumber THEN l_extendedprice / (l_quantity - l_linenumber) END > 500, false)
  UNION ALL SELECT *, 'reads_as_number', 'BL-006', 'WARNING', 'code' FROM lines WHERE NOT coalesce(try_cast(code AS INTEGER) >= 0, false)
  UNION ALL SELECT *, 'third_part', 'BL-006', 'WARNING', 'parts' FROM lines WHERE len(parts) < 3
  UNION ALL SELECT *, 'named_part', 'BL-006', 'INFO', 'parts' FROM lines WHERE len(parts) < l_linenumber
  UNION ALL SELECT *, 'share_of_price', 'BL-003', 'WARNING', 'l_discount' FROM lines WHERE l_discount <> 0 AND abs(l_discount - l_tax / l_discount) > 0.5
  UNION ALL SELECT *, 'only_if_ratio', 'BL-006', 'WARNING', 'l_tax' FROM lines WHERE l_discount <> 0 AND l_tax / l_discount > 4)
SELECT {LINE_KEY_SQL} AS row_key, rule_id, failure_code, severity, fields FROM hits""")
def rule_undefined(t):
    """Rows that rules cannot evaluate: zero divisors, text that is no number, missing elements."""
    lines = t.lineitem.withColumns({
        "code": F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string")),
        "parts": F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(
            F.array(*map(F.lit, "abcd")))})
    return R.check_rules(lines, UNDEFINED, LINE_KEY)


@query("rule_report", f"WITH {ORDER_LINES}, counted AS (SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE {b[2]}) AS {n}" for n, b in BROKEN.items()) + " FROM lines) " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule_id, {b[4]} AS priority, false AS skipped, total AS evaluated, total - {n} AS passed, {n} AS failed FROM counted"
    for n, b in BROKEN.items()) + " UNION ALL SELECT 'switched_off', 1, true, 0, 0, 0")
def rule_report(t):
    return R.rule_report(order_lines(t), RULES, F.lit(AS_OF).cast("timestamp_ntz"))


@query("violation_rollup", f"""WITH {ORDER_LINES}, found AS ({_violations_sql(*BROKEN)}),
ranked AS (SELECT rule_id, row_key, row_number() OVER (PARTITION BY rule_id ORDER BY row_key) AS r FROM found)
SELECT rule_id, max(failure_code) AS failure_code, max(severity) AS severity, count(*) AS violations,
  least(100.0::DOUBLE, 30.0::DOUBLE + count(*) * 10) AS severity_score,
  (SELECT string_agg(row_key, ',' ORDER BY row_key) FROM ranked WHERE r <= 5 AND ranked.rule_id = found.rule_id) AS sample_keys
FROM found GROUP BY rule_id""")
def violation_rollup(t):
    return R.rollup(_check(t, *BROKEN)).withColumn("sample_keys", F.array_join("sample_keys", ","))


@query("violation_rollup_code", f"""WITH {ORDER_LINES}, found AS ({_violations_sql(*BROKEN)})
SELECT failure_code, CASE max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS violations,
  least(100.0::DOUBLE, 30.0::DOUBLE + count(*) * 10) AS severity_score FROM found GROUP BY failure_code""")
def violation_rollup_code(t):
    return R.rollup(_check(t, *BROKEN), by=["failure_code"], samples=0)


@query("score_business", f"""WITH {ORDER_LINES}, found AS ({_violations_sql(*BROKEN)}),
anomalies AS (SELECT rule_id, max(severity) AS severity FROM found GROUP BY rule_id)
SELECT count(*) AS anomalies, greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'WARNING' THEN 10 ELSE 2 END)) AS score
FROM anomalies""")
def score_business(t):
    anomalies = R.rollup(_check(t, *BROKEN), samples=0)
    return anomalies.agg(F.count(F.lit(1)).alias("anomalies"),
                         S.layer_score(F.col("severity"), "business").alias("score"))


@query("rule_child_sum", """
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, round(coalesce(child_sum, 0), 2) AS child_sum FROM orders
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS child_sum FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
WHERE abs(o_totalprice - coalesce(child_sum, 0)) > 1000""")
def rule_child_sum(t):
    found = R.child_sums(t.orders, "o_orderkey", "o_totalprice", t.lineitem, "l_orderkey",
                         F.col("l_extendedprice"), tolerance=1000)
    return found.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"),
                        F.round("child_sum", 2).alias("child_sum"))


@query("rule_state_transition", """
WITH steps AS (SELECT o_custkey, o_orderkey, o_orderstatus,
  lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_state FROM orders)
SELECT *, CASE WHEN previous_state IN ('F', 'O') THEN 'not_allowed' ELSE 'unknown_state' END AS reason FROM steps
WHERE previous_state IS NOT NULL AND NOT ((previous_state = 'F' AND o_orderstatus = 'O') OR (previous_state = 'O' AND o_orderstatus IN ('P', 'F')))""")
def rule_state_transition(t):
    found = R.state_transitions(
        t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus",
        {"F": ["O"], "O": ["P", "F"]})
    return found.select("o_custkey", "o_orderkey", "o_orderstatus", "previous_state", "reason")


@query("auto_logic", """
WITH facts AS (SELECT l_extendedprice, l_quantity, l_tax * 1000 AS age, o_totalprice AS income, l_linenumber AS purchases,
    CAST(day(l_shipdate) % 3 AS BIGINT) AS days, CAST(o_orderdate AS VARCHAR) AS start_date, CAST(l_shipdate AS VARCHAR) AS end_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hits AS (
  SELECT 'auto_age_income_logic' AS rule_id, 'Young age with high income' AS rule_name, count(*) FILTER (WHERE age < 16 AND income > 50000) AS violations, count(*) AS records FROM facts
  UNION ALL SELECT 'auto_age_range_logic', 'Invalid age value', count(*) FILTER (WHERE age < 0 OR age > 120), count(*) FROM facts
  UNION ALL SELECT 'auto_negative_income', 'Negative income value', count(*) FILTER (WHERE income < 0), count(*) FROM facts
  UNION ALL SELECT 'auto_zero_days_with_purchases', 'Purchases with zero platform time', count(*) FILTER (WHERE days = 0 AND purchases > 0), count(*) FROM facts
  UNION ALL SELECT 'auto_excessive_purchases_rate', 'Unrealistic purchase rate', count(*) FILTER (WHERE days > 0 AND purchases / greatest(1, days) > 5), count(*) FROM facts
  UNION ALL SELECT 'auto_quantity_total_mismatch', 'Quantity and total price mismatch', count(*) FILTER (WHERE abs(l_quantity * 1000 - l_extendedprice) > 0.01), count(*) FROM facts
  UNION ALL SELECT 'auto_end_before_start', 'End date before start date', count(*) FILTER (WHERE end_date < start_date), count(*) FROM facts)
SELECT rule_id, rule_name, 'BL-006' AS failure_code, violations, records,
  CASE WHEN violations > 50 THEN 'CRITICAL' WHEN violations > 10 THEN 'WARNING' ELSE 'INFO' END AS severity,
  least(80.0::DOUBLE, 30.0::DOUBLE + violations * 2) AS severity_score
FROM hits WHERE violations > 0""")
def auto_logic(t):
    facts = order_lines(t).select(
        "l_extendedprice", "l_quantity", (F.col("l_tax") * 1000).alias("age"),
        F.col("o_totalprice").alias("income"), F.col("l_linenumber").alias("purchases"),
        (F.dayofmonth("l_shipdate") % 3).alias("days_on_platform"), F.lit(1000).alias("unit_price"),
        F.col("o_orderdate").alias("start_date"), F.col("l_shipdate").alias("end_date"))
    return R.auto_logic(facts, {"quantity": "l_quantity", "total": "l_extendedprice"})


# References ------------------------------------------------------------------------------------

# Customers in good standing are the reference, so orders of the others break.
GOOD = "(SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"


def good_customers(t):
    return t.customer.filter("c_acctbal >= 0")


@query("refint_lineitem_orders", """
SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, 'fk' AS field, CAST(fk AS VARCHAR) AS value,
  CASE WHEN fk IS NULL THEN 'null_fk' ELSE 'not_found' END AS reason
FROM (SELECT *, CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE l_orderkey END AS fk FROM lineitem)
WHERE fk IS NULL OR fk NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 20000)""")
def refint_lineitem_orders(t):
    lines = t.lineitem.withColumn("fk", F.when(F.col("l_orderkey") % 211 == 0, None).otherwise(F.col("l_orderkey")))
    return J.broken_references(lines, "fk", t.orders.filter("o_totalprice >= 20000"), "o_orderkey", LINE_KEY)


@query("refint_summary", f"""
SELECT 'check-o_custkey' AS rule_id, 'BL-002' AS failure_code, 'o_custkey' AS field, 'CRITICAL' AS severity,
  count(*) AS violations, CAST(0 AS BIGINT) AS null_keys, least(100.0::DOUBLE, 40.0::DOUBLE + count(*) * 10) AS severity_score
FROM orders WHERE o_custkey NOT IN {GOOD} HAVING count(*) > 0""")
def refint_summary(t):
    broken = J.broken_references(t.orders, "o_custkey", good_customers(t), "c_custkey", ["o_orderkey"])
    return J.reference_summary(broken, "check-o_custkey")


@query("orphan_orders", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN {GOOD}")
def orphan_orders(t):
    return J.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", good_customers(t), "c_custkey")


@query("childless_orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def childless_orders(t):
    return J.childless(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem, "l_orderkey")


@query("fk_discovery", """
SELECT c AS column_name, r AS reference, d AS distinct_keys, m AS matched_keys, round(m / CAST(d AS DOUBLE), 6) AS coverage FROM (
  SELECT 'part_id' AS c, 'parts' AS r, count(DISTINCT l_partkey) AS d, count(DISTINCT CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN l_partkey END) AS m FROM lineitem
  UNION ALL SELECT 'supp_id', 'suppliers', count(DISTINCT l_suppkey), count(DISTINCT CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier) THEN l_suppkey END) FROM lineitem
  UNION ALL SELECT 'order_id', 'orders', count(DISTINCT l_orderkey), count(DISTINCT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN l_orderkey END) FROM lineitem)""")
def fk_discovery(t):
    lines = t.lineitem.select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"),
                              F.col("l_orderkey").alias("order_id"), "l_quantity")
    found = J.discover_foreign_keys(lines, {
        "parts": (t.part.filter("p_size > 10"), "p_partkey"), "suppliers": (t.supplier, "s_suppkey"),
        "orders": (t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey")})
    return found.withColumn("coverage", F.round("coverage", 6))


@query("ref_load_dedup", """
SELECT ref_key, name, segment FROM (
  SELECT CAST(k AS VARCHAR) AS ref_key, c_name AS name, c_mktsegment AS segment,
    row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r
  FROM (SELECT CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey // 2 END AS k, c_custkey AS seq, c_name, c_mktsegment FROM customer)
  WHERE k IS NOT NULL) WHERE r = 1""")
def ref_load_dedup(t):
    records = t.customer.select(
        F.when(F.col("c_custkey") % 17 == 0, None).otherwise(F.expr("c_custkey div 2")).alias("k"),
        F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return J.load_reference(records, "k", ["seq"]).select("ref_key", "record.name", "record.segment")


@query("ref_lookup_active", """
SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS found, coalesce(c_acctbal >= 0, false) AS active
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') c ON o_custkey = c_custkey""")
def ref_lookup_active(t):
    reference = t.customer.filter("c_mktsegment <> 'MACHINERY'").withColumn(
        "state", F.when(F.col("c_acctbal") >= 0, "Yes").otherwise("no"))
    reference = reference.union(reference)  # a key that is loaded twice must not repeat orders
    return J.lookup(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", reference, "c_custkey",
                    F.col("state"), ["c_name"]).drop("o_custkey")


@query("refint_active_only", """
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value, 'not_found' AS reason
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 1000)""")
def refint_active_only(t):
    reference = t.customer.withColumn("state", F.when(F.col("c_acctbal") >= 1000, "active").otherwise("closed"))
    return J.broken_references(t.orders, "o_custkey", reference.filter(J.is_active(F.col("state"))),
                               "c_custkey", ["o_orderkey"])


@query("refint_cascade", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN o_orderkey IS NULL THEN 'l_orderkey' WHEN c_custkey IS NULL THEN 'o_custkey' WHEN n_nationkey IS NULL THEN 'c_nationkey' END AS broken_at
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice >= 20000) ON l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey""")
def refint_cascade(t):
    return J.cascade(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), [
        ("l_orderkey", t.orders.filter("o_totalprice >= 20000"), "o_orderkey", ["o_custkey"]),
        ("o_custkey", good_customers(t).union(good_customers(t)), "c_custkey", ["c_nationkey"]),
        ("c_nationkey", t.nation.filter("n_regionkey <> 3"), "n_nationkey", []),
    ])


@query("rule_default_keys", """
SELECT CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END, o_custkey) AS VARCHAR) AS row_key, 'big' AS rule_id, 'BL-006' AS failure_code, 'WARNING' AS severity, '' AS fields
FROM orders WHERE o_totalprice <= 50000""")
def rule_default_keys(t):
    """Rows go by the first identifier column that is not null where no keys are named."""
    rows = t.orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("order_id"),
                           F.col("o_custkey").alias("customer_id"), "o_totalprice")
    return R.check_rules(rows, [R.Rule("big", "domain", "o_totalprice > 50000")])
