"""Layer 2: schema contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.operators import contracts as C
from tableward.operators import references as J
from tableward.plans.inputs import CONTRACT_REGISTRY, contract_registry
from tableward.plans.registry import query

ORDERS = C.Contract("orders", "1.2.0", "orders", (
    C.ContractColumn("o_orderkey", "integer", required=True, nullable=False, unique=True),
    C.ContractColumn("o_orderstatus", "string", required=True, enum=("O", "F")),
    C.ContractColumn("o_totalprice", "number", minimum=5000, maximum=450000, precision=8, scale=1),
    C.ContractColumn("o_orderdate", "datetime", required=True),
    C.ContractColumn("o_orderpriority", "string", pattern="^[1-3]-", max_length=10),
    C.ContractColumn("amount_text", "number", required=True),
    C.ContractColumn("priority_code", "integer"),
    C.ContractColumn("o_clerk", "string", required=True),
))


def orders_under_contract(t):
    return t.orders.withColumn(
        "amount_text", F.when(F.col("o_orderkey") % 31 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    ).withColumn("priority_code", F.substring("o_orderpriority", 1, 2))


CONTRACT_FINDINGS = r"""
contract_findings AS (
  SELECT * FROM (
    SELECT 'SC-001' AS failure_code, 'o_clerk' AS column_name, 'CRITICAL' AS severity, true AS blocking, count(*) AS affected_count FROM orders
    UNION ALL SELECT 'SC-002', 'o_custkey', 'INFO', false, count(*) FROM orders
    UNION ALL SELECT 'SC-003', 'amount_text', 'CRITICAL', true, count(*) FILTER (WHERE o_orderkey % 31 = 0) FROM orders
    UNION ALL SELECT 'SC-003', 'priority_code', 'WARNING', false, count(*) FILTER (WHERE NOT regexp_full_match(substr(o_orderpriority, 1, 2), '[+-]?[0-9]+')) FROM orders
    UNION ALL SELECT 'SC-005', 'o_orderstatus', 'CRITICAL', true, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders
    UNION ALL SELECT 'SC-005', 'o_totalprice', 'WARNING', false, count(*) FILTER (WHERE o_totalprice < 5000 OR o_totalprice > 450000) FROM orders
    UNION ALL SELECT 'SC-004', 'o_totalprice', 'WARNING', false, count(*) FILTER (WHERE length(replace(CAST(o_totalprice AS VARCHAR), '.', '')) > 8 OR length(split_part(CAST(o_totalprice AS VARCHAR), '.', 2)) > 1) FROM orders
    UNION ALL SELECT 'SC-005', 'o_orderpriority', 'WARNING', false, count(*) FILTER (WHERE length(o_orderpriority) > 10 OR NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders)
  WHERE affected_count > 0)"""


@query("contract_validate", f"WITH {CONTRACT_FINDINGS} SELECT * FROM contract_findings")
def contract_validate(t):
    return C.validate_contract(orders_under_contract(t), ORDERS)


@query("score_schema", f"""WITH {CONTRACT_FINDINGS}
SELECT bool_or(blocking) AS blocked, greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 10 ELSE 2 END)) AS score
FROM contract_findings""")
def score_schema(t):
    found = C.validate_contract(orders_under_contract(t), ORDERS)
    return found.agg(F.bool_or("blocking").alias("blocked"), S.layer_score(F.col("severity"), "schema").alias("score"))


@query("contract_validate_map", """
SELECT failure_code, column_name, severity, blocking, affected_count FROM (
  SELECT 'SC-001' AS failure_code, 'k' AS column_name, 'CRITICAL' AS severity, true AS blocking, count(*) FILTER (WHERE event_id % 5 = 0) AS affected_count FROM events
  UNION ALL SELECT 'SC-002', 'key', 'INFO', false, count(*) FILTER (WHERE event_id % 5 = 0) FROM events
  UNION ALL SELECT 'SC-001', 'kind', 'CRITICAL', true, count(*) FROM events) WHERE affected_count > 0""")
def contract_validate_map(t):
    text = F.when(F.col("event_id") % 5 == 0, F.replace("props", F.lit('"k"'), F.lit('"key"'))).otherwise(F.col("props"))
    rows = t.events.select(F.from_json(text, "map<string,string>").alias("record"))
    return C.validate_open(rows, "record", C.Contract("props", "1.0.0", "events", (
        C.ContractColumn("k", "integer", required=True), C.ContractColumn("kind", required=True))))


@query("contract_precision", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
WHERE length(replace(CAST(l_extendedprice AS VARCHAR), '.', '')) > 6 OR length(split_part(CAST(l_extendedprice AS VARCHAR), '.', 2)) > 1""")
def contract_precision(t):
    return t.lineitem.filter(C.loses_precision(F.col("l_extendedprice"), 6, 1)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("contract_unique", """
SELECT 'SC-005' AS failure_code, 'l_orderkey,l_linenumber' AS column_name, count(*) AS groups, CAST(sum(m) AS BIGINT) AS affected_count
FROM (SELECT count(*) AS m FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE m > 1
UNION ALL
SELECT 'SC-005', 'l_partkey', count(*), CAST(coalesce(sum(m), 0) AS BIGINT) FROM (SELECT count(*) AS m FROM lineitem GROUP BY l_partkey) WHERE m > 1""")
def contract_unique(t):
    return C.unique_findings(t.lineitem, [["l_orderkey", "l_linenumber"], ["l_partkey"]])


@query("contract_fk", """
SELECT 'fk-l_partkey' AS rule_id, 'SC-005' AS failure_code, 'l_partkey' AS field, 'CRITICAL' AS severity, count(*) AS violations, CAST(0 AS BIGINT) AS null_keys,
  least(100.0::DOUBLE, 40.0::DOUBLE + count(*) * 10) AS severity_score
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def contract_fk(t):
    broken = J.broken_references(t.lineitem, "l_partkey", t.part.filter("p_size > 5"), "p_partkey",
                                 ["l_orderkey", "l_linenumber"], allow_null=True)
    return J.reference_summary(broken, "fk-l_partkey", "SC-005")


JSON_COLUMN = """'{"column_type":"' || column_type || '","constraints":{' ||
  concat_ws(',', '"enum_values":["' || array_to_string(enum_values, '","') || '"]', '"max_length":' || max_length, '"maximum":' || maximum,
    '"min_length":' || min_length, '"minimum":' || minimum, '"nullable":' || nullable, '"pattern":"' || pattern || '"', '"unique":' || is_unique) ||
  '},"criticality":"' || criticality || '","name":"' || column_name || '"}'"""
HASHES = f"""
SELECT contract_id, version, sha256('{{"additional_properties":' || additional_properties || ',"columns":[' ||
    string_agg({JSON_COLUMN}, ',' ORDER BY column_name) || '],"id":"' || contract_id || '","source":"' || source || '","version":"' || version || '"}}') AS contract_hash
FROM @from GROUP BY contract_id, version, source, additional_properties"""
# The whole registry; versions of open and closed lines are told apart.
LIVE = "live AS (SELECT * REPLACE (version || '-' || l_linestatus AS version) FROM registry)"


def live(t):
    return contract_registry(t).withColumn("version", F.concat_ws("-", "version", "l_linestatus"))


@query("contract_hash", f"WITH {CONTRACT_REGISTRY}, {LIVE} {HASHES.replace('@from', 'live')}")
def contract_hash(t):
    return C.contract_hashes(live(t))


JSON_PROPERTY = """'"' || column_name || '":{' || concat_ws(',', '"enum":["' || array_to_string(enum_values, '","') || '"]', '"maxLength":' || max_length, '"maximum":' || maximum,
    '"minLength":' || min_length, '"minimum":' || minimum, '"pattern":"' || pattern || '"', '"type":"' || column_type || '"') || '}'"""


@query("contract_schema_hash", f"""WITH {CONTRACT_REGISTRY}, {LIVE}
SELECT contract_id, version, sha256('{{"additionalProperties":' || additional_properties || ',"properties":{{' || string_agg({JSON_PROPERTY}, ',' ORDER BY column_name) ||
  '}},"required":[' || coalesce(string_agg('"' || column_name || '"', ',' ORDER BY column_name) FILTER (WHERE criticality = 'required' AND NOT nullable), '') || '],"type":"object"}}') AS schema_hash
FROM live GROUP BY contract_id, version, additional_properties""")
def contract_schema_hash(t):
    return C.schema_hashes(live(t))


@query("contract_verify", f"""WITH {CONTRACT_REGISTRY}, {LIVE},
kept AS (SELECT * REPLACE (CASE WHEN source IN ('source-3', 'source-7') THEN max_length + 1 ELSE max_length END AS max_length) FROM live WHERE source <> 'source-9'),
submitted AS ({HASHES.replace('@from', 'live')}), registered AS ({HASHES.replace('@from', 'kept')})
SELECT contract_id, version, 'SC-008' AS failure_code, 'CRITICAL' AS severity, true AS blocking,
  CASE WHEN r.contract_hash IS NULL THEN 'Contract not registered' ELSE 'Contract hash mismatch' END AS issue
FROM submitted s LEFT JOIN registered r USING (contract_id, version) WHERE r.contract_hash IS NULL OR r.contract_hash <> s.contract_hash""")
def contract_verify(t):
    submitted = live(t)
    changed = F.when(F.col("source").isin("source-3", "source-7"), F.col("max_length") + 1).otherwise(F.col("max_length"))
    kept = submitted.filter("source <> 'source-9'").withColumn("max_length", changed)
    return C.verify_hashes(C.contract_hashes(submitted), C.contract_hashes(kept))


PARTS = "list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER))"


@query("contract_latest", f"""WITH {CONTRACT_REGISTRY},
v AS (SELECT DISTINCT contract_id, version FROM registry)
SELECT contract_id, arg_max(version, {PARTS}) AS latest_version, count(*) AS versions FROM v GROUP BY contract_id""")
def contract_latest(t):
    return C.latest_versions(contract_registry(t))


@query("contract_for_source", f"""WITH {CONTRACT_REGISTRY},
v AS (SELECT DISTINCT source, contract_id, version FROM registry)
SELECT source, contract_id, version FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY {PARTS} DESC, contract_id DESC) = 1""")
def contract_for_source(t):
    return C.contracts_for_source(contract_registry(t))


PAIRS = f"""WITH {CONTRACT_REGISTRY},
pairs AS (SELECT contract_id, max(version) FILTER (WHERE l_linestatus = 'O') AS current_version, max(version) FILTER (WHERE l_linestatus = 'F') AS expected_version
  FROM registry GROUP BY contract_id HAVING current_version IS NOT NULL AND expected_version IS NOT NULL),
parts AS (SELECT *, list_transform(string_split(current_version, '.'), lambda x: CAST(x AS INTEGER)) AS a,
  list_transform(string_split(expected_version, '.'), lambda x: CAST(x AS INTEGER)) AS b FROM pairs)"""


def version_pairs(t):
    version = lambda s: F.max(F.when(F.col("l_linestatus") == s, F.col("version")))
    return contract_registry(t).groupBy("contract_id").agg(
        version("O").alias("current_version"), version("F").alias("expected_version"),
    ).filter("current_version IS NOT NULL AND expected_version IS NOT NULL")


@query("contract_version_check", PAIRS + """
SELECT contract_id, current_version, expected_version, 'SC-006' AS failure_code, a[1] <> b[1] AS is_major,
  CASE WHEN a[1] <> b[1] THEN 'WARNING' ELSE 'INFO' END AS severity, a[1] = b[1] AS is_compatible
FROM parts WHERE a <> b""")
def contract_version_check(t):
    checked = C.compare_versions(version_pairs(t), "current_version", "expected_version")
    return checked.filter("direction <> 0").select(
        "contract_id", "current_version", "expected_version", F.lit("SC-006").alias("failure_code"),
        "is_major", "severity", "is_compatible")


@query("contract_downgrade", PAIRS + " SELECT contract_id, expected_version AS submitted_version, current_version AS latest_version FROM parts WHERE b < a")
def contract_downgrade(t):
    # The older of the two versions is submitted again after the newer one.
    pairs = version_pairs(t).withColumnsRenamed(
        {"expected_version": "submitted_version", "current_version": "latest_version"})
    checked = C.compare_versions(pairs, "submitted_version", "latest_version")
    return checked.filter("is_downgrade").select("contract_id", "submitted_version", "latest_version")


def two_versions(t):
    registry = contract_registry(t)
    return registry.filter("l_linestatus = 'F'"), registry.filter("l_linestatus = 'O'")


ALIGNED = f"""WITH {CONTRACT_REGISTRY},
f AS (SELECT * FROM registry WHERE l_linestatus = 'F' AND contract_id IN (SELECT contract_id FROM registry WHERE l_linestatus = 'O')),
n AS (SELECT * FROM registry WHERE l_linestatus = 'O' AND contract_id IN (SELECT contract_id FROM registry WHERE l_linestatus = 'F')),
j AS (SELECT coalesce(f.contract_id, n.contract_id) AS contract_id, coalesce(f.column_name, n.column_name) AS column_name, f, n,
  f.contract_id IS NOT NULL AND n.contract_id IS NOT NULL AS two FROM f FULL OUTER JOIN n ON f.contract_id = n.contract_id AND f.column_name = n.column_name)"""


@query("contract_diff", ALIGNED + """
SELECT contract_id, column_name, CASE WHEN f.contract_id IS NULL THEN 'added' WHEN n.contract_id IS NULL THEN 'removed'
  WHEN f.column_type = n.column_type AND f.criticality = n.criticality AND f.additional_properties = n.additional_properties AND f.enum_values IS NOT DISTINCT FROM n.enum_values
   AND f.max_length = n.max_length AND f.maximum = n.maximum AND f.min_length IS NOT DISTINCT FROM n.min_length AND f.minimum IS NOT DISTINCT FROM n.minimum
   AND f.nullable = n.nullable AND f.pattern IS NOT DISTINCT FROM n.pattern THEN 'unchanged' ELSE 'changed' END AS status FROM j""")
def contract_diff(t):
    return C.contract_diff(*two_versions(t))


@query("contract_breaking", ALIGNED + """
SELECT contract_id, column_name, 'removed_required_column' AS change_type, 'required column removed' AS description FROM j WHERE n.contract_id IS NULL AND f.criticality = 'required'
UNION ALL SELECT contract_id, column_name, 'breaking_type_change', 'type changed from ' || f.column_type || ' to ' || n.column_type FROM j WHERE two AND f.column_type <> n.column_type AND NOT (f.column_type = 'integer' AND n.column_type = 'number')
UNION ALL SELECT contract_id, column_name, 'constraint_narrowed', 'maxLength narrowed from ' || f.max_length || ' to ' || n.max_length FROM j WHERE two AND n.max_length < f.max_length
UNION ALL SELECT contract_id, column_name, 'constraint_narrowed', 'minLength increased to ' || n.min_length FROM j WHERE two AND n.min_length IS NOT NULL AND (f.min_length IS NULL OR n.min_length > f.min_length)
UNION ALL SELECT contract_id, column_name, 'constraint_narrowed', 'maximum narrowed from ' || f.maximum || ' to ' || n.maximum FROM j WHERE two AND n.maximum < f.maximum
UNION ALL SELECT contract_id, column_name, 'constraint_narrowed', 'minimum increased to ' || n.minimum FROM j WHERE two AND n.minimum IS NOT NULL AND (f.minimum IS NULL OR n.minimum > f.minimum)
UNION ALL SELECT contract_id, column_name, 'constraint_narrowed', CASE WHEN f.pattern IS NULL THEN 'pattern constraint added' ELSE 'pattern constraint changed' END FROM j WHERE two AND n.pattern IS NOT NULL AND f.pattern IS DISTINCT FROM n.pattern
UNION ALL SELECT contract_id, column_name, 'constraint_narrowed', 'enum values removed: y' FROM j WHERE two AND len(f.enum_values) = 2 AND len(n.enum_values) = 1
UNION ALL SELECT contract_id, column_name, 'constraint_narrowed', 'nullable changed from true to false' FROM j WHERE two AND f.nullable AND NOT n.nullable
UNION ALL SELECT contract_id, column_name, 'made_required', 'changed from optional to required' FROM j WHERE two AND f.criticality = 'optional' AND n.criticality = 'required'
UNION ALL SELECT contract_id, '__schema__', 'additional_properties_disabled', 'additionalProperties changed from true to false'
  FROM (SELECT contract_id, bool_or(additional_properties) AS was FROM f GROUP BY 1) JOIN (SELECT contract_id, bool_or(additional_properties) AS now FROM n GROUP BY 1) USING (contract_id) WHERE was AND NOT now""")
def contract_breaking(t):
    return C.breaking_changes(*two_versions(t))


@query("contract_nonbreaking", ALIGNED + """
SELECT contract_id, column_name, 'added_optional_column' AS change_type, 'optional column added' AS description FROM j WHERE f.contract_id IS NULL AND n.criticality = 'optional'
UNION ALL SELECT contract_id, column_name, 'made_optional', 'changed from required to optional' FROM j WHERE two AND f.criticality = 'required' AND n.criticality = 'optional'
UNION ALL SELECT contract_id, column_name, 'constraint_widened', 'maxLength widened from ' || f.max_length || ' to ' || n.max_length FROM j WHERE two AND n.max_length > f.max_length
UNION ALL SELECT contract_id, column_name, 'constraint_widened', 'minLength constraint relaxed' FROM j WHERE two AND f.min_length IS NOT NULL AND (n.min_length IS NULL OR n.min_length < f.min_length)
UNION ALL SELECT contract_id, column_name, 'constraint_widened', 'maximum widened from ' || f.maximum || ' to ' || n.maximum FROM j WHERE two AND n.maximum > f.maximum
UNION ALL SELECT contract_id, column_name, 'constraint_widened', 'nullable changed from false to true' FROM j WHERE two AND NOT f.nullable AND n.nullable""")
def contract_nonbreaking(t):
    return C.nonbreaking_changes(*two_versions(t))
