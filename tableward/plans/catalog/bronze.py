"""Layer 1: row and column quality."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.operators import bronze as B
from tableward.plans.inputs import DIRTY_EVENTS, LEVEL, case_bands, dirty_events, finding_sql
from tableward.plans.registry import query


def tidy(findings: DataFrame) -> DataFrame:
    return findings.withColumn("affected_pct", F.round("affected_pct", 6))


BLANK = "({0} IS NULL OR regexp_full_match({0}, '\\s*'))"
RANGE_SCORE = (
    f"CASE WHEN deviation > 1.0 THEN least(100.0::DOUBLE, {case_bands('pct', S.RANGE)} + 15) "
    f"ELSE {case_bands('pct', S.RANGE)} END"
)


@query("null_profile", f"""WITH {DIRTY_EVENTS}
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST(count(*) FILTER (WHERE {BLANK.format(c) if s else c + ' IS NULL'}) AS BIGINT) AS blank_count, "
    f"count(*) AS total_count FROM dirty"
    for c, s in [("event_id", 0), ("ts", 0), ("user_id", 0), ("event_type", 1), ("value", 0), ("props", 1)]))
def null_profile(t):
    df = dirty_events(t).drop("raw", "value_text")
    return B.profile(df, B.null_checks(df)).select(
        "field", F.col("affected_count").alias("blank_count"), "total_count")


@query("dq_count", f"""
SELECT 'count' AS check_name, 'DV-001' AS failure_code, '*' AS field,
  CASE WHEN failed THEN n ELSE 0 END AS affected_count, n AS total_count,
  CASE WHEN failed THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS affected_pct,
  CASE WHEN failed THEN score END AS severity_score,
  CASE WHEN failed THEN {LEVEL.format('score')} END AS severity, failed
FROM (SELECT n, n < 20000 OR n > 500000 AS failed,
    {case_bands("CASE WHEN n < 20000 THEN (20000 - n) / 20000.0 * 100 ELSE (n - 500000) / 500000.0 * 100 END", S.COUNT)} AS score
  FROM (SELECT count(*) AS n FROM events))""")
def dq_count(t):
    return B.count_finding(t.events, B.CountSpec(minimum=20_000, maximum=500_000))


@query("dq_null", f"""WITH {DIRTY_EVENTS}
{finding_sql('null_required', 'DV-002', 'value', 'count(*) FILTER (WHERE value IS NULL)', 'count(*)', 'dirty', case_bands('pct', S.NULL_REQUIRED))}
UNION ALL
{finding_sql('null_required', 'DV-002', 'user_id', 'count(*) FILTER (WHERE user_id IS NULL)', 'count(*)', 'dirty', case_bands('pct', S.NULL_REQUIRED))}
UNION ALL
{finding_sql('null_optional', 'DV-002', 'event_type', f"count(*) FILTER (WHERE {BLANK.format('event_type')})", 'count(*)', 'dirty', case_bands('pct', S.NULL_OPTIONAL), 1.0)}""")
def dq_null(t):
    df = dirty_events(t)
    return tidy(B.profile(df, B.null_checks(df, ["value", "user_id"], ["event_type"], tolerance=1.0)))


@query("dq_type", f"""WITH {DIRTY_EVENTS}
{finding_sql('type', 'DV-003', 'value_text', 'count(*) FILTER (WHERE value_text IS NOT NULL AND try_cast(value_text AS DOUBLE) IS NULL)', 'count(*)', 'dirty', case_bands('pct', S.TYPE))}
UNION ALL
{finding_sql('type', 'DV-003', 'value', 'count(*) FILTER (WHERE value IS NULL)', 'count(*)', 'dirty', case_bands('pct', S.TYPE))}
UNION ALL
{finding_sql('type', 'DV-003', 'user_id', '0', 'count(*)', 'dirty', case_bands('pct', S.TYPE))}
UNION ALL
{finding_sql('type', 'DV-003', 'event_type', "count(*) FILTER (WHERE event_type IS NOT NULL AND lower(event_type) NOT IN ('true','false','1','0','yes','no'))", 'count(*)', 'dirty', case_bands('pct', S.TYPE))}""")
def dq_type(t):
    df = dirty_events(t)
    return tidy(B.profile(df, B.type_checks(df, [
        B.TypeSpec("value_text", "float"), B.TypeSpec("value", "float", nullable=False),
        B.TypeSpec("user_id", "integer"), B.TypeSpec("event_type", "boolean"),
    ])))


@query("dq_range", f"""WITH {DIRTY_EVENTS},
spread AS (SELECT value, max(CASE WHEN value < 0 OR value > 100 THEN greatest(0 - value, value - 100, 0) / 100 END) OVER () AS deviation FROM dirty)
SELECT * REPLACE (CASE WHEN failed THEN CASE WHEN (SELECT max(deviation) FROM spread) > 1.0 THEN least(100, severity_score + 15) ELSE severity_score END END AS severity_score,
  CASE WHEN failed THEN CASE WHEN severity_score + CASE WHEN (SELECT max(deviation) FROM spread) > 1.0 THEN 15 ELSE 0 END >= 70 THEN 'CRITICAL' WHEN severity_score + CASE WHEN (SELECT max(deviation) FROM spread) > 1.0 THEN 15 ELSE 0 END >= 40 THEN 'WARNING' ELSE 'INFO' END END AS severity)
FROM ({finding_sql('range', 'DV-004', 'value', 'count(*) FILTER (WHERE value < 0 OR value > 100)', 'count(*)', 'dirty', case_bands('pct', S.RANGE))})
UNION ALL
{finding_sql('range', 'DV-004', 'user_id', 'count(*) FILTER (WHERE user_id >= 140)', 'count(*)', 'dirty', case_bands('pct', S.RANGE))}""")
def dq_range(t):
    df = dirty_events(t)
    return tidy(B.profile(df, B.range_checks([
        B.RangeSpec("value", 0, 100), B.RangeSpec("user_id", None, 140, inclusive_max=False)])))


@query("dq_date_range", finding_sql(
    'date_range', 'DV-004', 'l_shipdate',
    "count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01' OR l_shipdate > TIMESTAMP '2001-06-30')",
    'count(*)', 'lineitem', case_bands('pct', S.RANGE)))
def dq_date_range(t):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1998-01-01", "2001-06-30"))
    return tidy(B.profile(t.lineitem, B.date_range_checks([B.RangeSpec("l_shipdate", low, high)])))


@query("dq_format", f"""WITH broken AS (
  SELECT CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS url FROM pages)
{finding_sql('format', 'DV-005', 'url', "count(*) FILTER (WHERE NOT regexp_matches(url, '^https?://[^\\s]+$', 'i'))", 'count(*)', 'broken', case_bands('pct', S.FORMAT))}
UNION ALL
{finding_sql('format', 'DV-005', 'c_name', "count(*) FILTER (WHERE NOT regexp_matches(c_name, '^(?:customer#[0-9]*[02468]$)', 'i'))", 'count(*)', 'customer', case_bands('pct', S.FORMAT))}""")
def dq_format(t):
    pages = t.pages.select(
        F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?://", ""))
        .otherwise(F.col("url")).alias("url"))
    findings = [
        B.profile(pages, B.format_checks([B.FormatSpec("url", "url")])),
        B.profile(t.customer, B.format_checks([B.FormatSpec("c_name", "customer#[0-9]*[02468]$")])),
    ]
    return tidy(reduce(DataFrame.unionByName, findings))


def _duplicate_sql(keys: str, field: str, source: str) -> str:
    score = (f"least(100.0::DOUBLE, {case_bands('pct', S.DUPLICATE)} + "
             "CASE WHEN groups >= 50 THEN 10 WHEN groups >= 20 THEN 5 ELSE 0 END)")
    return f"""
SELECT 'duplicate' AS check_name, 'DV-006' AS failure_code, '{field}' AS field,
  n AS affected_count, total AS total_count, round(pct, 6) AS affected_pct,
  CASE WHEN failed THEN score END AS severity_score,
  CASE WHEN failed THEN {LEVEL.format('score')} END AS severity, failed, groups
FROM (SELECT *, pct > 0.5 AS failed, {score} AS score FROM (
  SELECT *, n * 100.0::DOUBLE / total AS pct FROM (
    SELECT CAST(sum(m) AS BIGINT) AS total, CAST(coalesce(sum(m) FILTER (WHERE m > 1), 0) AS BIGINT) AS n,
      count(*) FILTER (WHERE m > 1) AS groups
    FROM (SELECT count(*) AS m FROM {source} GROUP BY {keys}))))"""


@query("dq_duplicate", _duplicate_sql("l_orderkey, l_linenumber", "l_orderkey,l_linenumber", "lineitem")
       + " UNION ALL " + _duplicate_sql("text, lang, source, n_chars", "*", "documents"))
def dq_duplicate(t):
    keyed = B.duplicate_finding(t.lineitem, B.DuplicateSpec(("l_orderkey", "l_linenumber")))
    whole = B.duplicate_finding(t.documents.drop("doc_id"), B.DuplicateSpec())
    return tidy(keyed.unionByName(whole))


@query("dq_duplicate_ci", "WITH mixed AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_brand FROM part)"
       + _duplicate_sql("lower(p_name), lower(p_brand)", "p_name,p_brand", "mixed"))
def dq_duplicate_ci(t):
    mixed = t.part.select(
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"),
        "p_brand")
    return tidy(B.duplicate_finding(mixed, B.DuplicateSpec(("p_name", "p_brand"), case_sensitive=False)))


@query("dq_encoding", f"""WITH {DIRTY_EVENTS}
{finding_sql('encoding', 'DV-007', 'raw,event_type', "count(*) FILTER (WHERE bad_bytes OR contains(event_type, chr(65533)))", 'count(*)', 'dirty', case_bands('pct', S.ENCODING))}
UNION ALL
{finding_sql('encoding', 'DV-007', 'text', "count(*) FILTER (WHERE contains(text, chr(65533)))", 'count(*)', 'documents', case_bands('pct', S.ENCODING))}""")
def dq_encoding(t):
    events = dirty_events(t)
    return tidy(B.profile(events, B.encoding_check(events, ["raw", "event_type"])).unionByName(
        B.profile(t.documents, B.encoding_check(t.documents, ["text"]))))


OUTLIER_LEVEL = "CASE WHEN {0} >= 65 THEN 'WARNING' ELSE 'INFO' END"
OUTLIER_SCORE = (
    f"CASE WHEN n >= 100 THEN least(85.0::DOUBLE, {case_bands('pct', S.OUTLIER)} + 15) "
    f"WHEN n >= 50 THEN least(75.0::DOUBLE, {case_bands('pct', S.OUTLIER)} + 10) "
    f"ELSE {case_bands('pct', S.OUTLIER)} END"
)


def _outlier_sql(column: str, table: str) -> str:
    hit = (f"count(*) FILTER (WHERE abs(({column} - (SELECT avg({column}) FROM {table})) / "
           f"(SELECT stddev_pop({column}) FROM {table})) > 3.0)")
    return finding_sql('outlier', 'DV-004', column, hit, 'count(*)', table, OUTLIER_SCORE, 0.0, OUTLIER_LEVEL)


@query("dq_outlier", _outlier_sql("value", "events") + " UNION ALL " + _outlier_sql("user_id", "events"))
def dq_outlier(t):
    columns = ["value", "user_id"]
    return tidy(B.profile(t.events, B.outlier_checks(t.events, columns)))


@query("outlier_rows", """
SELECT event_id, value, round(abs((value - m) / s), 4) AS z_score
FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
WHERE abs((value - m) / s) > 3.0""")
def outlier_rows(t):
    z = B.z_score("value", B.outlier_moments(t.events, ["value"])["value"])
    return t.events.filter(z > 3.0).select("event_id", "value", F.round(z, 4).alias("z_score"))


@query("outlier_stats", " UNION ALL ".join(f"""
SELECT '{c}' AS field, round(avg({c}), 2) AS mean, round(stddev_pop({c}), 2) AS std,
  round(CAST(min({c}) AS DOUBLE), 2) AS low, round(CAST(max({c}) AS DOUBLE), 2) AS high, count({c}) AS n
FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def outlier_stats(t):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    wide = B.outlier_statistics(t.lineitem, columns)
    rows = [F.struct(F.lit(c).alias("field"),
                     *[F.round(F.col(c)[s], 2).alias(s) for s in ("mean", "std", "low", "high")],
                     F.col(c)["n"].alias("n")) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


@query("numeric_fields", f"""WITH {DIRTY_EVENTS}
SELECT field, n AS numeric_count, total AS total_count, n > total * 0.8 AS is_numeric FROM (
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE {e}) AS n, count(*) AS total FROM dirty" for c, e in [
        ("event_id", "event_id IS NOT NULL"), ("ts", "false"), ("user_id", "user_id IS NOT NULL"),
        ("event_type", "try_cast(event_type AS DOUBLE) IS NOT NULL"), ("value", "value IS NOT NULL"),
        ("value_text", "try_cast(value_text AS DOUBLE) IS NOT NULL"),
        ("props", "try_cast(props AS DOUBLE) IS NOT NULL")]) + ")")
def numeric_fields(t):
    return B.numeric_share(dirty_events(t).drop("raw"))


SPEC = B.BatchSpec(
    required=("value", "event_type"), types=(B.TypeSpec("value_text", "float"),),
    ranges=(B.RangeSpec("value", 0, 1000),), duplicates=B.DuplicateSpec(("user_id", "ts")),
    outliers=("value",),
)

# What SPEC finds critical in the dirty events, restated over the whole table.
SPLIT = f"""WITH {DIRTY_EVENTS},
shares AS (SELECT
    count(*) FILTER (WHERE value IS NULL) * 100.0 / count(*) >= 10 AS crit_value,
    count(*) FILTER (WHERE {BLANK.format('event_type')}) * 100.0 / count(*) >= 10 AS crit_event,
    count(*) FILTER (WHERE try_cast(value_text AS DOUBLE) IS NULL) * 100.0 / count(*) >= 5 AS crit_type,
    count(*) FILTER (WHERE value < 0 OR value > 1000) * 100.0 / count(*) >= 20 AS crit_range
  FROM dirty),
flagged AS (SELECT dirty.*,
    crit_value AND value IS NULL AS h1, crit_event AND {BLANK.format('event_type')} AS h2,
    crit_type AND try_cast(value_text AS DOUBLE) IS NULL AS h3,
    crit_range AND coalesce(value < 0 OR value > 1000, false) AS h4
  FROM dirty, shares)"""


@query("quarantine_split", SPLIT + """
SELECT CAST(event_id AS VARCHAR) AS row_key,
  concat_ws(',', CASE WHEN h1 OR h2 THEN 'DV-002' END, CASE WHEN h3 THEN 'DV-003' END, CASE WHEN h4 THEN 'DV-004' END) AS failure_codes,
  concat_ws('; ', CASE WHEN h1 THEN 'null_required:value' END, CASE WHEN h2 THEN 'null_required:event_type' END,
    CASE WHEN h3 THEN 'type:value_text' END, CASE WHEN h4 THEN 'range:value' END) AS reason
FROM flagged WHERE h1 OR h2 OR h3 OR h4""")
def quarantine_split(t):
    return B.quarantine(dirty_events(t), SPEC, ["event_id"]).select(
        "row_key", F.array_join("failure_codes", ",").alias("failure_codes"), "reason")


@query("clean_rows", SPLIT + " SELECT event_id, user_id, event_type, value FROM flagged WHERE NOT (h1 OR h2 OR h3 OR h4)")
def clean_rows(t):
    return B.clean(dirty_events(t), SPEC).select("event_id", "user_id", "event_type", "value")


@query("quarantine_stats", SPLIT + """,
q AS (SELECT 'day-' || strftime(ts, '%d') AS batch_id, h1 OR h2 AS c2, h3 AS c3, h4 AS c4 FROM flagged WHERE h1 OR h2 OR h3 OR h4),
counted AS (
  SELECT 'code' AS scope, 'DV-002' AS value, count(*) FILTER (WHERE c2) AS rows FROM q
  UNION ALL SELECT 'code', 'DV-003', count(*) FILTER (WHERE c3) FROM q
  UNION ALL SELECT 'code', 'DV-004', count(*) FILTER (WHERE c4) FROM q
  UNION ALL SELECT 'batch', batch_id, count(*) FROM q GROUP BY batch_id
  UNION ALL SELECT 'total', '*', count(*) FROM q)
SELECT scope, value, rows FROM counted WHERE rows > 0 OR scope = 'total'""")
def quarantine_stats(t):
    held = B.quarantine(dirty_events(t), SPEC, ["event_id"]).withColumn(
        "batch_id", F.concat(F.lit("day-"), F.date_format(F.col("record.ts"), "dd")))
    return B.quarantine_statistics(held)


@query("row_violations", f"""WITH {DIRTY_EVENTS}
SELECT CAST(event_id AS VARCHAR) AS row_key, 'null_required' AS check_name, 'DV-002' AS failure_code, 'value' AS field FROM dirty WHERE value IS NULL
UNION ALL SELECT CAST(event_id AS VARCHAR), 'null_required', 'DV-002', 'event_type' FROM dirty WHERE {BLANK.format('event_type')}
UNION ALL SELECT CAST(event_id AS VARCHAR), 'type', 'DV-003', 'value_text' FROM dirty WHERE try_cast(value_text AS DOUBLE) IS NULL
UNION ALL SELECT CAST(event_id AS VARCHAR), 'range', 'DV-004', 'value' FROM dirty WHERE value < 0 OR value > 1000""")
def row_violations(t):
    df = dirty_events(t)
    return B.violations(df, B.row_checks(df, SPEC), ["event_id"])


@query("validate_batch", f"""WITH {DIRTY_EVENTS}
{finding_sql('null_required', 'DV-002', 'value', 'count(*) FILTER (WHERE value IS NULL)', 'count(*)', 'dirty', case_bands('pct', S.NULL_REQUIRED))}
UNION ALL
{finding_sql('null_required', 'DV-002', 'event_type', f"count(*) FILTER (WHERE {BLANK.format('event_type')})", 'count(*)', 'dirty', case_bands('pct', S.NULL_REQUIRED))}
UNION ALL
{finding_sql('type', 'DV-003', 'value_text', 'count(*) FILTER (WHERE try_cast(value_text AS DOUBLE) IS NULL)', 'count(*)', 'dirty', case_bands('pct', S.TYPE))}
UNION ALL
{finding_sql('range', 'DV-004', 'value', 'count(*) FILTER (WHERE value < 0 OR value > 1000)', 'count(*)', 'dirty', case_bands('pct', S.RANGE))}
UNION ALL
{_outlier_sql('value', 'dirty')}
UNION ALL
SELECT * EXCLUDE (groups) FROM ({_duplicate_sql('user_id, ts', 'user_id,ts', 'dirty')})""")
def validate_batch(t):
    return tidy(B.validate_batch(dirty_events(t), SPEC))


# Every group judged on its own --------------------------------------------------------------------

GROUP_SPEC = replace(SPEC, count=B.CountSpec(minimum=400), duplicates=B.DuplicateSpec(("user_id",)))


def group_findings_sql(group: str) -> str:
    """What GROUP_SPEC finds in every group of the dirty events; ``group`` is SQL over their columns."""
    def found(name: str, code: str, field: str, hits: str, score: str, level: str = LEVEL) -> str:
        return f"""
SELECT g, '{name}' AS check_name, '{code}' AS failure_code, '{field}' AS field, CAST(n AS BIGINT) AS affected_count, CAST(total AS BIGINT) AS total_count,
  round(pct, 6) AS affected_pct, CASE WHEN failed THEN score END AS severity_score, CASE WHEN failed THEN {level.format('score')} END AS severity, failed
FROM (SELECT *, {score} AS score FROM (SELECT *, n * 100.0::DOUBLE / total AS pct, n > 0 AS failed FROM (
  SELECT g, {hits} AS n, count(*) AS total FROM placed GROUP BY g)))"""

    return f"""
WITH {DIRTY_EVENTS},
placed AS (SELECT *, count(*) OVER (PARTITION BY g, user_id) AS same, count(value) OVER (PARTITION BY g) AS known,
    abs(value - avg(value) OVER (PARTITION BY g)) / nullif(stddev_pop(value) OVER (PARTITION BY g), 0) AS z
  FROM (SELECT *, {group} AS g FROM dirty)),
""" + "repeated AS (SELECT g, same, count(*) AS rows, count(DISTINCT user_id) AS users FROM placed GROUP BY g, same)," + f"""
dup AS (SELECT g, CAST(coalesce(sum(rows) FILTER (WHERE same > 1), 0) AS BIGINT) AS n, coalesce(sum(users) FILTER (WHERE same > 1), 0) AS groups, CAST(sum(rows) AS BIGINT) AS total FROM repeated GROUP BY g)
""" + " UNION ALL ".join((
        found("null_required", "DV-002", "value", "count(*) FILTER (WHERE value IS NULL)", case_bands("pct", S.NULL_REQUIRED)),
        found("null_required", "DV-002", "event_type", f"count(*) FILTER (WHERE {BLANK.format('event_type')})", case_bands("pct", S.NULL_REQUIRED)),
        found("type", "DV-003", "value_text", "count(*) FILTER (WHERE try_cast(value_text AS DOUBLE) IS NULL)", case_bands("pct", S.TYPE)),
        found("range", "DV-004", "value", "count(*) FILTER (WHERE value < 0 OR value > 1000)", case_bands("pct", S.RANGE)),
        found("outlier", "DV-004", "value", "count(*) FILTER (WHERE known >= 30 AND z > 3.0)", OUTLIER_SCORE, OUTLIER_LEVEL),
        f"""
SELECT g, 'count', 'DV-001', '*', CASE WHEN failed THEN n ELSE 0 END, n, CASE WHEN failed THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN failed THEN score END,
  CASE WHEN failed THEN {LEVEL.format('score')} END, failed
FROM (SELECT g, n, n < 400 AS failed, {case_bands('(400 - n) / 400.0 * 100', S.COUNT)} AS score FROM (SELECT g, count(*) AS n FROM placed GROUP BY g))""",
        f"""
SELECT g, 'duplicate', 'DV-006', 'user_id', n, total, round(pct, 6), CASE WHEN failed THEN score END, CASE WHEN failed THEN {LEVEL.format('score')} END, failed
FROM (SELECT *, pct > 0.5 AND n > 0 AS failed, least(100.0::DOUBLE, {case_bands('pct', S.DUPLICATE)} + CASE WHEN groups >= 50 THEN 10 WHEN groups >= 20 THEN 5 ELSE 0 END) AS score
  FROM (SELECT *, n * 100.0::DOUBLE / total AS pct FROM dup))"""))


@query("validate_groups", group_findings_sql("CAST(ts AS DATE)"))
def validate_groups(t):
    """Every day of the events as a batch of its own, in one scan."""
    days = dirty_events(t).withColumn("g", F.col("ts").cast("date"))
    return tidy(B.validate_groups(days, GROUP_SPEC, ["g"]))


@query("quarantine_groups", f"""
WITH found AS ({group_findings_sql("CAST(ts AS DATE)")}),
critical AS (SELECT g, list(check_name || ':' || field) AS c FROM found WHERE severity = 'CRITICAL' AND check_name <> 'outlier' GROUP BY g), {DIRTY_EVENTS.strip()},
hits AS (SELECT CAST(ts AS DATE) AS g, event_id, list_contains(c, 'count:*') AS h0, list_contains(c, 'null_required:value') AND value IS NULL AS h1,
    list_contains(c, 'null_required:event_type') AND {BLANK.format('event_type')} AS h2, list_contains(c, 'type:value_text') AND try_cast(value_text AS DOUBLE) IS NULL AS h3,
    list_contains(c, 'range:value') AND coalesce(value < 0 OR value > 1000, false) AS h4,
    list_contains(c, 'duplicate:user_id') AND count(*) OVER (PARTITION BY CAST(ts AS DATE), user_id) > 1 AS h5
  FROM dirty JOIN critical ON CAST(ts AS DATE) = g)
SELECT g, CAST(event_id AS VARCHAR) AS row_key, concat_ws(',', CASE WHEN h0 THEN 'DV-001' END, CASE WHEN h1 OR h2 THEN 'DV-002' END, CASE WHEN h3 THEN 'DV-003' END,
  CASE WHEN h4 THEN 'DV-004' END, CASE WHEN h5 THEN 'DV-006' END) AS failure_codes FROM hits WHERE h0 OR h1 OR h2 OR h3 OR h4 OR h5""")
def quarantine_groups(t):
    days = dirty_events(t).withColumn("g", F.col("ts").cast("date"))
    return B.quarantine_groups(days, GROUP_SPEC, ["g"], ["event_id"]).select("g", "row_key", F.array_join("failure_codes", ",").alias("failure_codes"))


# Predicates of their own ----------------------------------------------------------------------

@query("rule_comparisons", """
SELECT l_returnflag,
  count(*) FILTER (WHERE l_quantity = 10) AS eq, count(*) FILTER (WHERE l_quantity <> 10) AS ne,
  count(*) FILTER (WHERE l_quantity > 10) AS gt, count(*) FILTER (WHERE l_quantity >= 10) AS ge,
  count(*) FILTER (WHERE l_quantity < 10) AS lt, count(*) FILTER (WHERE l_quantity <= 10) AS le,
  count(*) FILTER (WHERE l_linestatus IN ('F')) AS is_in, count(*) FILTER (WHERE l_linestatus NOT IN ('F')) AS not_in,
  count(*) FILTER (WHERE l_discount BETWEEN 0.02 AND 0.05) AS within, count(*) FILTER (WHERE regexp_matches(l_linestatus, '^[A-F]')) AS matches
FROM lineitem GROUP BY l_returnflag""")
def rule_comparisons(t):
    from tableward.operators.rules import comparison

    q, s = F.col("l_quantity"), F.col("l_linestatus")
    wanted = {
        "eq": comparison(q, "==", 10), "ne": comparison(q, "!=", 10), "gt": comparison(q, ">", 10),
        "ge": comparison(q, ">=", 10), "lt": comparison(q, "<", 10), "le": comparison(q, "<=", 10),
        "is_in": comparison(s, "in", ["F"]), "not_in": comparison(s, "not_in", ["F"]),
        "within": comparison(F.col("l_discount"), "between", (0.02, 0.05)),
        "matches": comparison(s, "matches", "^[A-F]"),
    }
    return t.lineitem.groupBy("l_returnflag").agg(*[F.count_if(c).alias(n) for n, c in wanted.items()])
