"""Run registered queries beside their SQL in DuckDB and compare whole results.

``python tests/oracle.py <folder> [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tableward.plans.registry import TABLES, Tables, load_all  # noqa: E402

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
    "float": "FLOAT",
}


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("NULL" if r[i] is None else _cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    spark_types = {n: TYPES.get(k, k) for n, k in df.dtypes}
    spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    described = con.execute(f"DESCRIBE {sql}").fetchall() if not sql.strip().upper().startswith("WITH RECURSIVE") else None
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_rows = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if described:
        duck_types = {d[0]: d[1] for d in described}
        wrong = {n: (spark_types[n], duck_types[n]) for n in names if spark_types[n] != duck_types[n]}
        if wrong:
            return False, f"types {wrong}"
    if len(spark_rows) != len(duck_rows):
        return False, f"rows {len(spark_rows)} vs {len(duck_rows)}; {spark_rows[:2]} vs {duck_rows[:2]}"
    diff = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if diff:
        return False, f"{len(diff)} rows differ, first {diff[0][0]} vs {diff[0][1]}"
    return True, f"{len(spark_rows)} rows"


def main(folder: str, names: list[str]) -> int:
    from tableward import build_session

    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    registry = load_all()
    picked = [n for n in registry if not names or any(n == x or n.startswith(x.rstrip("*")) and x.endswith("*") for x in names)]
    for name in picked:
        start = time.time()
        try:
            df = registry[name].build(Tables(spark, folder))
            if registry[name].sql:
                ok, note = compare(df, con, registry[name].sql)
            else:
                ok, note = True, f"{df.count()} rows (no SQL)"
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(picked) - len(failed)} of {len(picked)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
