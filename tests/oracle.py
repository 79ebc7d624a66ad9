"""Compare registered queries with their SQL oracles: python tests/oracle.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=4; SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((_plain(k), _plain(y)) for k, y in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "float": "FLOAT",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def compare(spark, con, name, fn, sql, sf_dir):
    """Error text, or None when rows, columns and types agree."""
    df = fn(spark, sf_dir)
    got_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    want = normal(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"row {str(a)[:700]} != {str(b)[:700]}"
    wrong = {c: (got_types[c], want_types[c]) for c in got_types if got_types[c] != want_types[c]}
    return f"types {wrong}" if wrong else None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    import __spark_entry__ as entry
    from opinio.session import get_session

    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in oracles:
                error = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                rows = fn(spark, sf_dir).count()
                error = None if rows > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {str(e)[:900]}"
        mark = "ok  " if error is None else "FAIL"
        bad += error is not None
        if error or time.time() - t > 5 or names:
            print(f"{mark} {time.time() - t:6.2f}s {name} {'' if name in oracles else '(rows only) '}{error or ''}", flush=True)
    print(f"{bad} failures of {len(queries)} queries, {len(oracles)} with oracle")
    return bad


if __name__ == "__main__":
    raise SystemExit(min(1, main()))
