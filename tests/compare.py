"""Run queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


SPARK_SECONDS: dict[str, float] = {}


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return str(v) if hasattr(v, "isoformat") else v


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return _bag(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return _bag(names, cursor.fetchall())


def difference(spark, con, folder, name, queries, oracles) -> str | None:
    """None when both sides agree, else what differs."""
    began = time.time()
    names, rows = spark_rows(queries[name](spark, folder))
    SPARK_SECONDS[name] = time.time() - began
    if name not in oracles:
        return None if rows else "no rows"
    want_names, want = duck_rows(con, oracles[name])
    if names != want_names:
        return f"columns {names} != {want_names}"
    if rows != want:
        extra, missing = list((rows - want).items())[:3], list((want - rows).items())[:3]
        return f"{rows.total()} vs {want.total()} rows; only Spark {extra}; only SQL {missing}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from textloom.runtime import local_session

    folder = sys.argv[1]
    session, con = local_session(), duck(folder)
    q, o = queries(), oracle_sql()
    for name in sys.argv[2:] or q:
        began = time.time()
        try:
            problem = difference(session, con, folder, name, q, o)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        state = "FAIL" if problem else ("ok" if name in o else "rows")
        print(f"{state:5} {name:24} {SPARK_SECONDS.get(name, 0):6.1f}s of {time.time() - began:6.1f}s {problem or ''}", flush=True)
