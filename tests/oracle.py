"""Runs queries against their SQL in DuckDB and compares rows.

    python tests/oracle.py SF_DIR [QUERY...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        return round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; only here {[x for x in got if x not in set(want)][:2]}, only there {[x for x in want if x not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ, sorted by {sorted(names)}: {str(bad[0])[:700]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from loomspan.session import get_session

    spark = get_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            why = compare(spark, con, queries[name], oracles[name], sys.argv[1])
        except Exception as e:
            why = f"error {str(e)[:900]}"
        print(f"{'ok  ' if not why else 'FAIL'} {name} {time.time() - began:.1f} s {why}", flush=True)
