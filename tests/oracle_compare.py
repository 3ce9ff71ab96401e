"""Run queries on Spark and their SQL on DuckDB and compare the full contents."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
import duckdb  # noqa: E402


def connection(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b and (type(a) is type(b) or isinstance(a, int))


def compare(df, con, sql: str) -> str | None:
    """None if equal, otherwise what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows <> {len(want)}; {got[:3]} {want[:3]}"
    for g, w in zip(got, want):
        if not all(map(_same, g, w)):
            return f"{g} <> {w}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tallyfold.session import local_session

    folder, only = sys.argv[1], sys.argv[2:]
    spark = local_session(cores=8, **{"spark.sql.caseSensitive": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    for name, query in queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            outcome = compare(query(spark, folder), con, oracle_sql()[name]) or "equal"
        except Exception as e:  # show every query's outcome
            outcome = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:24s} {time.time() - started:6.1f}s  {outcome}", flush=True)
