"""Compare registered queries with DuckDB: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(df, relation) -> str:
    """Empty when columns, kinds of values and all rows agree."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = rows_of(relation.columns, relation.fetchall())
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    if len(got) != len(want):
        return f"{len(got)} vs {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        cut = [tuple(str(x)[:200] for x in side) for side in bad[0]]
        return f"{len(bad)} of {len(got)} rows differ, first {cut[0]} vs {cut[1]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    types = dict(zip(relation.columns, map(str, relation.types)))
    odd = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(t) != types[n]]
    return f"types {odd}" if odd else ""


def too_slow(*_):
    raise TimeoutError("over the time limit")


def main() -> int:
    import __spark_entry__ as entry
    from presslens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    signal.signal(signal.SIGALRM, too_slow)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "300")))
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, duck(sf_dir).sql(oracle[name]))
            else:
                problem = "" if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
