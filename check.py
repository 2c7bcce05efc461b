"""Compare registered queries with their SQL on DuckDB: ``python check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import importlib
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if type(value).__name__ == "Decimal":
        return f"decimal:{value}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if (Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    frame = query(spark, sf_dir)
    names, left = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if left else "no rows"
    result = con.execute(sql)
    other, right = rows_of([d[0] for d in result.description], result.fetchall())
    if names != other:
        return f"columns {names} / {other}"
    if left != right:
        only_left, only_right = left - right, right - left
        return (f"{sum(left.values())} / {sum(right.values())} rows, differ {sum(only_left.values())}: "
                f"{list(only_left)[:2]} / {list(only_right)[:2]}")
    return None if left else "no rows"


def main(argv):
    from weekloom.session import local_session

    entry = importlib.import_module("__spark_entry__")
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
