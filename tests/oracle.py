"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, connection, function, sql: str, sf_dir: str) -> str | None:
    """Null when the query and its SQL agree, else what differs."""
    df = function(spark, sf_dir)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours, theirs = _rows(df.columns, df.collect()), _rows(names, result.fetchall())
    if ours == theirs:
        return None
    only_ours = [r for r in ours if r not in set(theirs)][:3] if len(ours) < 50000 else []
    only_theirs = [r for r in theirs if r not in set(ours)][:3] if len(ours) < 50000 else []
    return f"{sorted(names)}: {len(ours)} rows != {len(theirs)} rows; ours {only_ours} theirs {only_theirs}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from stacksift.session import local_session

    spark = local_session(8)
    connection = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wrong = 0
    for name, function in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, connection, function, oracles[name], sf_dir)
            else:
                problem = f"rows only: {function(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        wrong += problem is not None and not problem.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    print("wrong:", wrong)
    return wrong


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
