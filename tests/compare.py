"""Run registered queries next to their SQL and compare the results as multisets of rows.

``python tests/compare.py [sf-folder] [query ...]``
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(row[i] for i in order) for row in cursor.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row[n] for n in names) for row in df.collect())


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree, else what is different."""
    names, got = spark_rows(df)
    sql_names, expected = sql_rows(con, sql)
    if names != sql_names:
        return f"columns {names} against {sql_names}"
    if got != expected:
        extra, missing = got - expected, expected - got
        return (
            f"{sum(got.values())} rows against {sum(expected.values())}; extra {sum(extra.values())} "
            f"{list(extra)[:3]}; missing {sum(missing.values())} {list(missing)[:3]}"
        )
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from driftlens.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con, sqls = local_session(), connect(folder), oracle_sql()
    chosen = sys.argv[2:] or list(queries())
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in sqls:
                result = difference(queries()[name](spark, folder), con, sqls[name]) or "same"
            else:
                result = f"{queries()[name](spark, folder).count()} rows, no SQL"
        except Exception as problem:  # noqa: BLE001
            result = f"FAILED {str(problem)[:1500]}"
        bad += result.startswith(("FAILED", "columns")) or " against " in result
        size = "" if result != "same" else con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchall()[0][0]
        print(f"{name:28s} {time.time() - start:6.1f}s {size} {result}", flush=True)
    print("differences:", bad)
