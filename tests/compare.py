"""Run queries in Spark and in DuckDB on the same files and compare all rows.

As a script: python tests/compare.py [name part ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(folder: str = DATA):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(
        (tuple(repr(row[i]) for i in order) for row in rows))


def difference(spark, con, run, sql: str, folder: str = DATA) -> str | None:
    """None when the two agree on columns, rows and values."""
    df = run(spark, folder)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] == theirs[1]:
        return None if ours[1] else "no rows"
    only_ours = sorted(set(ours[1]) - set(theirs[1]))[:3]
    only_theirs = sorted(set(theirs[1]) - set(ours[1]))[:3]
    return f"rows {len(ours[1])} and {len(theirs[1])}; ours {only_ours}; theirs {only_theirs}"


if __name__ == "__main__":
    from plumbgrid.plans import QUERIES, SQL
    from plumbgrid.session import local_session

    session, database = local_session(8), duck()
    for query_name, run_query in QUERIES.items():
        if sys.argv[1:] and not any(part in query_name for part in sys.argv[1:]):
            continue
        start = time.time()
        try:
            if query_name in SQL:
                found = difference(session, database, run_query, SQL[query_name]) or "ok"
            else:
                found = f"{len(run_query(session, DATA).collect())} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{time.time() - start:6.1f}s {query_name}: {found}", flush=True)
