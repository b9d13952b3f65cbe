"""Compare registered queries with their SQL on DuckDB.

Run directly to check a scale:  python tests/oracle.py sf0.01 [names...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = Path("/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA / sf / name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def mismatch(con, df, sql: str) -> str | None:
    got_names, got = counted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_names, want = counted(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows, want {sum(want.values())}; {sum(extra.values())} wrong such as "
            f"{list(extra)[:2]}, {sum(missing.values())} missing such as {list(missing)[:2]}"
        )
    return None if want else "no rows"


def main(sf: str, chosen: list[str]) -> int:
    from conftest import session

    import __spark_entry__ as e

    spark, con, bad = session(), connect(sf), 0
    oracles = e.oracle_sql()
    for name, query in e.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, str(DATA / sf))
            problem = mismatch(con, df, oracles[name]) if name in oracles else "no oracle"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "sf0.01", sys.argv[2:]))
