"""Runs queries on Spark and their SQL on DuckDB over one data folder and compares the rows.

python tests/compare.py FOLDER [NAME...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from epochgrid.sources.tables import TABLES


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, int)):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x.item() if hasattr(x, "item") else str(x)


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def same(spark, con, folder: str, query, sql: str) -> str:
    """What is different, empty if nothing is."""
    ours = query(spark, folder).toArrow()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    if sorted(ours.column_names) != sorted(names):
        return f"columns {sorted(ours.column_names)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in order) for r in ours.to_pylist())
    b = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in theirs)
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only ours {list((a - b))[:3]}; only theirs {list((b - a))[:3]}"
    return "" if a else "empty"


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    from epochgrid.session import local_session

    spark, con, bad = local_session(), duck(folder), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or sorted(queries):
        began = time.time()
        try:
            if name in sql:
                said = same(spark, con, folder, queries[name], sql[name])
            else:
                said = f"no SQL; {queries[name](spark, folder).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        ok = said == "" or said.startswith("no SQL")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - began:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
