"""Compare registered queries with their SQL statements on one data folder.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        out.append(tuple(
            None if row[i] is None
            else round(float(row[i]), 9) if isinstance(row[i], float)
            else str(row[i]) for i in order))
    return sorted(out, key=lambda r: tuple("" if v is None else str(v) for v in r))


def compare(spark, con, sf, name, queries, oracles):
    started = time.time()
    df = queries[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    mine = canonical(rows, df.columns)
    if name not in oracles:
        return True, len(mine), spent, "rows only"
    cursor = con.execute(oracles[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return False, len(mine), spent, f"columns {sorted(df.columns)} vs {sorted(names)}"
    theirs = canonical(cursor.fetchall(), names)
    if mine == theirs:
        return True, len(mine), spent, ""
    a, b = set(mine), set(theirs)
    return False, len(mine), spent, (
        f"{len(mine)} vs {len(theirs)} rows; only here {sorted(a - b, key=str)[:3]}; "
        f"only there {sorted(b - a, key=str)[:3]}; cols {sorted(df.columns)}")


def main(argv):
    import __spark_entry__ as entry
    from fundflow.session import build_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = argv[1:] or list(queries)
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="warehouse-"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoint-")})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in chosen:
        try:
            ok, n, spent, note = compare(spark, con, sf, name, queries, oracles)
        except Exception as exc:  # report and go on
            ok, n, spent, note = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {n:8d} {spent:7.2f}s {note}",
              flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
