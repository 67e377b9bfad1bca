"""Compare registered queries with their SQL in DuckDB: python tests/check.py [sf] [id-prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0) if v != 0 else "0.0"
    return str(v)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    srows = spark_df.collect()
    scols = sorted(spark_df.columns)
    cur = con.execute(sql)
    dcols_raw = [d[0] for d in cur.description]
    drows = cur.fetchall()
    dcols = sorted(dcols_raw)
    if scols != dcols:
        return f"columns {scols} != {dcols}"
    stypes = dict(spark_df.dtypes)
    want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for d in cur.description:
        w = want.get(stypes[d[0]], stypes[d[0]])
        if w != str(d[1]):
            return f"type of {d[0]}: spark {stypes[d[0]]} sql {d[1]}"
    if len(srows) != len(drows):
        return f"rows {len(srows)} != {len(drows)}"
    idx = {c: i for i, c in enumerate(dcols_raw)}
    a = sorted(tuple(canon(row[c]) for c in scols) for row in srows)
    b = sorted(tuple(canon(row[idx[c]]) for c in scols) for row in drows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ; cols {scols}; first {bad[0]}"
    return None


def main() -> int:
    from fairline.session import local_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("sf") else "sf0.001"
    prefixes = [a for a in args if not a.startswith("sf")]
    path = f"/root/testdata/{sf}"
    spark = local_session("check")
    con = duck(path)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for key in sorted(qs):
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = qs[key](spark, path)
            if key in sqls:
                diff = compare(df, con, sqls[key])
                n = "" if diff else f"{df.count()} rows" if prefixes else ""
            else:
                n, diff = f"{len(df.collect())} rows, no sql", None
        except Exception as exc:  # report and go on
            diff, n = f"{type(exc).__name__}: {str(exc)[:700]}", ""
        failed += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {key} {time.time() - t0:.1f}s {n} {diff or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
