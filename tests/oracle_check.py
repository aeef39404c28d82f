"""Compare registered queries with their SQL oracle, row for row.

Also a script: ``python tests/oracle_check.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else repr(float(int(v)))
    return repr(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql) -> tuple[bool, str]:
    got_cols, got = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want_cols, want = normalise([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {bad[:2]}"
    return True, f"{len(got)} rows"


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from tests.conftest import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(e.queries())
    spark = build_session()
    con = connect(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    failed = []
    for name in names:
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sqls:
                ok, note = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                ok, note = n > 0, f"{n} rows (no oracle)"
        except Exception as ex:  # report and go on with the next query
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
