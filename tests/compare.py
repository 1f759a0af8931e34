"""Runs catalogue queries next to their SQL twins: python tests/compare.py SF_DIR [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from skein.session import discard_cuts, local_session  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, con, sql) -> str | None:
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = list(set(got) - set(want))[:3]
        missing = list(set(want) - set(got))[:3]
        return f"rows {len(got)} != {len(want)}; extra {extra} missing {missing}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[:3]}" if bad else None


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    sqls = contract.oracle_sql()
    failed = 0
    for name, fn in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        if name not in sqls:
            print(f"rows {fn(spark, sf_dir).count():>7} {name} ({time.time() - start:.1f}s)", flush=True)
            continue
        try:
            problem = differences(fn(spark, sf_dir), con, sqls[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        discard_cuts(spark)
        print(f"{'FAIL' if problem else 'ok':>4} {name} ({time.time() - start:.1f}s) {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
