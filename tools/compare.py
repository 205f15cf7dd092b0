"""Run registered queries beside their SQL and compare rows, types and values.

Usage: python tools/compare.py [name-prefix ...] [--sf 0.01]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from placewise import checks  # noqa: E402
from placewise.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NUMERIC = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    checks.load_all()
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = []
    for name, query in checks.QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            columns = sorted(df.columns)
            got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
            took = time.time() - start
            if name not in checks.SQL:
                print(f"ROWS {name} rows={len(got)} {took:.1f}s", flush=True)
                continue
            rel = con.sql(checks.SQL[name])
            if sorted(rel.columns) != columns:
                raise AssertionError(f"columns {columns} vs {sorted(rel.columns)}")
            types = dict(zip(rel.columns, [str(x) for x in rel.types]))
            want = [tuple(plain(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()]
            kinds = {c: k for c, k in df.dtypes}
            off = [(c, kinds[c], types[c]) for c in columns if NUMERIC.get(kinds[c], kinds[c]) != types[c]]
            got.sort(key=key)
            want.sort(key=key)
            diff = [(g, w) for g, w in zip(got, want) if g != w]
            ok = len(got) == len(want) and not diff and not off and got
            print(f"{'ok  ' if ok else 'BAD '} {name} rows={len(got)}/{len(want)} {took:.1f}s {'types ' + str(off) if off else ''}", flush=True)
            if not ok:
                bad.append(name)
                for g, w in diff[:3]:
                    print("   spark", g, "\n   sql  ", w)
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name}: {str(error)[:700]}", flush=True)
            if not args.names or len(args.names) > 3:
                continue
            traceback.print_exc(limit=3)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
