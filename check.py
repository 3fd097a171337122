"""Run registered queries against DuckDB on the same files and report differences."""

from __future__ import annotations

import sys
import time

import duckdb

from fundlens.plans import catalog
from fundlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def canonical(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v: object) -> str:
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = catalog.plans[name](spark, folder)
    mine = canonical(df.columns, df.collect())
    if name not in catalog.sql:
        return True, f"{len(mine)} rows, no SQL"
    result = con.execute(catalog.sql[name])
    names = [c[0] for c in result.description]
    theirs = canonical(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if mine == theirs:
        kinds = [t for _, t in sorted(df.dtypes)]
        duck = [str(t) for _, t in sorted((c[0], c[1]) for c in result.description)]
        return True, f"{len(mine)} rows  {' '.join(f'{a}/{b}' for a, b in zip(kinds, duck))}"
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    return False, f"{len(mine)} vs {len(theirs)} rows\n   {sorted(names)}\n   spark  {only_mine}\n   duckdb {only_theirs}"


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(catalog.plans)
    spark = build_session("fundlens-check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in wanted:
        began = time.time()
        try:
            ok, text = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001 - the report goes on
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.2f}s {text}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
