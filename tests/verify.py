"""python -m tests.verify [SF] NAME...: runs queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings photos faces persons photo_removals search_feedback eval_items mix_targets".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.6f}".replace("-0.000000", "0.000000")
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, cell(v)) for k, v in sorted(x.items()))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return str(x) if not isinstance(x, bool) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def duck(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def compare(spark, folder: str, query, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL, {took:.1f} s"
    c = duck(folder)
    want_rows = c.execute(sql).fetchall()
    want = rows_of([x[0] for x in c.description], want_rows)
    if got == want:
        return True, f"{len(got[1])} rows equal, {took:.1f} s"
    a, b = set(got[1]), set(want[1])
    return False, f"columns {got[0]} / {want[0]}, rows {len(got[1])} / {len(want[1])}, only here {list(a - b)[:3]}, only in SQL {list(b - a)[:3]}, {took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from shoebox.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith(("sf", "check")) else "sf0.01"
    spark = local_session()
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args or list(queries):
        try:
            ok, said = compare(spark, f"/root/testdata/{sf}", queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            ok, said = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, said, flush=True)
