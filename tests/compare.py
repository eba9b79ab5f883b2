"""Run catalog queries beside their SQL in DuckDB: python tests/compare.py [folder] [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) else round(v, 9))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def main(folder, chosen):
    import __spark_entry__ as entry
    from byline.session import local_session
    spark = local_session("compare", cores="8", shuffle_partitions=8)
    con = duck(folder)
    bad = []
    for name, fn in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            cols, rows = spark_rows(fn(spark, folder))
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"{name}: {len(rows)} rows, {took:.1f}s (no SQL)", flush=True)
                continue
            want_cols, want = sql_rows(con, sql)
            ok = cols == want_cols and rows == want
            print(f"{name}: {'ok' if ok else 'DIFFERENT'} {len(rows)}/{len(want)} rows, {took:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                a, b = set(rows), set(want)
                print("   spark", cols, sorted(a - b, key=repr)[:3])
                print("   sql  ", want_cols, sorted(b - a, key=repr)[:3], flush=True)
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"{name}: FAILED {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", set(sys.argv[2:]))
