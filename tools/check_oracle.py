"""Run registered queries on Spark and their SQL on DuckDB and compare all values. Usage: check_oracle.py [sf] [prefix ...]"""

from __future__ import annotations

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from gleanery.session import build_session  # noqa: E402
from gleanery import workload  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) if not isinstance(r[i], float) else repr(round(r[i], 9)) for i in order) for r in rows), [columns[i] for i in order]


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    root = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    if prefixes and prefixes[0].startswith("mod:"):
        for m in prefixes[0][4:].split(","):
            importlib.import_module(f"gleanery.workload.{m}")
        queries, prefixes = workload.QUERIES, prefixes[1:]
    else:
        queries = workload.load_all()
    bad = 0
    for name, q in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = q.run(spark, root)
            got, cols = normal([tuple(r) for r in df.collect()], df.columns)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: spark {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(got)} rows {took:.2f}s", flush=True)
            continue
        try:
            rel = con.execute(q.sql)
            names = [x[0] for x in rel.description]
            want, wcols = normal(rel.fetchall(), names)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: duckdb {str(e)[:400]}", flush=True)
            continue
        if cols != wcols or got != want:
            bad += 1
            extra = [r for r in got if r not in set(want)][:3]
            missing = [r for r in want if r not in set(got)][:3]
            print(f"DIFF {name}: rows {len(got)} vs {len(want)} cols {cols} vs {wcols}\n   spark {extra}\n   duck  {missing}", flush=True)
        else:
            print(f"ok   {name}: {len(got)} rows {took:.2f}s", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    main()
