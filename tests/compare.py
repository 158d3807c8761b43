"""Compare Spark queries with their SQL twins, value by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _rows(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    return sorted(df.columns), _rows(df.columns, df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return sorted(names), _rows(names, out.fetchall())


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from cellgauge.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), []
    oracles = oracle_sql()
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, sf_dir))
            took = time.time() - start
            if name in oracles:
                want = duck_rows(con, oracles[name])
                ok = got == want
            else:
                want, ok = None, len(got[1]) > 0
        except Exception as error:
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            bad.append(name)
            continue
        print(f"{'ok  ' if ok else 'DIFF'} {name} {len(got[1])} rows {took:.1f}s", flush=True)
        if not ok:
            bad.append(name)
            print("  columns", got[0], want and want[0])
            if want:
                a, b = set(got[1]), set(want[1])
                only_a, only_b = sorted(a - b)[:3], sorted(b - a)[:3]
                print("  spark", only_a, "\n  duck ", only_b, len(want[1]))
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
