"""Run registered queries against their checking SQL: ``python tests/oracle_check.py [prefix ...]``.

Set ORACLE_SF to another data folder.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v))
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"rows {len(got)}", took
    cur = con.execute(sql)
    exp_cols, exp = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != exp_cols:
        return False, f"columns {got_cols} != {exp_cols}", took
    if len(got) != len(exp):
        return False, f"rows {len(got)} != {len(exp)}", took
    types = [(f.name, f.dataType.simpleString()) for f in df.schema]
    for a, b in zip(got, exp):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return False, f"{dict(zip(got_cols, a))} != {b} {types}", took
    return True, f"rows {len(got)}", took


def main():
    import duckdb

    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as named_queries
    from ostinato.session import build_session

    folder = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                         "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    import logging
    logging.disable(logging.CRITICAL)
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet')")
    queries, oracles = named_queries(), oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:300]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {took:6.2f}s {'' if name in oracles else '(no sql) '}{note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
