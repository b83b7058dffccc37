"""Compare queries with their SQL: python tests/oracle.py [sf_dir] [name...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 6))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if value is None else str(value)


def rows(columns, values) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(v[i]) for i in order) for v in values)


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if both have the same rows, else what differs."""
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want, got = rows(names, cursor.fetchall()), rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    if got == want:
        return ""
    return f"{sum(got.values())} rows, not {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, only = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name, f in queries.items():
        if only and name not in only or not only and name not in oracle:
            continue
        began = time.time()
        try:
            said = compare(f(session, sf), oracle[name], sf) if name in oracle else f"{f(session, sf).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
