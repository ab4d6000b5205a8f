"""Runs a registered query and its SQL over the same tables and compares their rows."""

import math
import os
import sys

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    found = con.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


def differences(name, spark, sf_dir):
    """Nothing if both agree, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = duck(entry.oracle_sql()[name], sf_dir)
    if mine == theirs:
        return ""
    only = [r for r in mine[1] if r not in set(theirs[1])][:3], [r for r in theirs[1] if r not in set(mine[1])][:3]
    return f"{name}: {mine[0]} {theirs[0]}; {len(mine[1])} and {len(theirs[1])} rows; {only}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[1:] or [q for q in entry.oracle_sql() if not q.startswith("op")]:
        start = time.time()
        try:
            said = differences(query, session, sf_dir) or "same"
        except Exception as e:  # noqa: BLE001  go on with the others
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(query, f"{time.time() - start:.1f}s", said, flush=True)
