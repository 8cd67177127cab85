"""Run registered queries against DuckDB: python tests/check_queries.py SF [name …]"""

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, ".")
from __spark_entry__ import oracle_sql, queries
from flowspark.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def difference(ours: pd.DataFrame, theirs: pd.DataFrame):
    """None if equal as bags of rows, else what differs."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    names = sorted(ours.columns)

    def rows(df):
        clean = df[names].astype(object).where(df[names].notna(), None)
        plain = [
            tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)
            for r in clean.itertuples(index=False)
        ]
        return sorted(plain, key=repr)

    bad = [(a, b) for a, b in zip(rows(ours), rows(theirs)) if a != b]
    return f"{len(bad)} rows differ, first {names}: {bad[0]}" if bad else None


def main():
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    failed = []
    for name, build in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            ours = build(spark, sf_dir).toPandas()
            took = time.time() - began
            if name in oracles:
                problem = difference(ours, con.execute(oracles[name]).df())
            else:
                problem = None if len(ours) else "no rows"
            word = "ok" if name in oracles else "rows only"
        except Exception as e:
            took, problem = time.time() - began, f"{type(e).__name__}: {str(e)[:1500]}"
        if problem:
            failed.append(name)
        print(f"{name:30s} {took:6.1f}s {problem or word + f' ({len(ours)})'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
