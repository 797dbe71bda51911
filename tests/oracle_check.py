"""Run every registered query next to its SQL in an in-process DuckDB and compare values.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    values = [tuple(None if v is None or v is pd.NA or v != v else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(values, key=lambda r: tuple((v is not None, str(type(v)) if v is None else "", v) if v is not None else (False, "", 0) for v in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    left, right = rows(got), rows(want)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else "ok"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            got = df.toPandas()
            spent = time.time() - start
            if name not in sql:
                print(f"{name:22} rows only, {len(got)} rows, spark {spent:.2f}s")
                continue
            start = time.time()
            result = con.execute(sql[name])
            kinds = {d[0]: str(d[1]) for d in result.description}
            verdict = compare(got, result.df())
            print(f"{name:22} {verdict}, {len(got)} rows, spark {spent:.2f}s, sql {time.time() - start:.2f}s | "
                  + ", ".join(f"{c}:{t}/{kinds.get(c)}" for c, t in df.dtypes))
            failed += verdict != "ok"
        except Exception as error:
            failed += 1
            print(f"{name:22} FAILED {type(error).__name__}: {str(error)[:600]}")
        sys.stdout.flush()
    print("failed:", failed)


if __name__ == "__main__":
    main()
