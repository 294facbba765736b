"""Run named queries against their SQL: python tests/run_oracle.py [sf dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
import oracle  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, sqls = spark_entry.queries(), spark_entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                problem = oracle.difference(df, con, sqls[name])
                rows = len(con.execute(sqls[name]).fetchall())
            else:
                problem, rows = None, df.count()
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} rows={rows} {time.time() - began:.2f}s"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
