"""python tests/run_oracle.py [folder] [name part ...]: run queries next to their SQL and print the differences."""
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from tests.oracle import compare, connect  # noqa: E402
from vitrine.plans import workload  # noqa: E402
from vitrine.session import local_session  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in workload.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in workload.ORACLES:
                problem, n = compare(df, con, workload.ORACLES[name])
            else:
                problem, n = None, len(df.collect())
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += problem is not None
        sql = "sql" if name in workload.ORACLES else "rows only"
        print(f"{'BAD ' if problem else 'ok  '} {name:26} {n:8} rows {time.time() - start:6.2f} s {sql}" + (f"\n     {problem}" if problem else ""), flush=True)
    print("bad", bad)


main()
