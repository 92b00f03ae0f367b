"""python -m tests.check_all [sf] [name-substring ...]: every query against its SQL, with times."""

import sys

from chromaloom.session import get_session
from __spark_entry__ import oracle_sql, queries
from tests.oracle import compare, connect


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(d), oracle_sql(), []
    for name, fn in queries().items():
        if picks and not any(p in name for p in picks):
            continue
        try:
            if name in sql:
                problem, n, ts, td = compare(spark, con, d, fn, sql[name])
            else:
                import time
                t0 = time.time()
                n = len(fn(spark, d).collect())
                problem, ts, td = None, time.time() - t0, float("nan")
        except Exception as e:  # noqa: BLE001
            problem, n, ts, td = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0, 0.0
        print(f"{'ok  ' if not problem else 'FAIL'} {name:32s} rows={n:<8d} spark={ts:6.2f}s duckdb={td:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
