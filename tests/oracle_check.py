"""Run registered queries against their SQL: `python -m tests.oracle_check [key-prefix ...]`."""

from __future__ import annotations

import os
import sys

from tests.support import compare, duck, spark_session


def main(prefixes):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = spark_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = entry.oracle_sql(), []
    for key, job in entry.queries().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            problem, n, ts, td = compare(spark, con, key, job, sqls.get(key), sf_dir)
        except Exception as exc:  # report and go on to the next query
            problem, n, ts, td = f"{type(exc).__name__}: {str(exc)[:900]}", -1, 0, 0
        mark = "ok " if not problem else "BAD"
        print(f"{mark} {key:28s} rows={n:<8d} spark={ts:6.2f}s sql={td:6.2f}s {'' if key in sqls else '(no sql)'} {problem}", flush=True)
        if problem:
            bad.append(key)
    print(f"{len(bad)} bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
