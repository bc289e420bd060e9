"""Compare a registered query with its SQL on DuckDB, as order-free sets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import tempfile
import time

import duckdb


def spark_session(cpus: int = 8, folder: str | None = None):
    """A local session; steps are stored in `folder`, or where the environment says."""
    from pyspark.sql import SparkSession

    folder = folder or os.environ.get("CHECK_STAGE_DIR") or tempfile.mkdtemp(prefix="run-")
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("lumenstock-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, key, job, sql, sf_dir):
    """Problem text (empty when equal), row count, Spark seconds, DuckDB seconds."""
    t0 = time.time()
    df = job(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "", len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got), t1 - t0, t2 - t1
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:3]
        missing = [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)} vs {len(b)}; only spark {extra}; only sql {missing}", len(got), t1 - t0, t2 - t1
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        sa, sb = set(a), set(b)
        return (f"{len(diff)} rows differ; spark {[x for x in a if x not in sb][:2]} "
                f"sql {[x for x in b if x not in sa][:2]}"), len(got), t1 - t0, t2 - t1
    return "", len(got), t1 - t0, t2 - t1
