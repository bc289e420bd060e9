"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "market_snapshot", "commercial_snapshot", "commercial_offer", "search_envelope", "unknown_excluded", "price_comparability",
    "product_list", "product_detail", "best_evidence", "facts_with_evidence", "evidence_gaps", "use_case_products", "status_timeline",
    "compare_matrix", "price_leader", "identity_resolution", "candidate_status", "unique_slugs", "lead_routes", "lead_capture",
    "normalize_requirements", "check_audit", "match_exclusions", "match_top4",
]


def session(cpus: str, folder: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("lumenstock-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.hugeMethodLimit", "8000").config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    stages = tempfile.TemporaryDirectory(prefix="bench-")
    spark = session(os.environ.get("BENCH_CPUS", "8"), stages.name)
    spark.sparkContext.setLogLevel("ERROR")
    from lumenstock.plans import QUERIES

    # One untimed pass over the headline query's inputs loads classes and compiles the common code.
    QUERIES["market_snapshot"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    stages.cleanup()


if __name__ == "__main__":
    main()
