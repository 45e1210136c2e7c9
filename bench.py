"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from catalog.queries import QUERIES  # noqa: E402

HEADLINE = [
    "features_unit",
    "features_connection",
    "features_district_month",
    "exact_quantiles",
    "top_districts",
    "seasonal_summary",
    "adf_test",
    "first_transition",
    "event_panel",
    "sample_controls",
    "did_basic",
    "did_ols_cluster",
    "event_study_covariates",
    "standardise",
    "cluster_profiles",
    "contamination_cut",
    "isolation_forest_score",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Seconds to compute every row and column of the result."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # the first run also compiles the generated code; a long-lived session pays that once
    first = {n: round(run(spark, n, sf_dir), 3) for n in names}
    seconds = {n: round(run(spark, n, sf_dir), 3) for n in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
