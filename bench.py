"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores (default 8). Each query is run once untimed, so that class loading
and code generation do not count, and then timed to its last row.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "ingest_csv",
    "validation_report",
    "duplicate_pairs",
    "clean_text",
    "thread_roots",
    "ticket_features",
    "feature_report",
    "category_scores",
    "label_distribution",
    "ticket_overview",
    "knowledge_base",
    "strip_tokens",
    "stratified_split",
    "metrics_summary",
    "tfidf_terms",
    "promotion",
    "sample_per_label",
    "knn_exact",
    "retrieved_examples",
    "check_drafts",
    "score_response",
    "safety_summary",
    "triage_audit",
    "stream_ingest",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from threadloom.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for timed in (False, True):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
