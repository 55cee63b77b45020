"""Time the headline queries once each, warm JVM, and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_QUERIES optionally a comma-separated selection.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark import plans  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "customer_360", "industry_kpis", "value_counts_pct", "profile_columns", "feature_medians", "feature_modes",
    "standard_scale", "gram_matrix", "ridge_impute", "stratified_split", "kfold_assign", "clean_features",
    "validation_violations", "header_similarity", "detect_industry", "column_mapping", "roc_auc",
    "classification_report", "conformal_quantiles", "conformal_coverage", "business_impact", "knn_join",
    "knn_join_tiled", "neighbour_vote", "what_if", "score_batch", "batch_summary", "industry_dashboard",
    "risk_set_table", "cox_hazard_ratios", "stream_score_batch", "stacking_scores",
    "score_batch_saved", "dashboard_incremental", "ordered_statistics", "knn_index_recall",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    spark = local_session(cpus, "tidemark-bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries = plans.queries()
    queries["profile_columns"](spark, base).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, base).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": Path(base).name, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
