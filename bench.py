"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names, or "all"
    BENCH_RUNS     timed runs per query after the first (default 1); the median is reported
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankforge.plans import REGISTRY  # noqa: E402
from rankforge.session import get_session  # noqa: E402

HEADLINE = [
    "drop_sparse_entities", "dense_user_ids", "chrono_split_train", "hash_split_test", "prepare_items",
    "year_genre_share", "trailing_genre_mean", "numeric_summary", "tfidf_overview", "genre_binarise",
    "item_cosine_topk", "user_pearson", "embedding_knn_cosine", "inverted_cell_knn",
    "simple_user_recommendations", "item_based_recommendations", "user_based_recommendations",
    "blended_recommendations", "softmax_recommendations", "similar_documents", "weighted_hybrid",
    "factor_recommendations", "svd_user_vectors", "als_history", "ranking_metrics", "register_items_stream",
]


def timed(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, "user_activity", sf_dir)  # start the workers and read the files once
    took = {}
    for name in names:
        try:
            times = [timed(spark, name, sf_dir) for _ in range(runs)]
            took[name] = round(statistics.median(times), 3)
            print(f"{name} {took[name]}", file=sys.stderr, flush=True)
        except Exception as error:  # one failing query must not hide the others
            took[name] = None
            print(f"{name} failed: {type(error).__name__}: {str(error)[:300]}", file=sys.stderr, flush=True)
    total = round(sum(t for t in took.values() if t is not None), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
