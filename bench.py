"""Times the headline queries; prints one JSON line.

Each query is run to its last row with a ``noop`` write. Environment:
``BENCH_SF_DIR`` (folder of the tables), ``BENCH_CPUS``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabulon.plans.queries import QUERIES  # noqa: E402
from tabulon.session import build_session  # noqa: E402

HEADLINE = [
    "summary", "profile_numeric", "profile_categorical", "top_values", "distribution", "funding_by_year", "breakdown_geographic",
    "numeric_overview", "correlation", "histogram", "histogram_prices", "boxplot", "boxplot_outliers", "density", "radar",
    "filter_gt", "filter_counts", "search_any", "clean_fill_median", "clean_ffill", "clean_interpolate", "clean_iqr_config",
    "clean_dedupe_key", "clean_dedupe_all", "clean_config", "auto_clean", "pct_rank", "pct_rank_prices", "score_all",
    "trend_share", "stress_pivot", "collab_perf", "tag_jaccard", "tag_outcomes", "tag_heatmap", "tfidf_terms", "lda_distribution",
    "cluster_profile", "gen_rows", "one_hot", "fit_linear", "fit_forest", "regression_metrics", "results_by_model",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE if len(sys.argv) < 2 else sys.argv[1:]:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
