"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default: the headline set below; "all" for every one)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketlens.plans.catalog import queries  # noqa: E402
from basketlens.session import local_session  # noqa: E402

HEADLINE = [
    "profile_describe",
    "profile_distinct",
    "profile_distinct_approx",
    "profile_nulls",
    "bin_all",
    "value_score",
    "category_flags",
    "feature_set_purchase_behavior",
    "features_all",
    "row_id_generated",
    "src_csv_roundtrip",
    "encode_index",
    "encode_onehot",
    "split_export",
    "scale_numeric",
    "segment_assign",
    "segment_counts",
    "segment_profile",
    "category_preferences",
    "season_preferences",
    "size_preferences",
    "category_pref_any",
    "box_age",
    "box_value_score",
    "metric_classification",
    "kmeans_segments",
    "rf_classify",
    "rf_regress",
    "predict_all_targets",
    "predict_all_first_slot",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    known = queries()
    names = list(known) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session and the first compilation belong to no query.
    known["segment_profile"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
