"""Times the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated names, default: the headline list; "all" runs everything).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankloom.plans import catalog  # noqa: E402
from rankloom.session import build_session  # noqa: E402

HEADLINE = [
    "auc_tied_scores", "auc_distinct_scores", "group_auc", "auc_by_group", "rank_in_group", "topk_metrics",
    "ndcg_overall", "ndcg_by_request", "score_deciles_exact", "score_deciles_approx", "describe_scores",
    "scale_pos_weight", "binary_losses", "merge_category_features", "stratified_downsample", "split_train_test",
    "dedup_predictions", "dense_index", "fit_dictionary", "encode_columns", "extend_dictionary", "reattach_side_table",
    "slice_features", "process_realtime", "select_sparse_ids", "offset_encode", "minmax_scale_by_group",
    "windowed_counts_user_item", "horizon_totals", "hour_week_profile", "behaviour_sequence_long",
    "quantile_bucketize", "passtime", "sum_pool_sequence", "score_pairs", "top_items", "fm_second_order",
    "group_covariance", "channel_thresholds", "channel_class_belonging", "largest_box", "attack_target_matrix",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
