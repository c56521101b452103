"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tristage.plans.catalog import QUERIES
from tristage.session import local_session

HEADLINE = [
    "failure_rate_by_source", "stage_label_counts", "trial_outcomes", "replicate_outcomes", "pooled_records",
    "unique_record_ids", "stripped_pages", "letter_composition", "center_inventory", "negative_concentration",
    "data_gate", "sequence_ids", "hashed_split", "time_holdout", "fold_report", "pr_auc_by_center",
    "evaluation_overall", "group_spread_by_year", "best_f1_by_score", "threshold_calibration",
    "bootstrap_intervals", "rank_auc_by_center", "paired_score_shift", "pairs_with_corpus",
    "similarity_components", "trials_from_xml", "merge_written_partitions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["stage_label_counts"](spark, sf_dir).collect()  # warm the JVM and the file cache
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
