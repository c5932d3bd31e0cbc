"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_QUERIES a comma list.
Each query runs once after a small warm-up of the session on the same tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import REGISTRY  # noqa: E402
from shiftlens.session import local_session  # noqa: E402

HEADLINE = [
    "column_profile",
    "numeric_stats",
    "duplicate_rows",
    "rolling_z_points",
    "row_rolling_points",
    "temporal_changepoint",
    "iforest_points",
    "decompose_all",
    "welch_t",
    "mann_whitney",
    "test_selection",
    "chi_square",
    "spearman",
    "hyp_segment",
    "hyp_covariate",
    "hypotheses_ranked",
    "top_scenarios",
    "report_matrix",
    "chart_box",
    "history_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "shiftlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("welch_t", "spearman"):
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
