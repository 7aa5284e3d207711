"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tideline.catalog import QUERIES
from tideline.session import local_session

HEADLINE = [
    "E1_last_appearance", "E4_realized_cpr_upb", "E5_realized_cpr_byage", "E6_realized_cpr_by_incentive",
    "B9_current_ltv", "E30_segment_metrics", "E31_path_fan",
    "F2_build_sequences", "F6_stratified_split", "F7_survival_cdf", "F8_auc", "F14_reliability_table", "F17_rate_sensitivity",
    "G1_ols_grouped", "G5_fama_macbeth_empirical", "G9_wls_logit_asof", "G21_expanding_durations", "G28_scurve_fit",
    "K1_bootstrap_zeros", "K6_key_rate_durations", "K7_hedged_return_panel", "K13_mc_loan_price",
]


def timed(spark, name: str, sf: str) -> float:
    t0 = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "tideline-bench")
    timed(spark, "E4_realized_cpr_upb", sf)  # start-up and first compilation
    took = {n: timed(spark, n, sf) for n in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
