"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "w1_inter_onset_intervals", "w3_p1_dyads_with_stability", "a1_a2_rhythm_summaries", "a5_speech_metrics",
    "w4_greedy_cluster", "w10_dedupe_keep_strongest", "w7_threshold_sweep", "m5_classify_comparison", "m8_focus_regions",
    "m4_name_match_exact_then_stem", "a8_group_ratio_summary", "a9_ratio_histogram_levels", "g1_ks_against_uniform",
    "g8_lag_one_autocorrelation", "w12_w13_selection_windows", "w18_flux_events_with_intervals", "a20_spectral_profile",
    "a23_region_features", "e1_change_events",
)


def main() -> None:
    from tactus.plans.catalog import QUERIES
    from tactus.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.conf.set("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
