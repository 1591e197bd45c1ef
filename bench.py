"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully with the ``noop`` sink (every row computed,
nothing collected).  One warm-up run, then the median of ``$BENCH_RUNS``
(default 3) timed runs per query.  Prints ONE JSON line:
{"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_label",          # flagship: lags + rolling moments + future label
    "lags", "rolling_mean", "rolling_skew", "rolling_panel", "drawdown", "hours_since",
    "interpolate", "fill_cascade", "chronological_split",
    "covariance_long", "return_stats", "column_medians",
    "auc_roc", "best_threshold", "conformal_quantile", "period_scores", "forecast_grades",
    "window_spectrum", "hurst_rs", "nearest_k",
    "read_hourly_json", "precip_from_metar",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from cirro.plans.registry import load_all
    from cirro.session import local_session
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")), app="cirro-bench")
    reg = load_all()
    times: dict[str, float] = {}
    for name in (only or HEADLINE):
        e = reg[name]

        def once() -> float:
            t0 = time.perf_counter()
            e.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        once()                                   # warm-up (JIT, file listing, plan caches)
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
