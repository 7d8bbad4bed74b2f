"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query's result is materialised with the no-op writer (full execution, no
driver collection of large results). Before the timed pass every query runs
once on sf0.001 (set BENCH_NO_WARMUP=1 to skip) so timings exclude first-time
code generation.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "metrics_by_split",
    "metrics_by_period",
    "auc_roc",
    "ks_drift",
    "js_drift",
    "period_drift",
    "drift_report",
    "feature_pipeline",
    "rolling_brier",
    "weight_update",
    "stability_stats",
    "stream_window_brier",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from scorewatch.session import make_session

    extra = {"spark.eventLog.enabled": "false"}
    if os.environ.get("BENCH_EVENT_LOG"):
        d = tempfile.mkdtemp(prefix="bench-events-")
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": d}
    spark = make_session(f"local[{cpus}]", partitions=max(cpus, 8), app="scorewatch-bench", extra=extra)
    from scorewatch.plans import registry

    qs = registry.queries()
    names = only or HEADLINE
    # Warm-up: the same plan shapes once on the small scale, so the timed pass
    # measures execution rather than first-time code generation and JIT.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm) and os.environ.get("BENCH_NO_WARMUP") is None:
        for name in names:
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
