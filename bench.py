"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is built and
run to the end twice into a sink that discards rows; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fettle.plans import catalog  # noqa: E402
from fettle.session import build_session  # noqa: E402

HEADLINE = (
    "session_dashboard", "batch_totals", "history_rows", "history_page", "region_csv_rows", "inspection_json",
    "latency_stats", "run_timeline", "export_reconcile", "adapter_union", "width_audit_source", "dedup_keep_first",
    "route_rest", "gate_report", "leak_group", "quota_spread", "release_manifest", "evaluate_split", "per_class_eval",
    "grid_select", "region_label", "seed_summary", "stream_status_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    queries = catalog.queries()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name:<24}{best:8.3f}", file=sys.stderr, flush=True)
    out = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": Path(sf_dir).name.removeprefix("sf")}
    if "evaluate_split" in times:
        items = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
        out["evaluated_items_per_sec"] = round(items / times["evaluate_split"], 1)
        out["evaluated_pixels_per_sec"] = round(64 * items / times["evaluate_split"], 1)  # an item has 8 x 8 pixels
    print(json.dumps(out))


if __name__ == "__main__":
    main()
