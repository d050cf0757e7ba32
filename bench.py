"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run in full into a no-op sink: one warm-up, then the median of the timed runs. Beyond
$BENCH_SECONDS in all (1,200) a query's first run counts and no more are made, so that the line is always printed; beyond
half as much again the rest is named as skipped.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "processing_stats", "spans_full", "spans_converter", "label_spans", "label_pattern", "label_contextual",
    "sharing_analysis", "convert_messages", "compare_labelers", "ranking_metrics", "decision_stability", "augment",
    "serialize_dsl", "split_by_ratio", "augment_grids", "vote_predictions", "batch_stats",
    "overlap_pairs", "token_metrics", "pack_examples", "split_stratified", "overlap_counts", "pattern_stability", "split_by_strata",
]


def main() -> None:
    from riskweave.plans import catalog
    from riskweave.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, skipped = {}, []
    limit, began = float(os.environ.get("BENCH_SECONDS", "1200")), time.perf_counter()
    for name in wanted:
        if time.perf_counter() - began > 1.5 * limit:
            skipped.append(name)
            continue
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
            if time.perf_counter() - began > limit:
                break
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name}: first {times[0]:.2f}s, then {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")), "documents": documents,
                "skipped": skipped, "documents_per_second": {q: round(documents / s, 1) for q, s in seconds.items() if s > 0},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
