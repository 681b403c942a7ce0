"""Seconds per headline query, as one JSON line.

Each query runs once to warm up the JVM (generated code, file listing) and then
``BENCH_RUNS`` times; the best of these counts. The first query runs twice more
at the start, for the JVM as a whole. Results go to Spark's ``noop`` sink, so
every row is computed and none is brought to the driver.
"""

from __future__ import annotations

import json
import os
import time

from dueline.plans.catalog import QUERIES
from dueline.session import local_session

HEADLINE = (
    "case_features labelled_log train_test_counts horizon_sweep agg_numeric agg_dynamic "
    "dynamic_counts static_onehot time_bucket state_bucket late_label event_nr event_duration "
    "time_since_last time_since_first cumulative_duration total_duration time_attributes "
    "seq_length activity_count remaining_time remaining_bus_days label_broadcast count_cases "
    "cases_intersecting cases_starting_in cases_ending_in min_activity semi_split "
    "deadline_lookup business_day_offset busday_count busdays_inclusive payment_run "
    "temporal_split cutoff_split split_violations fold_assign roc_auc ensemble threshold_curve "
    "threshold_best confusion last_event_busdays busdays_freq busdays_hist busdays_describe "
    "remaining_by_state state_stats state_box log_statistics log_summary leaderboard_pivot "
    "log_source csv_roundtrip xes_ingest"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in [names[0], names[0]]:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt > 0 or runs == 0:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cores,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "runs": runs,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
