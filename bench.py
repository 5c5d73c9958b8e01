"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from cuebook.plans.catalog import QUERIES

NAMES = ["stats_by_model", "stats_by_month", "active_tasks", "price_totals", "srt_document", "speech_runs", "merge_intervals", "session_clusters", "frame_rms", "event_latest_state", "price_breakdown", "convert_formats", "task_clusters", "history_rows", "folded_state", "batch_tasks"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    QUERIES["event_state_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up isn't the first query's
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
