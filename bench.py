"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from funclab.session import session
from suite.queries import QUERIES

HEADLINE = [
    "preprocess",
    "dataset_stats",
    "strip_comments",
    "noisy_lines",
    "stratified_split",
    "undersample",
    "oversample",
    "experiments",
    "write_experiments",
    "few_shot_prompts",
    "fine_tuning_chats",
    "chat_tokens",
    "fine_tune_cost",
    "batch_predict",
    "locate_lines",
    "func_metrics",
    "model_overlap",
    "line_metrics",
    "score_matrix",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    spark = session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
