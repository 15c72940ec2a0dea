"""Headline queries over one scale; prints one JSON line.

Every query runs once to warm up and then twice; the faster run counts.  Results go
to the no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from matewise.plans import catalogue  # noqa: E402

HEADLINE = [
    "assemble_default",
    "assemble_no_validate",
    "assemble_no_correct",
    "overlap_search",
    "validate_normal",
    "correct_pair",
    "run_stats",
    "merged_read_records",
    "agreement_report",
    "min_informative_overlap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs[1:]), 3)
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "pairs": pairs,
                "pairs_per_second": round(pairs / seconds["assemble_default"]),
                "cpus": int(cpus),
                "repetitions": 2,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
