"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs once to warm
up and once for the record; results are computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from trawlkit.plans import catalog
from trawlkit.session import build_session

HEADLINE = [
    "verdict_summary",
    "verdict_url",
    "join_url_pattern",
    "verdict_response",
    "agg_status_class",
    "agg_attempts",
    "win_running_job",
    "join_control_asof",
    "win_hello_mode",
    "sink_message_json",
    "normalize_body",
    "dupe_detect",
    "page_line_diff",
    "links_resolve",
    "frontier_expand",
    "sink_warc_plan",
    "sink_cdx",
    "st_counters",
    "dupe_stream",
]


def run(spark, folder: str, make) -> float:
    began = time.perf_counter()
    make(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "trawlkit-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.log.level": "ERROR"},
    )
    made, seconds = catalog.queries(), {}
    for name in HEADLINE:
        run(spark, folder, made[name])
        seconds[name] = round(run(spark, folder, made[name]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
