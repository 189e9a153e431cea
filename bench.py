"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default 8) and
``BENCH_RUNS`` (default 2; the best run counts, after the session has warmed up).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dnslens.plans.queries import QUERIES  # noqa: E402
from dnslens.session import get_spark  # noqa: E402

HEADLINE = [
    "normalize_events_fields",
    "threat_scores",
    "threat_scores_per_name",
    "threat_report",
    "typosquat",
    "typosquat_join",
    "url_threats",
    "summary_scalars",
    "summary_long",
    "buffer_summary",
    "threat_breakdown",
    "top_domains",
    "search_any",
    "search_joined",
    "filtered_view",
    "table_view",
    "page",
    "latest_by_id",
    "session_stats",
    "session_report",
    "activity_sample",
    "activity_collapse",
    "session_ledger",
    "traffic_series",
    "alerts",
    "alerts_arrival",
    "fields_ingest",
    "envelope_events",
    "capture_decode",
    "export_csv_rows",
    "stream_threat_scores",
    "stream_breakdowns",
    "stream_alerts",
]


def timed(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, folder, "alerts")  # starts the Python workers
    seconds = {name: round(min(timed(spark, folder, name) for _ in range(runs)), 3) for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale[1]) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
