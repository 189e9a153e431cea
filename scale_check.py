"""Time core operators on replicated events with a hot name: ``scale_check.py [factor] [folder]``.

The events are repeated ``factor`` times with shifted ids and times, and a third of
all rows gets one name and one session. Prints one JSON line per step.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import functions as F

from dnslens.operators import alerts, sessions, summary
from dnslens.operators.normalize import build_events
from dnslens.operators.threat import score_events
from dnslens.operators.typosquat import default_brands, typosquat_matches
from dnslens.plans import derived
from dnslens.plans import tables as t
from dnslens.session import get_spark


def replicated(spark, folder: str, factor: int):
    base = t.raw(spark, folder)
    copies = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    hot = F.col("seq") % 3 == 0
    return copies.withColumns(
        {
            "seq": F.col("seq") + F.col("copy") * 10_000_000,
            "event_ts": F.col("event_ts") + F.make_dt_interval(F.col("copy") * 30),
            "domain": F.when(hot, F.lit("login-verify-account.ml")).otherwise(F.col("domain")),
            "session_id": F.when(hot, F.lit("session-hot")).otherwise(F.col("session_id")),
        }
    ).drop("copy")


def main() -> None:
    factor = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    folder = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    spark = get_spark("scale", "local[8]", spark__sql__shuffle__partitions="32", spark__driver__memory="16g",
                      spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    raw = replicated(spark, folder, factor)
    events = build_events(raw, "tshark", "live")
    unscored = build_events(raw, "tshark", "live", score=False)
    steps = {
        "rows": lambda: raw,
        "score plain": lambda: events,
        "score per name": lambda: score_events(unscored, per_name=True),
        "summary one scan": lambda: summary.breakdowns(events),
        "typosquat join": lambda: typosquat_matches(unscored, default_brands(spark)),
        "activity sample": lambda: sessions.activity_sample(unscored, chunk_rows=100_000),
        "activity collapse": lambda: sessions.collapse_activity(derived.activities(raw), chunk_rows=100_000),
        "session report": lambda: sessions.session_report(unscored),
        "alerts, no split": lambda: alerts.alerts(events, "1 hour", max_group_rows=10**9),
        "alerts, hot name split": lambda: alerts.alerts(events, "1 hour", max_group_rows=100_000),
    }
    for name, step in steps.items():
        start = time.perf_counter()
        count = step().count() if name.startswith(("rows", "alerts")) else None
        if count is None:
            step().write.format("noop").mode("overwrite").save()
        print(json.dumps({"step": name, "factor": factor, "seconds": round(time.perf_counter() - start, 2), "rows": count}), flush=True)


if __name__ == "__main__":
    main()
