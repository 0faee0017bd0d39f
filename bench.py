"""Times the report's stages one after the other and prints one JSON line.

Each stage is timed cold, with everything it computes itself: reading the raw JSON lines, choosing
copies, correlating, and each summary from the tables written before it. Then it is timed warm:
the median of three more runs, without the time that code takes to be compiled.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from alertlake.operators import incidents, summaries
from alertlake.operators.ranges import ranked
from alertlake.plans.analysis import accepted, load_records
from alertlake.plans.catalog import WINDOW
from alertlake.session import discard_written, prepare, spread, written
from alertlake.sources.event_alerts import alert_lines

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WORK_DIR = os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="alertlake-bench-")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = prepare(
        SparkSession.builder.master(f"local[{CPUS}]").appName("alertlake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", WORK_DIR)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    warm: dict[str, float] = {}

    def clocked(build):
        began = time.perf_counter()
        result = build()
        return result, round(time.perf_counter() - began, 3)

    def timed(name: str, build):
        result, seconds[name] = clocked(build)
        warm[name] = median(clocked(build)[1] for _ in range(3))
        return result

    def consumed(build):
        return lambda: build().write.format("noop").mode("overwrite").save()

    lines = written(spread(alert_lines(spark, SF_DIR), "record_number"), "lines")
    records = timed("normalize_alerts", lambda: written(load_records(lines), "records"))
    alerts = timed("dedup_best", lambda: written(accepted(records), "alerts"))
    run = timed("sessions_and_matches", lambda: incidents.correlate(alerts, WINDOW))
    found = timed("incidents", lambda: written(incidents.build_incidents(run), "incidents"))
    timed("compromise_incidents", consumed(lambda: found.filter("compromised")))
    timed("incident_queue", consumed(lambda: ranked(found, *incidents.queue_order())))
    timed("summary_by_source", consumed(lambda: summaries.by_source(alerts, found)))
    timed("summary_by_type", consumed(lambda: summaries.by_type(alerts)))
    timed("summary_by_asset", consumed(lambda: summaries.by_asset(alerts, found)))
    timed("summary_by_rule", consumed(lambda: summaries.by_rule(alerts)))
    timed("mitre_summary", consumed(lambda: summaries.by_mitre(alerts)))
    timed("timeline", consumed(lambda: summaries.timeline(alerts)))
    timed("metrics", consumed(lambda: summaries.metrics(alerts, found)))
    rows = records.count()
    print(json.dumps({
        "metric": "full_report_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "warm_seconds": round(sum(warm.values()), 3), "warm": warm,
        "lines_per_second_warm": round(rows / sum(warm.values())), "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "alert_lines": rows, "incidents": found.count(),
    }))
    discard_written(spark)
    spark.stop()


if __name__ == "__main__":
    main()
