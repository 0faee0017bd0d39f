"""The analysis as a whole: load and normalise, correlate, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions import clock
from alertlake.operators import summaries
from alertlake.operators.filters import dedup_best, drop_reason
from alertlake.operators.incidents import correlate, queue_order, written_incidents
from alertlake.operators.normalize import in_display_zone, normalize_alerts
from alertlake.operators.quality import alert_counts, check_byte_budget, check_strict, line_counts, stats_of_counts
from alertlake.session import prepare, written
from alertlake.sources.lines import counted_lines, judged_lines, line_prefix


@dataclass(frozen=True)
class Options:
    """Parameters of a report. Limits of 0 are off."""

    min_level: int = 0
    since: str | None = None
    until: str | None = None
    scope_only: bool = False
    line_limit: int = 0
    max_line_bytes: int = 0
    max_input_bytes: int = 0
    strict: bool = False
    timezone: str = "input"
    incident_window_minutes: int = 10
    partitions: int | None = None

    def __post_init__(self) -> None:
        for name in ("line_limit", "max_line_bytes", "max_input_bytes"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.incident_window_minutes < 1:
            raise ValueError("incident_window_minutes must be at least 1")

    def bounds(self) -> tuple[int | None, int | None]:
        since, until = clock.filter_bound(self.since), clock.filter_bound(self.until)
        if since is not None and until is not None and since > until:
            raise ValueError("since must not be later than until")
        return since, until


@dataclass
class Result:
    """All tables of a report. `incidents` also has the columns its order depends on."""

    alerts: DataFrame
    incidents: DataFrame
    by_source: DataFrame
    by_type: DataFrame
    by_asset: DataFrame
    by_rule: DataFrame
    mitre: DataFrame
    recommendations: DataFrame
    timeline: DataFrame
    metrics: DataFrame


def load_records(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Every line with its status, its alert fields and the filter that drops it."""
    since, until = options.bounds()
    judged = judged_lines(lines, options.max_line_bytes)
    reason = drop_reason(options.min_level, since, until, options.scope_only)
    return normalize_alerts(judged, "n_bytes", "line_status").withColumn("drop_reason", reason)


def accepted(records: DataFrame, line_limit: int = 0) -> DataFrame:
    """The alerts that pass: good lines, all filters, best copy of each event."""
    c = F.col
    kept = records.filter(
        (c("line_status") == "ok") & c("drop_reason").isNull()
        & (c("record_number") <= (line_limit or 2**62))
    )
    return dedup_best(kept.drop("n_bytes", "line_status", "drop_reason"))


def analyze(alerts: DataFrame, incident_window_minutes: int = 10, timezone: str = "input") -> Result:
    """All tables from one set of alerts. Incidents are written once; the rest stays lazy."""
    return tables_of(alerts, written_incidents(correlate(alerts, incident_window_minutes)), timezone)


def tables_of(alerts: DataFrame, found: DataFrame, timezone: str = "input") -> Result:
    """All tables from alerts and their incidents."""
    queue = found.orderBy(*queue_order())
    return Result(
        alerts=alerts,
        incidents=queue,
        by_source=summaries.by_source(alerts, found),
        by_type=summaries.by_type(alerts),
        by_asset=summaries.by_asset(alerts, found),
        by_rule=summaries.by_rule(alerts),
        mitre=summaries.by_mitre(alerts),
        recommendations=summaries.recommendations(queue),
        timeline=summaries.timeline(alerts, timezone),
        metrics=summaries.metrics(alerts, found),
    )


@dataclass
class Report:
    result: Result
    stats: DataFrame
    options: Options


def report(spark: SparkSession, paths: str | list[str], options: Options = Options()) -> Report:
    """From alert files to all tables. Raises before anything is published if a gate fails.

    Lines are parsed once into a written table; counters, filters and the choice of copies read
    only the columns they need from it.
    """
    prepare(spark)
    options.bounds()
    clock.zone_offset(F.col("event_us"), options.timezone)
    lines, scanned = counted_lines(spark, paths, options.partitions, options.line_limit)
    if options.max_input_bytes:
        # An input over the budget is refused before anything is parsed. With a line limit the
        # bytes are those of the lines within it.
        if options.line_limit:
            within = line_prefix(lines, options.line_limit + 1)
            scanned = within.agg(F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes")).first().asDict()
        check_byte_budget({"input_bytes": scanned["bytes"]}, options.max_input_bytes)
    records, counts = written(load_records(lines, options), "records", line_counts(options.line_limit))
    alerts, kept = written(
        in_display_zone(accepted(records, options.line_limit), options.timezone), "alerts", alert_counts()
    )
    stats = written(stats_of_counts(counts | kept, records, options.line_limit), "stats")
    if options.strict:
        check_strict(stats.first().asDict())
    result = analyze(alerts, options.incident_window_minutes, options.timezone)
    return Report(result, stats, options)
