"""The report's tables and figures: top lists, audits, shares, posture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.operators.incidents import queue_order
from alertlake.session import written


def newest(alerts: DataFrame, categories: list[str], columns: list[str], n: int = dims.AUDIT_ROWS) -> DataFrame:
    """The newest alerts of some categories; alerts without a time come last."""
    return (
        alerts.filter(F.col("event_category").isin(categories))
        .orderBy(F.desc_nulls_last("event_us"), F.asc("pos"))
        .limit(n).select("pos", *columns)
    )


def authentication(alerts: DataFrame) -> DataFrame:
    return newest(alerts, dims.AUTH_CATEGORIES, dims.AUTHENTICATION_COLUMNS)


def privilege(alerts: DataFrame) -> DataFrame:
    return newest(alerts, ["Privilege Activity"], dims.PRIVILEGE_COLUMNS)


def agent_health(alerts: DataFrame) -> DataFrame:
    return newest(alerts, ["Agent Visibility"], dims.HEALTH_COLUMNS)


def shown(summary: DataFrame, table: str) -> DataFrame:
    """The first rows of a summary in its order, with how many there are in all.

    The sorted summary is worked out and written once; its row numbers follow the order, and both
    the first rows and their number come from the written table.
    """
    rows, columns = dims.REPORT_TABLES[table]
    kept = written(summary.select(*columns).withColumn("row", F.monotonically_increasing_id()), f"shown-{table}")
    total = kept.agg(F.count("*").alias("n")).scalar()
    return kept.orderBy("row").limit(rows).select(*columns).withColumn("total_rows", total)


def priority_incidents(incidents: DataFrame, n: int = 12) -> DataFrame:
    return incidents.orderBy(*queue_order()).limit(n).select(*dims.INCIDENT_COLUMNS)


def risk_distribution(metrics: DataFrame) -> DataFrame:
    """Incidents per risk band and their share, also for empty bands."""
    bands = F.array(*[
        F.struct(F.lit(b).alias("risk_level"), F.col(f"{b.lower()}_incidents").alias("incident_count"))
        for b in ("Critical", "High", "Medium", "Low")
    ])
    total = F.greatest("total_incidents", F.lit(1))
    return metrics.select("total_incidents", F.inline(bands)).select(
        "risk_level", "incident_count",
        F.format_string("%.2f", F.col("incident_count") / total * 100).alias("share_percent"),
    )


def timeline_share(timeline: DataFrame) -> DataFrame:
    """Timeline relative to its highest bucket."""
    c = F.col
    peak = F.greatest(timeline.agg(F.max("alert_count").alias("n")).scalar(), F.lit(1))
    return timeline.select(
        "period_start", F.substring("period_start", 12, 5).alias("label"), "alert_count",
        F.format_string("%.4f", c("alert_count") / peak).alias("alert_share"),
        F.format_string("%.4f", c("high_or_critical_count") / peak).alias("high_share"),
    )


def posture(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """The overall verdict with the numbers behind it and the top incident: one row."""
    c = F.col
    top = incidents.orderBy(*queue_order()).limit(1).select(
        F.struct("title", "risk_score", "event_count").alias("t")
    ).scalar()
    level = (
        F.when(c("critical_incidents") > 0, "critical").when(c("high_incidents") > 0, "high")
        .when(c("medium_incidents") > 0, "medium").otherwise("none")
    )
    top_text = F.when(
        c("top").isNotNull(),
        F.format_string(
            dims.POSTURE_TOP, c("top.title"), c("top.risk_score"), c("top.event_count")
        ),
    ).otherwise("")
    counted = F.format_string(
        dims.POSTURE_COUNTS,
        c("total_alerts"), c("total_incidents"), c("asset_count"), c("source_ip_count"),
        c("critical_incidents") + c("high_incidents"),
    )
    return metrics.withColumn("top", top).withColumn("posture", level).select(
        "posture",
        (c("critical_incidents") + c("high_incidents")).alias("high_priority_incidents"),
        F.concat(dims.lookup(dims.POSTURES, c("posture")), counted, top_text).alias("text"),
    )
