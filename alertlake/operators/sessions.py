"""Correlation keys and gap sessions.

Time is cut into cells as wide as the window. Alerts of one key in one cell always belong to one
session, so a key's sessions follow from the first and last time of its cells. The cells are an
ordinary aggregation that each task reduces beforehand; the only window runs over cells, whose
number per key is bounded by the time span, however many alerts a key has.

Alerts without a time are sessions of their own: `solo` holds their record number (0 otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions.text import known

KEY_TEXTS = ["manager_name", "agent_id", "affected_asset", "source_ip", "event_category", "identity"]
# The hash comes first so that sorts compare one number; the texts keep keys exact.
KEY = ["key_hash", *KEY_TEXTS]
CELL = [*KEY, "cell", "solo"]
SESSION = [*KEY, "session_us", "solo"]


def window_us(minutes: int) -> int:
    return max(minutes, 1) * 60_000_000


def cell_of(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def identity() -> Column:
    """The account that keeps unrelated identity events apart, where the category needs one."""
    c = F.col
    target = c("target_user")
    unattributed = (c("event_category") == "Credential Attack") & ~known(c("source_ip"))
    return (
        F.when(c("event_category").isin("Authentication Success", "Session Activity"), target)
        .when(c("event_category") == "Privilege Activity", c("actor_user"))
        .when(unattributed & known(target), target)
        .when(unattributed, F.concat(F.lit("record:"), c("record_number").cast("string")))
        .otherwise(dims.MISSING)
    )


def keyed(alerts: DataFrame, minutes: int) -> DataFrame:
    """Adds the correlation key and the time cell."""
    us = F.col("event_us")
    return alerts.withColumns({
        "identity": identity(),
        "cell": F.coalesce(cell_of(us, window_us(minutes)), F.lit(0).cast("bigint")),
        "solo": F.when(us.isNull(), F.col("record_number")).otherwise(F.lit(0)),
    }).withColumn("key_hash", F.xxhash64(*KEY_TEXTS))


def session_cells(keyed_alerts: DataFrame, minutes: int) -> DataFrame:
    """One row per key and cell with the start of its session and what chain detection needs."""
    c = F.col
    cells = (
        keyed_alerts.filter(c("event_us").isNotNull())
        .groupBy(*CELL)
        .agg(
            F.min("event_us").alias("first_us"),
            F.max("event_us").alias("last_us"),
            F.count("*").alias("n"),
            F.max(c("rule_id").isin(dims.EXPLICIT_ATTACK_RULES)).alias("explicit"),
        )
    )
    in_key = Window.partitionBy(*KEY).orderBy("cell")
    gap = c("first_us") - F.lag("last_us").over(in_key)
    opens = F.coalesce(gap > window_us(minutes), F.lit(True))
    start = F.max("opened_us").over(in_key.rowsBetween(Window.unboundedPreceding, 0))
    return (
        cells.withColumn("opened_us", F.when(opens, c("first_us")))
        .withColumn("session_us", start)
        .drop("opened_us")
    )


def with_sessions(keyed_alerts: DataFrame, cells: DataFrame) -> DataFrame:
    """Alerts with the start of their session (0 for alerts without a time)."""
    starts = cells.select(*CELL, "session_us")
    return keyed_alerts.join(starts, CELL, "left").fillna(0, ["session_us"])


def session_totals(cells: DataFrame) -> DataFrame:
    """Size and end of each timed session."""
    return cells.groupBy(*SESSION).agg(
        F.sum("n").alias("event_count"),
        F.max("last_us").alias("end_us"),
        F.max("explicit").alias("explicit"),
    )
