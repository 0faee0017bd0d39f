"""Pairing of agent stops and starts, first stop with first start, inside an incident.

Read the events of a session as +1 (stop) and -1 (start). The number of waiting stops is the
running sum minus its lowest value so far (never above zero), and a start is unmatched exactly
when it sets a new lowest value. So ranks of stops and of matched starts are running totals, and
the k-th matched start belongs to the k-th stop: an equality join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions.clock import whole_seconds
from alertlake.operators.ranges import range_chunks
from alertlake.operators.sessions import SESSION


def agent_outages(session_alerts: DataFrame) -> DataFrame:
    """Per Agent Visibility session: stops, starts, recoveries, seconds down, stops still open."""
    c = F.col
    events = session_alerts.filter(c("event_category") == "Agent Visibility").select(
        *SESSION, "event_us", "record_number",
        c("rule_id").isin(dims.STOP_RULES).alias("is_stop"),
    )
    counts = events.groupBy(*SESSION).agg(
        F.count_if("is_stop").alias("stop_count"), F.count_if(~c("is_stop")).alias("start_count"),
        F.count_if(c("is_stop") & c("event_us").isNotNull()).alias("timed_stops"),
    )
    pairs = _recoveries(events.filter(c("event_us").isNotNull()))
    return (
        counts.join(pairs, SESSION, "left")
        .fillna(0, ["recovered_count", "recovered_seconds"])
        .withColumn("outstanding", c("timed_stops") - c("recovered_count"))
        .drop("timed_stops")
    )


def _recoveries(events: DataFrame) -> DataFrame:
    c = F.col
    chunks = range_chunks(events, *SESSION, "event_us", "record_number").withColumn(
        "step", F.when(c("is_stop"), 1).otherwise(-1)
    )
    in_chunk = Window.partitionBy("chunk", *SESSION).orderBy("event_us", "record_number")
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    local = chunks.withColumns({
        "total": F.sum("step").over(so_far),
        "stops": F.sum(c("is_stop").cast("bigint")).over(so_far),
    }).withColumn("lowest", F.min("total").over(so_far))
    # One row per session and chunk; a session has at most as many as there are chunks.
    sums = local.groupBy("chunk", *SESSION).agg(
        F.sum("step").alias("chunk_total"), F.min("lowest").alias("chunk_lowest"),
        F.sum(c("is_stop").cast("bigint")).alias("chunk_stops"),
    )
    earlier = (
        Window.partitionBy(*SESSION).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        sums.withColumns({
            "base_total": F.coalesce(F.sum("chunk_total").over(earlier), F.lit(0)),
            "base_stops": F.coalesce(F.sum("chunk_stops").over(earlier), F.lit(0)),
        })
        .withColumn("end_lowest", c("base_total") + c("chunk_lowest"))
        .withColumn("base_lowest", F.least(F.coalesce(F.min("end_lowest").over(earlier), F.lit(0)), F.lit(0)))
        .select("chunk", *SESSION, "base_total", "base_stops", "base_lowest")
    )
    placed = local.join(carried, ["chunk", *SESSION]).select(
        *SESSION, "event_us", "is_stop",
        (c("base_total") + c("total")).alias("total"),
        (c("base_stops") + c("stops")).alias("stops"),
        F.least(c("base_lowest"), c("base_total") + c("lowest")).alias("lowest"),
        F.least(
            c("base_lowest"),
            c("base_total") + F.coalesce(F.lag("lowest").over(in_chunk), F.lit(0)),
        ).alias("lowest_before"),
    )
    stops = placed.filter("is_stop").select(*SESSION, c("stops").alias("k"), c("event_us").alias("stop_us"))
    starts = placed.filter(~c("is_stop") & (c("total") >= c("lowest_before"))).select(
        *SESSION, (c("stops") - c("total") + c("lowest")).alias("k"), c("event_us").alias("start_us")
    )
    return (
        stops.join(starts, [*SESSION, "k"])
        .groupBy(*SESSION)
        .agg(
            F.count("*").alias("recovered_count"),
            F.sum(whole_seconds(c("start_us") - c("stop_us"))).alias("recovered_seconds"),
        )
    )
