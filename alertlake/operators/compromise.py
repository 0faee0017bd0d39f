"""Failure chains followed by a success of the same source on the same account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.text import known
from alertlake.operators.sessions import CELL, SESSION, cell_of, session_totals, window_us

# What sets a chain's key apart from that of a success of the same origin.
MOVED = ["key_hash", "event_category", "identity"]
ORIGIN = ["manager_name", "agent_id", "affected_asset", "source_ip"]


def is_chain() -> Column:
    """Several failures, or one rule that already stands for an attack."""
    return F.col("explicit") | (F.col("event_count") >= 3)


def failure_chains(cells: DataFrame) -> DataFrame:
    attacks = cells.filter(F.col("event_category") == "Credential Attack")
    return session_totals(attacks).filter(is_chain())


def chain_targets(keyed_alerts: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per chain of a known source and account it tried."""
    c = F.col
    tried = keyed_alerts.filter(
        (c("event_category") == "Credential Attack")
        & c("event_us").isNotNull() & known(c("source_ip")) & known(c("target_user"))
    ).select(*CELL, "target_user").distinct()
    per_session = tried.join(cells.select(*CELL, "session_us"), CELL).select(*SESSION, "target_user")
    return per_session.distinct().join(failure_chains(cells), SESSION)


def compromise_matches(keyed_alerts: DataFrame, cells: DataFrame, minutes: int) -> DataFrame:
    """The earliest success within one window after the end of each chain.

    A chain's end reaches into two cells, so the range condition becomes an equality on the cell.
    A success follows at most one chain closely enough: chains of one origin are more than a
    window apart. The join therefore yields no more rows than there are successes.
    """
    c = F.col
    width = window_us(minutes)
    end_cell = cell_of(c("end_us"), width)
    chains = chain_targets(keyed_alerts, cells).withColumn(
        "near", F.explode(F.array(end_cell, end_cell + width))
    )
    successes = keyed_alerts.filter(
        (c("event_category") == "Authentication Success")
        & c("event_us").isNotNull() & known(c("source_ip")) & known(c("target_user"))
    ).select(*ORIGIN, "target_user", c("cell").alias("near"), "event_us", "record_number")
    delay = c("event_us") - c("end_us")
    pairs = chains.join(successes, [*ORIGIN, "target_user", "near"]).filter(
        (delay > 0) & (delay <= width)
    )
    return (
        pairs.groupBy(*SESSION, "end_us")
        .agg(F.min(F.struct("event_us", "record_number")).alias("hit"))
        .select(
            *SESSION, end_cell.alias("end_cell"),
            c("hit.record_number").alias("record_number"), c("hit.event_us").alias("success_us"),
        )
    )


def with_matches(keyed_alerts: DataFrame, matches: DataFrame) -> DataFrame:
    """Moves each matched success from its own session into the last cell of its chain.

    Only successes take part in the join. Session starts are kept: they were found before.
    """
    c = F.col
    is_success = c("event_category") == "Authentication Success"
    moved = matches.select(
        "record_number", "end_cell", *[c(n).alias(f"chain_{n}") for n in MOVED]
    )
    successes = keyed_alerts.filter(is_success).join(moved, "record_number", "left")
    placed = successes.withColumns({
        "matched": c("end_cell").isNotNull(),
        **{n: F.coalesce(f"chain_{n}", n) for n in MOVED},
        "cell": F.coalesce("end_cell", "cell"),
    }).drop("end_cell", *[f"chain_{n}" for n in MOVED])
    others = keyed_alerts.filter(~is_success).withColumn("matched", F.lit(False))
    return others.unionByName(placed)
