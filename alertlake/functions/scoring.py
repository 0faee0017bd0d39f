"""Severity, risk and advice expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions.text import known


def severity(level: Column) -> Column:
    return (
        F.when(level >= 12, "Critical").when(level >= 8, "High").when(level >= 4, "Medium")
        .otherwise("Informational")
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 85, "Critical").when(score >= 65, "High").when(score >= 40, "Medium")
        .otherwise("Low")
    )


def alert_score(rule_id: Column, level: Column, alert_type: Column, scope: Column) -> Column:
    """Level points plus bonuses, never below the floor of the level's band, at most 100."""
    points = (
        F.least(F.greatest(level, F.lit(0)) * 6, F.lit(75))
        + F.coalesce(dims.lookup(dims.TYPE_BONUS, alert_type), F.lit(0))
        + F.when(scope == "Public/External", 7).otherwise(0)
        + F.when(rule_id.isin(dims.CUSTOM_RULES), 5).otherwise(0)
    )
    floor = F.when(level >= 12, 85).when(level >= 8, 65).when(level >= 4, 40).otherwise(0)
    return F.least(F.greatest(points, floor), F.lit(100)).cast("int")


def advice(category: Column, alert_type: Column, source: Column, user: Column, risk: Column) -> Column:
    """Response text: template of the category with source and account filled in."""
    template = F.when(
        (category == "Reconnaissance") & (alert_type == "Port Scan"), dims.PORT_SCAN_ADVICE
    ).otherwise(F.coalesce(dims.lookup(dims.ADVICE, category), F.lit(dims.OTHER_ADVICE)))
    who = F.when(known(user), user).otherwise(dims.UNKNOWN_USER_LABEL)
    where = F.when(known(source), source).otherwise(dims.UNKNOWN_SOURCE_LABEL)
    filled = F.replace(F.replace(template, F.lit("{source}"), where), F.lit("{user}"), who)
    prefix = F.when(risk.isin("Critical", "High"), dims.PRIORITY_PREFIX).otherwise("")
    return F.concat(prefix, filled)
