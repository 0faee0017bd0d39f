"""Counts, top lists, timeline and headline numbers over alerts and incidents.

Every aggregation starts on the raw rows with fixed-size or per-value partial results, so a key
that holds a large share of the alerts is reduced in every task before it is shuffled.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions import clock
from alertlake.functions.scoring import risk_level, severity
from alertlake.functions.text import known, or_missing, split_list
from alertlake.session import written

ASSET_KEYS = ["manager_name", "agent_id", "affected_asset"]
TOP = 5


# A time, the line it stands in and its offset as one decimal: hash aggregation can keep its
# smallest and largest, where a struct would be sorted first. Times of the years 0 to 9999 are
# positive once shifted and have 18 digits; lines stay below 10^14; offsets are under a day.
_SHIFT_US = 10**17
_LINES = Decimal(10**14)
_OFFSETS = Decimal(10**6)
_DAY = 86_400
# Buckets of one alert, as many as a list can have.
_BUCKETS = Decimal(10**10)
_MEASURES = ["alert_count", "critical_count", "high_count", "medium_count", "low_count"]


def moment(us: Column, order: str = "pos") -> Column:
    line = us.cast("decimal(19,0)") * F.lit(_LINES) + F.col(order).cast("decimal(14,0)")
    return (line.cast("decimal(33,0)") * F.lit(_OFFSETS) + (F.col("offset_s") + _DAY).cast("decimal(6,0)")).cast("decimal(38,0)")


def moment_us(place: Column) -> Column:
    return F.call_function("div", place, F.lit(_LINES * _OFFSETS)) - _SHIFT_US


def moment_offset(place: Column) -> Column:
    return (place % F.lit(_OFFSETS)).cast("int") - _DAY


def time_range() -> list[Column]:
    """First and last time; equal instants are told apart by load order."""
    c = F.col
    seen = F.when(c("event_us").isNotNull(), moment(c("event_us") + F.lit(_SHIFT_US)))
    return [F.min(seen).alias("first_place"), F.max(seen).alias("last_place")]


def range_texts() -> dict[str, Column]:
    """Texts for `time_range`: times if there are any, else the raw texts, else "-"."""
    return {
        f"{end}_seen": F.coalesce(
            clock.iso_text(moment_us(F.col(f"{end}_place")), moment_offset(F.col(f"{end}_place"))),
            F.col(f"{end}_text"), F.lit(dims.MISSING),
        )
        for end in ("first", "last")
    }


def untimed_texts(alerts: DataFrame) -> DataFrame:
    """Alerts that have a time's text but no time: all that `range_texts` can fall back on."""
    c = F.col
    return alerts.filter(c("event_us").isNull() & known(c("timestamp")))


def common(alerts: DataFrame, keys: list[str], first: str | None = None, least: str | None = None) -> DataFrame:
    """The measures of each key, and the value of `first` in its first line or its smallest `least`.

    Alerts are counted per key and value; the value is chosen among these few rows.
    """
    c = F.col
    bands = [
        F.count_if(c("risk_level") == name).alias(f"{name.lower()}_count")
        for name in ("Critical", "High", "Medium", "Low")
    ]
    value = [x for x in (first, least) if x]
    rows = alerts.groupBy(*keys, *value).agg(
        F.count("*").alias("alert_count"), F.max("risk_score").alias("max_risk_score"), *bands,
        *time_range(), F.min("pos").alias("first_pos"),
    )
    if value:
        chosen = F.min(F.struct("first_pos", first))[first].alias(first) if first else F.min(least).alias(least)
        rows = rows.groupBy(*keys).agg(
            *[F.sum(n).alias(n) for n in _MEASURES], F.max("max_risk_score").alias("max_risk_score"),
            F.min("first_place").alias("first_place"), F.max("last_place").alias("last_place"), chosen, F.min("first_pos").alias("first_pos"),
        )
    texts = untimed_texts(alerts).groupBy(*keys, "timestamp").agg(F.lit(1)).groupBy(*keys).agg(
        F.min("timestamp").alias("first_text"), F.max("timestamp").alias("last_text")
    )
    return (
        rows.join(texts, keys, "left")
        .withColumns(range_texts())
        .withColumn("max_risk_level", risk_level(c("max_risk_score")))
        .drop("first_place", "last_place", "first_text", "last_text")
    )


def top_values(alerts: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """Five most frequent values per key as "name(n); name(n)"; ties by first appearance.

    Rows are counted per value first. The rank limit is applied in every task before the ranks of
    a key meet, so a key with very many values stays cheap.
    """
    c = F.col
    entries = F.array(*[
        F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in fields.items()
    ])
    counted = (
        alerts.select(*keys, "pos", F.explode(entries).alias("entry"))
        .select(*keys, "pos", "entry.field", "entry.value")
        .filter(c("value").isNotNull())
        .groupBy(*keys, "field", "value")
        .agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    )
    rank = F.row_number().over(
        Window.partitionBy(*keys, "field").orderBy(c("n").desc(), c("pos"))
    )
    top = counted.withColumn("rank", rank).filter(c("rank") <= TOP)
    label = F.concat(c("value"), F.lit("("), c("n").cast("string"), F.lit(")"))

    def text(name: str) -> Column:
        ranked = F.collect_list(F.when(c("field") == name, F.struct("rank", label.alias("label"))))
        return F.array_join(F.transform(F.array_sort(ranked), lambda x: x["label"]), "; ")

    return top.groupBy(*keys).agg(*[text(name).alias(name) for name in fields])


def first_places(alerts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per key and distinct value with the line it first stands in.

    Nothing is collected, so a key with millions of values is as many rows. Joined texts are made
    of this table where a report prints them.
    """
    return alerts.filter(known(F.col(column))).groupBy(*keys, column).agg(F.min("pos").alias("pos"))


def ordered_values(alerts: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """All distinct values per key in first-seen order, comma-joined: what a report prints."""
    first = first_places(alerts, keys, column)
    values = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", column))), lambda x: x[column]
    )
    return first.groupBy(*keys).agg(F.array_join(values, ", ").alias(name))


def incident_counts(incidents: DataFrame, keys: list[str]) -> DataFrame:
    return incidents.groupBy(*keys).agg(F.count("*").alias("incident_count"))


def _source() -> Column:
    return F.when(known(F.col("source_ip")), F.col("source_ip"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("max_risk_score"), F.desc("alert_count"), F.asc("first_pos"))


def by_source(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    c = F.col
    keys = ["source_ip"]
    sourced = alerts.filter(known(c("source_ip")))
    tops = top_values(sourced, keys, {"top_alert_types": c("alert_type"), "affected_assets": c("affected_asset")})
    rows = (
        common(sourced, keys, least="source_scope")
        .join(tops, keys, "left")
        .join(ordered_values(sourced, keys, "username", "usernames"), keys, "left")
        .join(incident_counts(incidents, keys), keys, "left")
        .fillna(0, ["incident_count"])
        .fillna(dims.MISSING, ["usernames"])
    )
    return _ranked(rows).select(*dims.SOURCE_SUMMARY_COLUMNS)


def by_type(alerts: DataFrame) -> DataFrame:
    keys = ["alert_type"]
    tops = top_values(alerts, keys, {"source_ips": _source(), "affected_assets": F.col("affected_asset")})
    rows = common(alerts, keys, first="event_category").join(tops, keys, "left")
    return _ranked(rows.withColumn("source_ips", or_missing(F.col("source_ips")))).select(*dims.TYPE_SUMMARY_COLUMNS)


def by_asset(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    tops = top_values(alerts, ASSET_KEYS, {"top_alert_types": F.col("alert_type"), "source_ips": _source()})
    rows = (
        common(alerts, ASSET_KEYS, first="agent_ip")
        .join(tops, ASSET_KEYS, "left")
        .join(incident_counts(incidents, ASSET_KEYS), ASSET_KEYS, "left")
        .fillna(0, ["incident_count"])
        .withColumn("source_ips", or_missing(F.col("source_ips")))
    )
    return _ranked(rows).select(*dims.ASSET_SUMMARY_COLUMNS)


def by_rule(alerts: DataFrame) -> DataFrame:
    c = F.col
    keys = ["rule_id", "description"]
    rows = (
        alerts.groupBy(*keys)
        .agg(
            F.count("*").alias("alert_count"), F.max("rule_level").alias("rule_level"),
            F.max("risk_score").alias("max_risk_score"), F.min("pos").alias("first_pos"),
        )
        .join(ordered_values(alerts, keys, "affected_asset", "affected_assets"), keys, "left")
        .withColumns({
            "rule_severity": severity(c("rule_level")),
            "max_risk_level": risk_level(c("max_risk_score")),
            "affected_assets": F.coalesce("affected_assets", F.lit("")),
        })
    )
    return _ranked(rows).select(*dims.RULE_SUMMARY_COLUMNS)


def mitre_buckets(alerts: DataFrame) -> DataFrame:
    """One row per alert and ATT&CK bucket: its tactics, its technique ids, or Unmapped."""
    c = F.col

    def bucket(kind: str, stage: Column, technique_id: Column, technique: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("mapping_type"), stage.alias("attack_stage"),
            technique_id.alias("mitre_id"), technique.alias("technique"),
        )

    missing = F.lit(dims.MISSING)
    tactic_of = {k: v[0] for k, v in dims.ATTACK.items()}
    name_of = {k: v[1] for k, v in dims.ATTACK.items()}
    lists = alerts.withColumns({
        "ids": split_list(c("mitre_ids")), "tactics": split_list(c("mitre_tactics")),
        "names": split_list(c("mitre_techniques")),
    })
    by_tactic = F.transform("tactics", lambda t: bucket("Tactic", t, missing, missing))
    by_id = F.transform(
        "ids",
        lambda x, i: bucket(
            "Technique", F.coalesce(dims.lookup(tactic_of, x), missing), x,
            F.coalesce(dims.lookup(name_of, x), F.get("names", i), missing),
        ),
    )
    unmapped = F.array(bucket("Unmapped", F.lit("Unmapped"), missing, missing))
    buckets = F.when((F.size("ids") == 0) & (F.size("tactics") == 0), unmapped).otherwise(
        F.concat(by_tactic, by_id)
    )
    return lists.select(
        "pos", "risk_score", "source_ip", "affected_asset", F.posexplode(buckets).alias("place", "bucket")
    ).select("pos", "place", "risk_score", "source_ip", "affected_asset", "bucket.*")


def by_mitre(alerts: DataFrame) -> DataFrame:
    c = F.col
    keys = ["mapping_type", "attack_stage", "mitre_id", "technique"]
    buckets = mitre_buckets(alerts)
    tops = top_values(buckets, keys, {"top_source_ips": _source(), "affected_assets": c("affected_asset")})
    rows = (
        buckets.groupBy(*keys)
        .agg(
            F.count("*").alias("alert_count"), F.max("risk_score").alias("max_risk_score"),
            F.min(c("pos").cast("decimal(15,0)") * F.lit(_BUCKETS) + c("place").cast("decimal(10,0)")).alias("first_at"),
        )
        .join(tops, keys, "left")
        .withColumns({
            "max_risk_level": risk_level(c("max_risk_score")),
            "top_source_ips": or_missing(c("top_source_ips")),
        })
    )
    return rows.orderBy(
        (c("mapping_type") == "Technique").desc(), (c("max_risk_level") == "Critical").desc(),
        c("alert_count").desc(), c("first_at"),
    ).select(*dims.MITRE_SUMMARY_COLUMNS)


def recommendations(queue: DataFrame) -> DataFrame:
    return queue.select(*dims.RECOMMENDATION_COLUMNS)


_TEN_MINUTES = 600


def timeline_buckets(alerts: DataFrame) -> DataFrame:
    """Counts per ten minutes with the bucket's first and last time and the offset of its first alert.

    Every coarser bucket is a sum of these rows, of which a year has some fifty thousand however
    many alerts there are. Written, as the bucket size follows from all of them.
    """
    c = F.col
    second = F.call_function("div", c("event_us"), F.lit(1_000_000))
    rows = (
        alerts.filter(c("event_us").isNotNull())
        .groupBy((second - F.pmod(second, F.lit(_TEN_MINUTES))).alias("bucket"))
        .agg(
            F.count("*").alias("alert_count"),
            F.count_if(c("risk_level").isin("High", "Critical")).alias("high_or_critical_count"),
            F.count_if(c("event_category") == "Credential Attack").alias("credential_attack_count"),
            *time_range(),
        )
    )
    return written(rows, "timeline-buckets")


def timeline(alerts: DataFrame, zone: str = "input") -> DataFrame:
    """Counts per time bucket; the bucket size follows from the span of all alerts.

    Alerts are read once; the size is chosen and buckets are joined among ten-minute counts.
    """
    c = F.col
    fine = timeline_buckets(alerts)
    span = fine.agg((moment_us(F.max("last_place")) - moment_us(F.min("first_place"))).alias("span")).scalar()
    hour = 3_600_000_000
    size = (
        F.when(span <= 2 * hour, _TEN_MINUTES).when(span <= 24 * hour, 3_600)
        .when(span <= 7 * 24 * hour, 21_600).otherwise(86_400)
    )
    rows = fine.groupBy((c("bucket") - F.pmod(c("bucket"), size)).alias("bucket")).agg(
        *[F.sum(n).alias(n) for n in ("alert_count", "high_or_critical_count", "credential_attack_count")],
        F.min("first_place").alias("first_place"),
    )
    start = c("bucket") * 1_000_000
    zone_shift = clock.zone_offset(start, zone)
    shift = moment_offset(c("first_place")) if zone_shift is None else zone_shift
    return (
        rows.withColumn("period_start", clock.iso_text(start, shift, "yyyy-MM-dd'T'HH:mm"))
        .orderBy("bucket").select(*dims.TIMELINE_COLUMNS)
    )


def metrics(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """The headline numbers: one row."""
    c = F.col
    bands = ("Critical", "High", "Medium", "Low")
    sourced = known(c("source_ip"))
    mapped = known(c("mitre_ids")) | known(c("mitre_tactics"))

    def category(name: str, alias: str) -> Column:
        return F.count_if(c("event_category") == name).alias(alias)

    # Each dimension is grouped once by its key; counting distinct values side by side would
    # multiply the alerts they are counted in.
    external = F.max(c("source_scope") == "Public/External").alias("external")
    sources = alerts.filter(sourced).groupBy("source_ip").agg(external).agg(F.struct(
        F.count("*").alias("source_ip_count"), F.count_if("external").alias("external_source_count"),
    ).alias("d")).scalar()
    assets = alerts.select(*ASSET_KEYS).distinct().agg(F.count("*").alias("n")).scalar()
    rules = alerts.select("rule_id").distinct().agg(F.count("rule_id").alias("n")).scalar()
    texts = untimed_texts(alerts).select("timestamp").distinct().agg(
        F.struct(F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).alias("t")
    ).scalar()
    per_alert = alerts.agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(c("risk_level") == b).alias(f"{b.lower()}_alerts") for b in bands],
        F.count_if(~sourced).alias("unknown_source_alerts"),
        category("Credential Attack", "credential_attack_alerts"),
        category("Privilege Activity", "privilege_alerts"),
        category("Agent Visibility", "agent_visibility_alerts"),
        F.count_if(mapped).alias("mitre_mapped_alerts"),
        F.count_if(c("classification_confidence") == "Low").alias("low_confidence_classifications"),
        *time_range(),
    )
    per_incident = incidents.agg(F.struct(
        F.count("*").alias("total_incidents"),
        *[F.count_if(c("risk_level") == b).alias(f"{b.lower()}_incidents") for b in bands],
        F.max("risk_score").alias("highest"),
    ).alias("i")).scalar()
    total = c("total_alerts")
    share = F.bround(F.try_divide(c("mitre_mapped_alerts"), total) * 100, 1)
    return (
        per_alert.withColumns({"incident": per_incident, "sources": sources, "asset_count": assets, "rule_count": rules, "texts": texts})
        .withColumns({"first_text": c("texts.low"), "last_text": c("texts.high")})
        .withColumns(range_texts())
        .select(
            "total_alerts", "incident.total_incidents",
            *[f"{b.lower()}_alerts" for b in bands],
            *[f"incident.{b.lower()}_incidents" for b in bands],
            "sources.source_ip_count", "sources.external_source_count", "unknown_source_alerts",
            "asset_count", "rule_count", "credential_attack_alerts", "privilege_alerts", "agent_visibility_alerts",
            "mitre_mapped_alerts", (total - c("mitre_mapped_alerts")).alias("mitre_unmapped_alerts"),
            F.when(total > 0, share).otherwise(0.0).alias("mitre_coverage_percent"),
            "low_confidence_classifications", "first_seen", "last_seen",
            F.coalesce(
                clock.whole_seconds(moment_us(c("last_place")) - moment_us(c("first_place"))), F.lit(0)
            ).alias("duration_seconds"),
            F.coalesce("incident.highest", F.lit(0)).alias("highest_risk_score"),
            F.when(c("incident.total_incidents") > 0, risk_level(c("incident.highest")))
            .otherwise("None").alias("highest_risk_level"),
        )
    )
