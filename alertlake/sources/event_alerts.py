"""Alert lines derived from the `events` table, so that the jobs can be checked on given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.session import dealt

DUPLICATE_BASE = 10_000_000
LINE_CAP = 2_000

GROUPS = {
    "5712": ["sshd", "authentication_failed"],
    "5760": ["sshd", "authentication_failed"],
    "5710": ["sshd", "authentication_failed"],
    "5715": ["sshd", "authentication_success"],
    "5402": ["sudo"],
    "503": ["agent_health"],
    "504": ["agent_health"],
    "100030": ["firewall", "port_scan"],
    "31101": ["web", "accesslog"],
}
TECHNIQUES = {
    "5712": ["T1110"],
    "5760": ["T1110.001", "T1021.004"],
    "5710": ["T1110.001", "T1021.004"],
    "5715": ["T1078"],
    "5402": ["T1548.003"],
    "31101": ["T9999"],
}


def _pick(table: dict[str, list[str]], key: Column) -> Column:
    case = F
    for name, values in table.items():
        case = case.when(key == name, F.array(*[F.lit(v) for v in values]))
    return case.otherwise(F.lit(None))


def given_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, dealt out to tasks of even size before wide lines are made of its rows."""
    return dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "user_id", "ts")


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested raw alert per event; every 25th event twice."""
    c = F.col
    events = given_events(spark, sf_dir).select(
        c("event_id").alias("e"),
        c("user_id").alias("u"),
        "event_type",
        "value",
        F.date_trunc("millisecond", c("ts").cast("timestamp")).alias("at"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    e, u = c("e"), c("u")
    copies = F.when(e % 25 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = events.withColumn("copy", F.explode(copies)).withColumns({
        "record_number": e + 1 + c("copy") * DUPLICATE_BASE,
        "rule_id": F.when(c("event_type") == "error", F.when(e % 7 == 0, "5712").otherwise("5760"))
        .when(c("event_type") == "view", "5710")
        .when(c("event_type") == "signup", "5715")
        .when(c("event_type") == "click", "5402")
        .when(e % 4 == 0, "503").when(e % 4 == 1, "504").when(e % 4 == 2, "100030")
        .otherwise("31101"),
        "shift": F.when(u % 3 == 0, F.expr("INTERVAL 8 HOURS"))
        .when(u % 3 == 2, F.expr("INTERVAL -5 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS")),
        "zone": F.when(u % 3 == 0, "+0800").when(u % 3 == 1, "Z").otherwise("-05:00"),
    })
    rule = c("rule_id")
    ssh = rule.isin("5712", "5760", "5710", "5715")
    host = (u % 250).cast("string")
    structured = ~rule.isin("503", "504", "5402")
    user = F.concat(F.lit("user"), u.cast("string"))
    number = (u % 10).cast("string")

    def ip(prefix: str, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), host, F.lit(suffix))

    source = (
        F.when(u % 6 == 0, ip("203.0.113.")).when(u % 6 == 1, ip("8.8.8."))
        .when(u % 6 == 2, ip("10.0.0."))
        .when((u % 6 == 3) & ~ssh, ip("[192.168.38.", "]:22"))
    )
    verb = F.when(rule == "5715", "Accepted").otherwise("Failed")
    origin = F.when(u % 6 == 3, ip(" from 192.168.38.")).otherwise("")
    return rows.select(
        "record_number",
        F.struct(
            F.when(e % 97 == 0, "not-a-time").otherwise(
                F.concat(
                    F.date_format(c("at") + c("shift"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), c("zone")
                )
            ).alias("timestamp"),
            F.when(e % 40 == 39, "").otherwise(F.concat(F.lit("E"), e.cast("string"))).alias("id"),
            F.struct(
                rule.alias("id"),
                F.when((c("copy") == 1) & (e % 50 == 0), F.lit(16))
                .otherwise((F.floor("value") % 17).cast("int")).alias("level"),
                F.concat(F.lit("rule "), rule).alias("description"),
                _pick(GROUPS, rule).alias("groups"),
                (e % 4).cast("int").alias("firedtimes"),
                F.when(
                    rule.isin(list(TECHNIQUES)),
                    F.struct(
                        _pick(TECHNIQUES, rule).alias("id"),
                        F.when(rule == "5715", F.array(F.lit("Initial Access"), F.lit("Persistence"))).alias("tactic"),
                        F.when(rule == "31101", F.array(F.lit("Unlisted"))).alias("technique"),
                    ),
                ).alias("mitre"),
            ).alias("rule"),
            F.struct(
                F.lpad(number, 3, "0").alias("id"),
                F.when(u % 10 != 9, F.concat(F.lit("host-"), number)).alias("name"),
                F.when(u % 10 != 8, F.concat(F.lit("10.1.0."), number)).alias("ip"),
            ).alias("agent"),
            F.struct(F.concat(F.lit("mgr-"), (u % 3).cast("string")).alias("name")).alias("manager"),
            F.struct(
                F.when(structured, source).alias("srcip"),
                F.when(structured & (u % 6 == 4), F.struct(ip("172.16.0.").alias("srcip"))).alias("net"),
                F.when(rule == "5402", "root").when(e % 31 == 0, "by")
                .when(e % 11 != 0, user).alias("dstuser"),
                F.when(rule == "5402", user).alias("srcuser"),
                F.when(rule == "5402", F.concat(F.lit("/usr/bin/id -u "), c("k"))).alias("command"),
            ).alias("data"),
            F.struct(F.when(ssh, "sshd").otherwise("json").alias("name")).alias("decoder"),
            F.lit("events").alias("location"),
            F.when(
                ssh, F.concat(verb, F.lit(" password for "), user, origin, F.lit(" port 22 ssh2"))
            ).when(rule == "31101", "GET /from/8.8.8.8?user=admin 404 x")
            .otherwise(F.concat(F.lit("event "), e.cast("string"))).alias("full_log"),
        ).alias("alert"),
    )


def rule_cycle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines whose rules take turns through all known ones, with an IPv6 source four levels
    deep in every other line and a line break at the end of each log text."""
    c = F.col
    rules = sorted(dims.RULES)
    e = c("event_id")
    source = F.concat(F.lit("2606:4700:0:0:0:0:0:"), F.hex(c("user_id") % 250 + 1))
    nested = F.when(e % 2 == 0, F.struct(F.struct(F.struct(source.alias("srcip")).alias("c")).alias("b")))
    alert = F.struct(
        F.concat(F.lit("R"), e.cast("string")).alias("id"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"),
        F.struct(
            F.get(F.array(*[F.lit(r) for r in rules]), (e % len(rules)).cast("int")).alias("id"),
            (F.floor("value") % 17).cast("int").alias("level"), F.array(F.lit("other")).alias("groups"),
        ).alias("rule"),
        F.struct(nested.alias("a")).alias("data"),
        F.concat(F.lit("event "), e.cast("string"), F.lit("\n")).alias("full_log"),
    )
    return given_events(spark, sf_dir).select((e + 1).alias("record_number"), F.to_json(alert).alias("value"))


def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts as JSON lines."""
    return raw_alerts(spark, sf_dir).select("record_number", F.to_json("alert").alias("value"))


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with four in fifty damaged in different ways."""
    slot = (F.col("record_number") - 1) % F.lit(DUPLICATE_BASE) % 50
    return alert_lines(spark, sf_dir).select(
        "record_number",
        F.when(slot == 1, "{not-json").when(slot == 2, '["x"]').when(slot == 3, "")
        .when(slot == 4, F.concat("value", F.lit(" " * LINE_CAP))).otherwise(F.col("value")).alias("value"),
    )
